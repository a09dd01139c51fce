"""Brute force, round trips and edge cases for the language-model operators."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sievework.llm import fingerprints, language, lattice, license_scan, line_dedup, matroska, mixture, quality, simhash_dedup, simhash_wide, token_output
from sievework.llm import queries as llm
from tests.conftest import same_rows

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCAB, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [(1, "the mit license and The MIT License"), (2, None), (3, ""), (3, "another text of id three"), (4, LONG), (None, "null id"), (5, "copy me now please"), (6, "copy me now please"), (6, "copy me now please"), (7, "\x0b \t\n"), (8, "ünï çødé ß 日本 🙂\r\nline")]


def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names could clash."""
    d = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a"))
    for c in ("id", "fp", "key", "n", "label", "pos", "size", "start", "block", "h", "src", "removed", "n_units", "group", "cid", "part", "seq", "lang"):
        d = d.withColumn(c, F.lit("x"))
    return d


def nothing(spark):
    return odd(spark).limit(0)


CALLS = {
    "media": lambda d: matroska.media_features(matroska.media_column(d)), "mix": mixture.mix, "scan": license_scan.scan, "lattice": lambda d: lattice.sample_segmentations(d, VOCAB, 1), "next": fingerprints.fingerprint_with_next,
    "features": quality.text_features, "tokens": lambda d: token_output.tokenise(d, BPE), "lines": line_dedup.dedup_units, "language": lambda d: language.predict_language(d, language.Filters().fit({"en": ["the copy of the text"]})), "near": simhash_dedup.near_components,
}


@pytest.mark.parametrize("name", sorted(CALLS))
def test_one_row_a_row_whatever_the_rows(spark, name):
    assert CALLS[name](odd(spark)).count() == len(ODD)
    assert CALLS[name](nothing(spark)).count() == 0


def test_wide_groups_whatever_the_rows(spark):
    kept = simhash_wide.keep_one(odd(spark)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (False, 8), (True, 0)]
    assert next(r for r in kept if r["doc_id"] == 3)["text"] == "another text of id three"
    assert simhash_wide.near_groups(odd(spark)).count() == len(ODD) - 1
    alike = spark.createDataFrame([(1, "a text", "x"), (1, "a text", "y"), (1, "other words", "z")], "doc_id long, text string, `key` string")
    assert sorted(r["text"] for r in simhash_wide.keep_one(alike).collect()) == ["a text", "other words"]
    assert simhash_wide.keep_one(nothing(spark)).count() == 0


# 1
def test_matroska_round_trip_and_errors():
    for n in (64, 128, 2048, 2112, 65_536, 70_016, 200_000 // 64 * 64):
        p = random.Random(n).randbytes(n)
        m = matroska.mux(p)
        k = matroska.parse(m)
        assert b"".join(m[x.offset : x.offset + x.length] for x in k.packets) == p
        at = 0
        for x in k.packets:
            assert x.timestamp_ns == at * 125_000 and x.track == 1
            at += x.length
        assert all(m[o : o + 4] == bytes.fromhex("1F43B675") for _, _, o in k.cues) and len(k.cues) == k.packets[-1].cluster + 1
    assert {x.lacing for x in k.packets} == {"none", "xiph", "fixed", "ebml"}
    for bad in (b"", b"\x00" * 20, m[:300], b"\x1a\x45\xdf\xa3\x80"):
        with pytest.raises(matroska.MatroskaError):
            matroska.parse(bad)


def test_matroska_unknown_sizes():
    m = matroska.mux(random.Random(1).randbytes(70_016))
    at = m.index(bytes.fromhex("1F43B675")) + 4
    width = 9 - m[at].bit_length()
    unknown = m[:at] + ((1 << (7 * width + 1)) - 1).to_bytes(width, "big") + m[at + width :]
    assert [x.length for x in matroska.parse(unknown).packets] == [x.length for x in matroska.parse(m).packets]


def test_packet_table_names_errors(spark):
    d = spark.createDataFrame([(1, bytearray(matroska.mux(bytes(128)))), (2, None), (3, bytearray(b"no"))], "id long, media binary")
    r = matroska.packet_table(d).toPandas()
    assert r[r.id == 1].byte_length.sum() == 128 and r[r.id != 1].error.notna().all()


def ebml(key, body, width=None):
    """An element by hand: id, size in so many bytes (0: unknown), body."""
    n = len(body)
    if width == 0:
        size = b"\x01" + b"\xff" * 7
    else:
        width = width or next(w for w in range(1, 9) if n < (1 << (7 * w)) - 1)
        size = (n | 1 << (7 * width)).to_bytes(width, "big")
    return bytes.fromhex(key) + size + body


def by_hand(tracks, clusters, cluster_width=0):
    """A file whose segment and clusters have unknown sizes, with Void elements between."""
    head = ebml("1a45dfa3", ebml("4282", b"webm\0"))
    info = ebml("1549a966", ebml("2ad7b1", (500_000).to_bytes(3, "big")))
    entries = b"".join(ebml("ae", ebml("d7", bytes([n])) + ebml("83", bytes([kind])) + ebml("86", codec) + more) for n, kind, codec, more in tracks)
    void = ebml("ec", bytes(5))
    body = info + void + ebml("1654ae6b", entries) + b"".join(ebml("1f43b675", ebml("e7", when.to_bytes(2, "big")) + void + blocks, cluster_width) for when, blocks in clusters)
    return head + ebml("18538067", body + ebml("1c53bb6b", b"", 8), 0)


def audio(rate, channels, bits=8):
    return ebml("e1", ebml("b5", rate) + ebml("9f", channels) + ebml("6264", bytes([bits])))


def test_matroska_by_hand():
    import struct

    pcm = audio(struct.pack(">f", 1000.0), b"\x01")
    sizes = [300, 100, 500, 80]  # the second delta is -200, the third 400
    lace = (300 | 1 << 14).to_bytes(2, "big") + (-200 + 8191 | 1 << 14).to_bytes(2, "big") + (400 + 8191 | 1 << 14).to_bytes(2, "big")
    payload = b"".join(bytes([i]) * n for i, n in enumerate(sizes))
    laced = ebml("a3", b"\x81" + struct.pack(">h", -3) + b"\x86\x03" + lace + payload)
    plain = ebml("a0", ebml("a1", b"\x82" + struct.pack(">h", 7) + b"\x00" + b"frame") + ebml("fb", b"\xff"))
    fixed = ebml("a3", b"\x82" + struct.pack(">h", 0) + b"\x04\x01" + b"abcd")
    data = by_hand([(1, 2, b"A_PCM/INT/LIT", pcm), (2, 1, b"V_TEST", ebml("23e383", (40_000_000).to_bytes(4, "big")))], [(100, laced + plain), (300, fixed)])
    m = matroska.parse(data)
    got = [(p.track, p.timestamp_ns, bytes(data[p.offset : p.offset + p.length]), p.cluster, p.block, p.lacing, p.keyframe) for p in m.packets]
    base, at, want = 97 * 500_000, 0, []
    for i, n in enumerate(sizes):
        want.append((1, base + at * 1_000_000, bytes([i]) * n, 0, 0, "ebml", True))
        at += n
    want.append((2, 107 * 500_000, b"frame", 0, 1, "none", False))
    want += [(2, 300 * 500_000, b"ab", 1, 2, "fixed", False), (2, 300 * 500_000 + 40_000_000, b"cd", 1, 2, "fixed", False)]
    assert got == want and m.doctype == "webm" and m.cues == [] and set(m.tracks) == {1, 2}


def test_media_features_never_die(spark):
    import struct

    block = ebml("a3", b"\x81\x00\x00\x02\x01\x01ab")
    good = struct.pack(">d", 8000.0)
    odd_files = {
        "null": None, "empty": b"", "garbage": b"\x00\x01\x02" * 30, "header only": ebml("1a45dfa3", ebml("4282", b"matroska")),
        "no packets": by_hand([(1, 2, b"A_PCM/INT/LIT", audio(good, b"\x01"))], []), "no channels": by_hand([(1, 2, b"A_PCM/INT/LIT", audio(good, b"\x00"))], [(0, block)]),
        "no rate": by_hand([(1, 2, b"A_PCM/INT/LIT", audio(bytes(8), b"\x01"))], [(0, block)]), "two-byte float": by_hand([(1, 2, b"A_PCM/INT/LIT", audio(b"\x00\x00", b"\x01"))], [(0, block)]),
        "infinite rate": by_hand([(1, 2, b"A_PCM/INT/LIT", audio(struct.pack(">f", float("inf")), b"\x01"))], [(0, block)]), "no such track": by_hand([], [(0, block)]),
        "lace past the block": by_hand([], [(0, ebml("a3", b"\x81\x00\x00\x02\x01\xff"))]), "cut": matroska.mux(bytes(6400))[:-90],
    }
    rng = random.Random(15)
    whole = matroska.mux(rng.randbytes(640))
    for i in range(300):  # bytes flipped anywhere
        x = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            x[rng.randrange(len(x))] = rng.randrange(256)
        odd_files[f"flip {i}"] = bytes(x)
    d = spark.createDataFrame([(k, 0, v if v is None else bytearray(v)) for k, v in odd_files.items()], "id string, n_bytes int, media binary")
    r = {x["id"]: x for x in matroska.media_features(d).collect()}
    bad = ["null", "empty", "garbage", "header only", "two-byte float", "infinite rate", "lace past the block", "cut"]
    assert len(r) == len(odd_files) and all(r[k]["error"] and r[k]["feature"] is None for k in bad)
    assert r["no packets"]["payload_bytes"] == 0 and all(r[k]["error"] is None and r[k]["payload_bytes"] == 2 for k in ("no channels", "no rate", "no such track"))
    p = matroska.packet_table(d).where("id in ('no channels', 'null', 'no packets')").collect()
    assert sorted((x["id"], x["byte_length"]) for x in p if x["error"] is None) == [("no channels", 1), ("no channels", 1)] and sum(x["error"] is not None for x in p) == 1


def test_stored_bytes_equal_the_contract(spark, sf_dir):
    r = {x["doc_id"]: x for x in llm.QUERIES["op1_media_columns"](spark, sf_dir).collect()}
    for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        raw = (x["text"] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        y = r[x["doc_id"]]
        assert (y["n_bytes"], y["payload_bytes"], y["payload_sha256"], y["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])) and y["media_bytes"] > len(padded)


# 2
def test_mixture_targets_and_caps(spark):
    rows = [(i, "w " * (1 + i % 37), s) for i, s in enumerate(["a"] * 700 + ["b"] * 40 + ["c"] * 300 + [None] * 30)]
    d = mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert (d.taken <= 3 * d["size"]).all()
    g = d.groupby(d.source.fillna("~")).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(g.target.sum() - g["size"].sum()) < 1e-6 and (g.target <= 3 * g["size"] + 1e-9).all() and (abs(g.taken - g.target) <= np.maximum(100, 0.05 * g.target)).all()
    weights, sizes = dict(zip(g.index, (5, 2, 1, 5))), g["size"].to_dict()
    got, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        w = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / w for s in open_}
        left = 0.0
        for s, x in share.items():
            got[s] += x
            if got[s] > 3 * sizes[s]:
                left += got[s] - 3 * sizes[s]
                got[s] = 3.0 * sizes[s]
                open_.discard(s)
    assert all(abs(got[s] - g.target[s]) < 1e-3 for s in sizes)


# 3
def test_set_join_equals_brute_force(spark):
    rng, words = random.Random(2), [f"t{i}" for i in range(25)]
    templates = [(f"l{i}", " ".join(rng.sample(words, rng.randint(3, 9)))) for i in range(12)]
    lines = ["\n".join(" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(rng.randint(1, 4))) for _ in range(120)]
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["id"]: {(m["start"], m["template"]) for m in r["matches"]} for r in license_scan.scan(d, templates=templates, threshold=0.75).collect()}
    sets = [frozenset(license_scan.fold(t).split()) for _, t in templates]
    for i, text in enumerate(lines):
        want = set()
        for start, block in license_scan.blocks(license_scan.fold(text)):
            want |= {(start, k) for k, s in enumerate(sets) if len(s & set(block)) >= math.ceil(0.75 * len(s) - 1e-9)}
        assert got[i] == want


def test_phrases():
    w = license_scan.fold("MIT-License; the General\nPublic License, mit license").split()
    assert license_scan.places(w, license_scan.PHRASES) == [(0, "mit"), (3, "gpl"), (6, "mit")]


# 4
def paths(v, text):
    """All segmentations of a short text with their weights."""
    t = lattice.SPACE + text.replace(" ", lattice.SPACE)
    ids = {p: (int(i), w) for p, i, w in zip(v.pieces, v.ids, v.weight)}

    def go(at):
        if at == len(t):
            yield (), 0.0
            return
        for n in range(1, v.longest + 1):
            p = t[at : at + n]
            if len(p) == n and p in ids:
                for rest, w in go(at + n):
                    yield (ids[p][0], *rest), w + ids[p][1]

    return dict(go(0))


def test_samples_are_distinct_and_follow_the_model():
    v = lattice.vocabulary(VOCAB)
    want = paths(v, "that is")
    total = np.logaddexp.reduce(list(want.values()))
    n = 3000
    drawn = lattice.sample(v, list(range(n)), ["that is"] * n, 3, 1.0)
    first, second = {}, {}
    for found, after in drawn:
        ids = [tuple(x[0].tolist()) for x in found]
        assert len(set(ids)) == 3 and all(abs(x[1] - (want[i] - total)) < 1e-9 for x, i in zip(found, ids)) and found[0][2] > found[1][2] > found[2][2] > after
        first[ids[0]] = first.get(ids[0], 0) + 1
        second[ids[1]] = second.get(ids[1], 0) + 1
    p = {k: math.exp(w - total) for k, w in want.items()}
    q = {k: sum(p[a] * p[k] / (1 - p[a]) for a in p if a != k) for k in p}
    for k in p:
        for share, count in ((p[k], first.get(k, 0)), (q[k], second.get(k, 0))):
            assert abs(count / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 0.004


def test_all_paths_come_when_few(spark):
    v = lattice.vocabulary(VOCAB)
    want = paths(v, "a")
    (found, after), = lattice.sample(v, ["k"], ["a"], 50, 1.0)
    assert {tuple(x[0].tolist()) for x in found} == set(want) and after == -np.inf


def odd_strings():
    rng = random.Random(11)
    return ["a!!", "a...", "f),", "b ...", "...", "hi...", "f());", "a().", "x://y", 'he said."', "  a", "a  b "] + ["".join(rng.choice("abe. ,!?()':;/") for _ in range(rng.randint(1, 7))) for _ in range(200)]


def test_samples_are_all_segmentations_of_odd_strings():
    v = lattice.vocabulary(VOCAB)
    for text in odd_strings():
        want = paths(v, text)
        total = np.logaddexp.reduce(list(want.values()))
        (found, after), = lattice.sample(v, ["k"], [text], len(want) + 5, 1.0)
        got = {tuple(x[0].tolist()): x[1] for x in found}
        assert set(got) == set(want) and after == -np.inf and all(abs(got[k] - (want[k] - total)) < 1e-6 for k in want), text
        assert all(a[2] > b[2] for a, b in zip(found, found[1:]))
        (ids, w), = lattice.encode_best(v, [text])
        assert abs(w - max(want.values())) < 1e-9 and abs(want[tuple(ids.tolist())] - w) < 1e-9


def test_units_are_numbered_alike_either_way():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n▁.é日") for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    for some in (texts, [*texts, "x\x1f y"], [], [""]):
        words, coded, bounds = lattice._coded(some)
        assert [[words[x] for x in coded[s:e]] for s, e in zip(bounds, bounds[1:])] == [lattice.units(t) for t in some]


def test_draws_do_not_depend_on_the_batch():
    v, texts = lattice.vocabulary(VOCAB), [f"a text, number {i}: it's {i * i} odd!!" for i in range(300)]
    together = lattice.sample(v, [*range(300)], texts, 3, 1.0)
    for i in range(0, 300, 17):
        (alone,) = lattice.sample(v, [i], [texts[i]], 3, 1.0)
        assert [x[0].tolist() for x in alone[0]] == [x[0].tolist() for x in together[i][0]] and [x[1] for x in alone[0]] == [x[1] for x in together[i][0]]


def test_kept_words_change_no_result(monkeypatch):
    v, rng = lattice.vocabulary(VOCAB), random.Random(18)
    words = ["it's", "!!", "naïve", "日本", "🙂", "a", "number", "x://y", "\n", "ﷺ", "𝔘", "strange"]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(200)]
    plain = lattice.sample(v, [*range(200)], texts, 2, 1.0)
    kept = lattice._Kept()
    monkeypatch.setattr(lattice, "KEPT", 4)
    monkeypatch.setattr(lattice, "_kept", lambda v, alpha: kept)
    for at in range(0, 200, 20):
        some = lattice.sample(v, [*range(at, at + 20)], texts[at : at + 20], 2, 1.0)
        for (x, after), (y, want) in zip(some, plain[at : at + 20]):
            assert after == want and [(a.tolist(), b, c) for a, b, c in x] == [(a.tolist(), b, c) for a, b, c in y]
    assert len(kept.number) == 4 and kept.base is not None


def test_best_path_round_trip(spark):
    d = odd(spark)
    best = lattice.encode_texts(d, VOCAB).collect()
    v = lattice.vocabulary(VOCAB)
    assert sorted(lattice.decode(v, r["ids"]) for r in best) == sorted(t or "" for _, t in ODD)
    ids = spark.createDataFrame([(1, [x for x in best[0]["ids"]]), (2, None), (3, []), (4, [-1]), (5, [None])], "id long, ids array<int>")
    got = {r["id"]: r["text"] for r in lattice.decode_ids(ids, VOCAB).collect()}
    assert got == {1: next(t for i, t in ODD if i == best[0]["id"]), 2: None, 3: "", 4: None, 5: None}


def test_decoding_gives_the_text(spark):
    r = lattice.sample_segmentations(odd(spark), VOCAB, 2, with_ids=True).collect()
    v = lattice.vocabulary(VOCAB)
    texts = {i: t or "" for i, t in ODD if i not in (3, 6)}
    assert all(x["exact"] for x in r) and all(lattice.decode(v, x["ids"]) == texts[x["id"]] for x in r if x["id"] in texts)
    again = lattice.sample_segmentations(odd(spark).repartition(3), VOCAB, 2, chars=10).collect()
    key = lambda rows: sorted((str(x["id"]), x["sample"], x["ids_crc32"]) for x in rows)
    assert key(r) == key(again)


# 5
def test_edits_follow_the_order_of_ids(spark):
    rows = [(i, f"text {i} " * (i % 5 + 1)) for i in random.Random(3).sample(range(500), 200)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    rows.sort()
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert got[i]["fingerprint"] == fingerprints.simhash256(t).hex()


@pytest.mark.parametrize("radius", [0, 3, 12])
@pytest.mark.parametrize("few", [8.0, 1e-4])
def test_block_tables_find_all(spark, monkeypatch, radius, few):
    plan = fingerprints.plan
    monkeypatch.setattr(fingerprints, "plan", lambda r, n: plan(r, n, few))
    rng = random.Random(4)
    base = [rng.getrandbits(256) for _ in range(6)]
    all_ = {b ^ sum(1 << x for x in rng.sample(range(256), rng.randint(0, radius))) for b in base for _ in range(25)}
    d = spark.createDataFrame([(f"{x:064x}",) for x in all_] + [(None,)], "fingerprint string")
    want = {(a, b) for a, b in itertools.combinations(sorted(f"{x:064x}" for x in all_), 2) if (int(a, 16) ^ int(b, 16)).bit_count() <= radius}
    got = [(r["src"], r["dst"]) for r in fingerprints.links(d, radius).collect()]
    assert set(got) == want and len(got) == len(want)
    some = sorted(f"{x:064x}" for x in all_)[:40]
    asked = [(r["src"], r["dst"]) for r in fingerprints.links(d, radius, of=d.where(F.col("fingerprint").isin(some))).collect()]
    assert sorted(asked) == sorted((a, b) for x in want for a, b in (x, x[::-1]) if a in some)
    assert fingerprints.links(d.limit(0), radius).count() == 0


def test_tables_leave_a_key_whole():
    for radius in (0, 3, 12, 30):
        for n in (10, 10**6, 10**10):
            tables, rng = fingerprints.plan(radius, n), random.Random(radius)
            for _ in range(50):
                flipped = set(rng.sample(range(256), radius))
                assert any(all(not flipped & set(range(s, s + k)) for s, k in t) for t in tables)


# 6
def test_quality_on_held_out(spark, sf_dir):
    import pandas as pd

    big = sf_dir.replace("0.001", "0.01")
    r = llm.QUERIES["op6_quality"](spark, big).toPandas().merge(pd.read_parquet(f"{big}/labels.parquet"), on="doc_id")
    held = r[r.held_out]
    assert (r.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in r.doc_id]).all()
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97 and held[held.quality == 1].predicted.mean() > 0.97


def loops(x, scorer):
    """The scorer's rows by plain loops."""
    out = []
    for row in x:
        z = [min(6.0, max(-6.0, (float(v) - m) / s)) for v, m, s in zip(row, scorer.mean, scorer.scale)]
        out.append(z + [float(v > c) for v, cuts in zip(z, scorer.cuts) for c in cuts] + [1.0])
    return out


def test_fit_equals_plain_loops():
    rng = random.Random(16)
    pos = np.array([[rng.gauss(1, 1), rng.gauss(0, 1)] for _ in range(15)])
    unl = np.array([[rng.gauss(rng.choice((1, -2)), 1), rng.gauss(0, 1)] for _ in range(25)])
    prior, steps = 0.7, 12
    got = quality.Scorer(bands=4, rounds=steps).fit(pos, unl, prior)
    p, u = loops(pos, got), loops(unl, got)
    sig, soft = lambda t: 1 / (1 + math.exp(-t)), lambda t: math.log1p(math.exp(t))
    d = len(p[0])
    w, m, v = [0.0] * d, [0.0] * d, [0.0] * d
    for step in range(1, steps + 1):
        f = lambda r: sum(a * b for a, b in zip(r, w))
        negative = sum(soft(f(r)) for r in u) / len(u) - prior * sum(soft(f(r)) for r in p) / len(p)
        for j in range(d):
            plus = -prior * sum(sig(-f(r)) * r[j] for r in p) / len(p)
            minus = sum(sig(f(r)) * r[j] for r in u) / len(u) - prior * sum(sig(f(r)) * r[j] for r in p) / len(p)
            g = (plus + minus if negative >= 0 else -minus) + got.penalty * w[j]
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
        w = [w[j] - got.rate * (m[j] / (1 - 0.9**step)) / (math.sqrt(v[j] / (1 - 0.999**step)) + 1e-8) for j in range(d)]
    assert np.allclose(got.w, w, atol=2e-3)
    assert np.allclose(got.score(unl), [1 / (1 + math.exp(-sum(a * b for a, b in zip(r, w)))) for r in u], atol=2e-3)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(17)
    pos = rng.normal(2, 1, (1500, 3))
    unl = np.vstack([rng.normal(2, 1, (int(4000 * share), 3)), rng.normal(-2, 1, (4000 - int(4000 * share), 3))])
    assert abs(quality.estimate_prior(pos, unl) - share) < 0.05


def test_no_labels_give_the_prior(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, "")], "doc_id long, text string")
    marks = spark.createDataFrame([], "id long, label int")
    assert {r["score"] for r in quality.score_quality(d, marks).collect()} == {1.0}


# 7
def test_word_encoder_equals_the_library():
    e, rng = token_output.WordEncoder(BPE), random.Random(5)
    texts = ["", "<|endoftext|> hi", "it's you'll 1234 ½ x² İstanbul ß", "日本語 text", "a_b__c ''s 's'S #'s", "\x85x\xa0y", "café", "ΑΣ", LONG] + ["".join(rng.choice("aB1'_s t#é×÷ªº.,µ¿ \n") for _ in range(80)) for _ in range(300)]
    ids, count = e.encode(pa.array(texts))
    for t, own in zip(texts, np.split(ids, np.cumsum(count)[:-1])):
        assert own.tolist() == e.library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("remembered", [1, 50, 1 << 12])
def test_word_encoder_forgets(remembered):
    e, long = token_output.WordEncoder(BPE, remembered), "x" * 63
    for texts in ([f"word{i} a, b. {i % 7} {long}{i % 3} {long}{'yz'[i % 2]}" for i in range(s, s + 40)] for s in (0, 20, 300, 0)):
        ids, count = e.encode(pa.array([*texts, None, "", " "]).slice(1))
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [e.library.encode(t, add_special_tokens=False).ids for t in [*texts, "", "", " "][1:]]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, tmp_path, encoding):
    import pyarrow.parquet as pq

    rows = [(i, f"some words of text {i} " * (i % 7)) for i in random.Random(6).sample(range(1000), 300)]
    path = str(tmp_path / "t")
    token_output.write_tokens(token_output.tokenise(spark.createDataFrame(rows, "doc_id long, text string"), BPE), path, encoding, page_rows=20)
    got = {r["doc_id"]: r for r in token_output.token_index(spark, path).collect()}
    e, at = token_output.WordEncoder(BPE), 0
    for i, t in sorted(rows):
        ids = e.library.encode(t, add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert token_output.read_tokens(spark, path, ["doc_id"], 100, 200).count() == sum(100 <= i <= 200 for i, _ in rows)
    col = pq.ParquetFile(next((tmp_path / "t").glob("*.parquet"))).metadata.row_group(0)
    names = [col.column(i).path_in_schema for i in range(col.num_columns)]
    ids = col.column(next(i for i, n in enumerate(names) if n.startswith("ids")))
    assert any(("DICTIONARY" if encoding == "dictionary" else "DELTA") in x for x in ids.encodings) and ids.has_offset_index


# 8
def test_line_dedup_keeps_the_earliest(spark):
    line, other = "one two three four five six seven eight nine", "a b c d e f g h i j"
    d = spark.createDataFrame([(2, f"x\n{line.upper()}  \ny"), (1, f"{line}\n{other}"), (3, other), (4, f"yes\n{line}\n{line}"), (5, None), (6, "yes"), (None, line)], "doc_id long, text string")
    r = {x["doc_id"]: x for x in line_dedup.dedup_units(d).collect()}
    assert r[1]["text"] == f"{line}\n{other}" and r[2]["text"] == "x\ny" and r[3]["text"] == "" and r[4]["text"] == "yes" and r[5]["text"] is None and r[6]["text"] == "yes"
    assert r[None]["text"] == line
    s = r[2]["removed"][0]
    assert (s["start"], s["end"], s["unit"], s["kept_id"]) == (2, 2 + len(line) + 2, 1, 1)


def test_passages_of_short_lines_and_inside_lines_go(spark):
    wrapped = "\n".join(f"p{i} q{i} r{i}" for i in range(20))
    inner = "Here is a sentence of nine words at all. And another one follows it with some more words."
    d = spark.createDataFrame([(1, f"start\n{wrapped}\nend of the first"), (2, f"other start here\n{wrapped}\nother end"), (3, f"Own words. {inner} More own."), (4, f"Quite other words stand here! {inner} Last.")], "doc_id long, text string")
    r = {x["doc_id"]: x for x in line_dedup.dedup_units(d).collect()}
    assert r[2]["text"].split("\n")[0] == "other start here" and len(r[2]["text"].split()) <= 5 + 6 and r[2]["passage_words"] >= 54
    assert r[4]["text"] == "Quite other words stand here! Last." and r[3]["text"] == f"Own words. {inner} More own."


def brute_dedup(rows, m):
    """The same cut by plain loops over rows (id, text) in order."""
    def parts(text):
        out = []
        for line in text.split("\n"):
            at = 0
            for x in re.finditer(r"[.!?][\x20\x09\x0b-\x0d]+", line):
                out.append(line[at : x.end()])
                at = x.end()
            out.append(line[at:])
        return [p.lower().split() for p in out if p.split()]

    where = {}
    for i, t in rows:
        if i is not None and t:
            p = parts(t)
            for s in range(len(p)):
                run, e = [], s
                while e < len(p) and len(run) < m:
                    run, e = run + p[e], e + 1
                if len(run) >= m:
                    where.setdefault(" ".join(run), []).append((i, s, e))
    gone = {}
    for places in where.values():
        first = min(i for i, _, _ in places)
        mine = min(s for i, s, _ in places if i == first)
        for i, s, e in places:
            if i != first or s != mine:
                gone.setdefault(i, set()).update(range(s, e))
    return gone


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(13)
    some = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) + rng.choice([".", "!", "", "?"]) for _ in range(60)]
    rows = [(i, "".join(rng.choice(some) + rng.choice([" ", "\n", "\n\n", "  "]) for _ in range(rng.randint(0, 12)))) for i in rng.sample(range(500), 150)]
    want = brute_dedup(rows, 5)
    got = {r["doc_id"]: {x["unit"] for x in r["removed"]} for r in line_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string"), min_words=5).collect()}
    assert {k: v for k, v in got.items() if v} == want and sum(map(len, want.values())) > 100


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    line = "one two three four five six seven eight nine"
    d = spark.createDataFrame([(1, line), (7, "keep me head\nunique line of as many words as it takes to count"), (7, f"other head\n{line}"), (7, line), (7, line)], "doc_id long, text string")
    assert sorted(r["text"] for r in line_dedup.dedup_units(d).collect()) == ["", "", "keep me head\nunique line of as many words as it takes to count", line, "other head"]


# 9
def test_filters_return_all_languages_and_few_false_hits():
    rng = random.Random(7)
    texts = {k: [" ".join("".join(rng.choice(a) for _ in range(6)) for _ in range(80)) for _ in range(20)] for k, a in (("x", "abcdef"), ("y", "uvwxyz"), ("z", "abcxyz"))}
    f = language.Filters(min_count=1, min_share=0).fit(texts)
    for j, k in enumerate(f.languages):
        for t in texts[k]:
            assert ((f.containing(language.grams(t)[0])[:, 0] >> j) & 1).all()
    foreign = ((f.containing(language.grams("ghijkl mnopqr stghij " * 50)[0])[:, 0]) != 0).mean()
    assert foreign < 0.05 and all(f.predict(t)[0] == k for k in texts for t in texts[k])
    assert f.predict(None) == f.predict("12 !") == ("und", 0.0)


def test_predictions_equal_sets(spark, sf_dir):
    """The same training texts, filters as plain sets: a prediction differs only where a false positive decides."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) != 2)
    rows = [r for r in learn.collect() if r["lang"] is not None and r["text"] is not None]
    rate = {}
    for lang in sorted({r["lang"] for r in rows}):
        n = {}
        for r in rows:
            if r["lang"] == lang:
                for g in language.grams(r["text"])[0].tolist():
                    n[g] = n.get(g, 0) + 1
        rate[lang] = (n, sum(n.values()))
    top = {}
    for n, total in rate.values():
        for g, k in n.items():
            top[g] = max(top.get(g, 0), k / total)
    held = {lang: {g for g, k in n.items() if k >= 2 and k / total >= 0.1 * top[g]} for lang, (n, total) in rate.items()}
    got = {r["doc_id"]: r for r in llm.QUERIES["op9_language"](spark, sf_dir).collect()}
    same = 0
    for r in docs.collect():
        h, letter = language.grams(r["text"] or "")
        want = max(sorted(held), key=lambda x: sum(g in held[x] for g in h.tolist())) if letter else "und"
        same += got[r["doc_id"]]["lang_pred"] == want
    assert same >= 0.995 * docs.count() and all(0 <= r["score"] <= 1 for r in got.values())


def test_fit_takes_the_first_by_the_hash(spark):
    rows = [(i, f"text {i}", "ab"[i % 50 == 0]) for i in range(4000)] + [(None, "x", "a"), (1, None, "a"), (1, "x", None)]
    seen = {}
    fit = language.Filters.fit
    language.Filters.fit = lambda self, texts: seen.update(texts) or fit(self, texts)
    try:
        language.fit_filters(spark.createDataFrame(rows, "id long, text string, lang string"), 30)
    finally:
        language.Filters.fit = fit
    h = {r["id"]: r["h"] >> 11 if r["h"] >= 0 else (r["h"] + (1 << 64)) >> 11 for r in spark.createDataFrame(rows, "id long, text string, lang string").where("id is not null").select("id", F.xxhash64(F.col("id").cast("string")).alias("h")).collect()}
    for lang in "ab":
        want = sorted((h[i], t) for i, t, x in rows if x == lang and t is not None and i is not None)[:30]
        assert sorted(seen[lang]) == sorted(t for _, t in want)


def test_language_on_held_out(spark, sf_dir):
    import pandas as pd

    r = llm.QUERIES["op9_language"](spark, sf_dir).toPandas().merge(pd.read_parquet(f"{sf_dir}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    assert (r[r.held_out].lang_pred == r[r.held_out].lang).mean() > 0.95


# 10
def brute_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints_and_components(spark):
    got = {(r["id"], r["fp"] & (2**64 - 1)) for r in simhash_dedup.fingerprints(odd(spark)).collect()}
    assert got == {(i, brute_fingerprint(t)) for i, t in ODD}


@pytest.mark.parametrize("cap", [32, 2])
@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_close_the_same_components(spark, cap, radius):
    from sievework.operators.components import connected_components

    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:8]:
        x = f
        for _ in range(12):
            x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    d = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["root"] for r in connected_components(simhash_dedup.links_within(d, radius, cap)).collect()}
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    assert all(got.get(x, x) == find(x) for x in signed)


def test_wide_groups_equal_brute_force(spark):
    rng = random.Random(9)
    rows, n = [], 0
    for _ in range(40):
        w = [f"v{rng.randrange(4000)}" for _ in range(300)]
        rows.append((n, " ".join(w)))
        n += 1
        for edits in (1, 3, 12, 40):
            e = list(w)
            for _ in range(edits):
                e[rng.randrange(300)] = f"e{rng.randrange(9999)}"
            rows.append((n, " ".join(e)))
            n += 1
    got = {r["id"]: r["group"] for r in simhash_wide.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [frozenset(simhash_wide.shingle_hashes(t).tolist()) for _, t in rows]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    assert sum(got[i] == find(i) for i in range(n)) >= 0.99 * n


@pytest.mark.parametrize("limits", [{"PLAIN": 0, "PAIRED": 1e9}, {"PLAIN": 0, "PAIRED": 0}, {"HELD": 3}])
def test_every_way_of_pairing_finds_the_links(spark, monkeypatch, limits):
    """Lists verified inside, lists left to the exact join, and lists that no task holds."""
    for k, v in limits.items():
        monkeypatch.setattr(simhash_wide, k, v)
    test_wide_groups_equal_brute_force(spark)


def test_no_triple_stands_twice():
    w = simhash_wide
    assert len({frozenset(x) for x in zip(w._ONE.tolist(), w._SECOND.tolist(), w._THIRD.tolist())}) == w.ALL


def test_short_texts_are_compared_exactly(spark):
    rng, rows = random.Random(14), []
    for _ in range(60):
        w = [f"s{rng.randrange(9999)}" for _ in range(rng.randint(6, 24))]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join([*w, "more"]))]
    got = {r["id"]: r["group"] for r in simhash_wide.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows[::2]:
        n = len(t.split()) - 4
        assert (got[i + 1] == i) == (n / (n + 1) >= 0.8)


def test_wide_groups_inside_a_family(spark):
    """Texts that share boilerplate stand in each other's lists; the copies of the last ones are found nevertheless."""
    rng, n, copies = random.Random(12), 3000, 100
    texts = [[f"b{i}" for i in range(150)] + [f"u{rng.randrange(10**9)}" for _ in range(50)] for _ in range(n)]
    for i in range(copies):
        c = list(texts[n - 1 - i])
        for k in range(4):
            c[150 + 12 * k + rng.randrange(12)] = f"e{rng.randrange(10**9)}"
        texts.append(c)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["id"]: r["group"] for r in simhash_wide.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in range(n))
    assert sum(got[n + i] == n - 1 - i for i in range(copies)) >= 0.97 * copies


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, sf_dir, duck, name):
    assert same_rows(llm.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(llm.ORACLE_SQL[name]).df())


def test_long_lists_of_the_exact_join_are_paired_in_blocks(spark, monkeypatch):
    """of lists of over 65,536 members in the exact join, nothing was paired."""
    from itertools import permutations

    from sievework.llm import simhash_wide as wide

    for name, value in {"HELD": 4, "BLOCK": 3, "FIRST": 1, "TRIPLES": 1}.items():  # one table: pairs come from the exact join
        monkeypatch.setattr(wide, name, value)
    phrase = [[f"{p}{i}" for i in range(10)] for p in "abcd"]
    whole = [sum((phrase[i] for i in order), []) for order in permutations(range(4), 3)]
    texts = [" ".join(t[: len(t) - cut]) for t in whole for cut in (0, 4, 8)]  # 26, 22 and 18 shingles: a chain at 0.82 or more
    sets = [set(wide.shingle_hashes(t).tolist()) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = {i: min(j for j in range(len(texts)) if group[j] == group[i]) for i in range(len(texts))}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["id"]: r["group"] for r in wide.near_groups(d).collect()} == want
    assert 1 < len(set(want.values())) < len(texts)


def test_block_pairs_are_those_of_a_plain_search():
    """F6, without Spark: one block with itself, and two blocks."""
    import numpy as np
    import pyarrow as pa

    from sievework.llm import simhash_wide as wide

    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, 128, dtype=np.uint8)
    fp = [(base ^ (rng.random(128) < 0.2).astype(np.uint8) * rng.integers(0, 256, dtype=np.uint8)).tobytes() for _ in range(150)]
    size, grp = rng.integers(20, 90, 150), rng.integers(0, 40, 150)
    for b2 in (0, 1):
        side = np.sort(rng.integers(0, 2, 150)) * b2
        cols = [np.zeros(150, int), np.zeros(150, int), np.zeros(150, int), np.zeros(150, int), np.full(150, b2), side, grp, np.arange(150), size]
        batch = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(fp)], names=list("abcdefghij"))
        got = {(r["src"], r["dst"]) for t in wide._block_pairs(iter([batch.slice(0, 70), batch.slice(70)]), 60, 0.8) for r in t.to_pylist()}
        far = lambda i, j: sum((x ^ y).bit_count() for x, y in zip(fp[i], fp[j]))
        want = {(i, j) for i in range(150) for j in range(i + 1, 150) if (not b2 or side[i] < side[j]) and grp[i] != grp[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) - 1e-9 and (far(i, j) <= 60 or min(size[i], size[j]) <= wide.SHORT)}
        assert got == want and want

"""Near-duplicate groups by shingle similarity: wide SimHash in the same byte-position index.

At a similarity of 0.8 a 64-bit fingerprint differs in ten bits and no byte is sure to agree, so
texts get 1,024 bits over their distinct five-word shingles. Of 128 byte positions two texts at the
threshold share a third or so; the index posts triples of positional bytes, each position in six
of 256 triples. A pair at 0.81 meets under one with a probability of 0.96, at 0.85 of 0.99, at 0.9 of
all but one in ten thousand. What meets is verified: a pair well inside the distance that the
similarity gives is linked, one well outside goes, and for a pair between the two the shingles
themselves are compared. Sizes that the threshold rules out are never paired.

Near copies are many times most of a family, so links come in two passes. The first posts 16 of the
tables, where members meet their list's smallest and largest class only, and its verified links close
the bulk of large groups of near copies. The second posts all tables with each text's group so far
and pairs every two members of a list that are not in one group yet. A list with more than one such
pair a member shows a family of similar texts: its members are posted once more, with their
fingerprints and in twice as many tables, so that the likeness of all costs no link, and distances
are taken inside the lists, so that only what is near leaves them. A list with over 1,024 pairs
a member (boilerplate, or a corpus so large that unrelated texts share triples) is not paired up; its members go to an exact
join: shingles ordered from rare to common, each text posts the prefix of which two texts at the
threshold must share one shingle, and every two members of different groups there, of sizes that the
threshold allows, are candidates. Short texts, whose few shingles make distances vary widely, take
part in the exact join too. Its own lists of over 65,536 members are dealt into blocks of members of
like size, and every two blocks whose sizes may meet are compared in a task of their own. So no list is
cut: a pair shares a list that is paired, or both take part in the exact join, which pairs every list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from sievework.llm.common import release
from sievework.operators.components import connected_components
from sievework.plans.staging import materialise

BITS, TRIPLES, ALL = 1024, 256, 512
#: Tables of the first pass; buckets of the shingles' frequencies; shingles up to which a text is short.
FIRST, BUCKETS, SHORT = 16, 1 << 20, 32
#: Classes of a block: a task that compares sets holds two blocks.
CELL = 256
#: Pairs a member up to which a list is paired without and with fingerprints; members of a list that a task holds.
PLAIN, PAIRED, HELD = 1, 1024, 1 << 16
#: Members of a block of a longer list of the exact join: a task holds two blocks.
BLOCK = 1 << 15
_BYTES = BITS // 8
_LANES = (np.arange(BITS // 64, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1
_AT = (np.arange(_BYTES) * 256)[None, :]
#: Byte positions of each triple: each 128 with strides of their own, so that no triple stands twice.
_STRIDES = np.array([(37, 91), (11, 70), (5, 47), (23, 61)])
_ONE = np.arange(ALL) % _BYTES
_SECOND, _THIRD = ((_ONE + _STRIDES[np.arange(ALL) // _BYTES, i]) % _BYTES for i in (0, 1))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, k: int = 5) -> np.ndarray:
    """Hashes of the distinct k-word shingles; fewer words: one, of the whole sequence; none: none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.array([*map(xxhash.xxh64_intdigest, words)], dtype=np.uint64)
    k = min(k, len(h))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(out + np.uint64(k)))


def wide_fingerprint(text: str, k: int = 5) -> bytes:
    """1,024 bits: a bit is 1 if set in over half of the shingles' hashes. No words: all zero."""
    return _vote(shingle_hashes(text, k))


def _vote(h: np.ndarray) -> bytes:
    votes = np.zeros((_BYTES, 256), dtype=np.float32)
    for s in range(0, len(h), 1 << 13):
        rows = _mix(h[s : s + (1 << 13), None] + _LANES[None, :]).view(np.uint8)
        votes += np.bincount((rows + _AT).ravel(), minlength=_BYTES * 256).reshape(-1, 256).astype(np.float32)
    return np.packbits((votes @ _SIGNS > 0).ravel()).tobytes()


def radius(similarity: float, errors: float = 0.0) -> int:
    """Bits that two texts of equal length differ in at a Jaccard similarity, plus so many standard errors."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.floor(BITS * p + errors * math.sqrt(BITS * p * (1 - p)))


def _whole_lists(batches: Iterator[pa.RecordBatch], most_held: int) -> Iterator[tuple[pa.Table, bool]]:
    """A stream sorted by its first column, cut anew so that no list (rows of one value) is parted; but
    of a list over most_held members, parts, marked True, of which no two need be in memory together."""
    held: list[pa.RecordBatch] = []
    spilt = None  # the key whose list is given out in parts
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        if spilt is not None:
            same = int(np.searchsorted(key, spilt, side="right"))
            if same:
                yield pa.Table.from_batches([b.slice(0, same)]).combine_chunks(), True
            if same == len(key):
                continue
            b, key, spilt = b.slice(same), key[same:], None
        cut = int(np.searchsorted(key, key[-1]))
        if held and not cut and held[0].column(0)[0].as_py() == key[0]:
            held.append(b)
        else:
            if held or cut:
                yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks(), False
            held = [b.slice(cut)]
        if sum(x.num_rows for x in held) > most_held:
            yield pa.Table.from_batches(held).combine_chunks(), True
            held, spilt = [], key[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), False


def _cross_pairs(batches: Iterator[pa.RecordBatch], bound: float, similarity: float, most: int | None = None, held: int = HELD) -> Iterator[pa.RecordBatch]:
    """(src, dst, key, d) of all members of a list that stand in different groups and whose sizes allow
    the similarity. Rows: key, grp, cid, size and, where distances of up to `most` bits are asked, fp.

    A list with more than bound pairs a member gives (member, null, key, null) instead, a list over
    held members (member, null, key, -1). Rows are sorted by key and grp. With distances, a pair
    comes from the first table that it shares, and from no other.
    """
    names = ["src", "dst", "key", "d"]
    for t, over in _whole_lists(batches, held):
        key, grp, cid, size = (t.column(i).to_numpy() for i in range(4))
        if over:
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.nulls(len(cid), pa.int64()), pa.array(key.astype(np.int64)), pa.array(np.full(len(cid), -1, dtype=np.int32))], names=names)
            continue
        new = np.concatenate([[True], key[1:] != key[:-1]])
        other = np.flatnonzero(new | np.concatenate([[True], grp[1:] != grp[:-1]]))
        starts, at = np.flatnonzero(new), np.arange(len(key))
        members = np.diff(np.append(starts, len(key)))
        ends = np.repeat(starts + members, members)
        after = np.repeat(np.append(other[1:], len(key)), np.diff(np.append(other, len(key))))
        more = ends - after
        long = np.repeat(np.add.reduceat(more, starts) > bound * members, members)
        if long.any():
            yield pa.RecordBatch.from_arrays([pa.array(cid[long]), pa.nulls(int(long.sum()), pa.int64()), pa.array(key[long].astype(np.int64)), pa.nulls(int(long.sum()), pa.int32())], names=names)
        who = at[~long & (more > 0)]
        total = np.cumsum(more[who])
        fp = None if most is None else np.frombuffer(b"".join(t.column(4).to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)
        s = 0
        while s < len(who):
            base = total[s - 1] if s else 0
            e = max(s + 1, int(np.searchsorted(total, base + (1 << 17), side="right")))
            n = more[who[s:e]]
            x = np.repeat(who[s:e], n)
            y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(after[who[s:e]], n)
            fit = np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9
            x, y, d = x[fit], y[fit], None
            if fp is not None:
                d = sum((np.bitwise_count(fp[x, w] ^ fp[y, w]).astype(np.int32) for w in range(BITS // 64)), np.zeros(len(x), dtype=np.int32))
                near = (d <= most) | (np.minimum(size[x], size[y]) <= SHORT)
                x, y, d = x[near], y[near], d[near]
                same = fp[x].view(np.uint8) == fp[y].view(np.uint8)
                first = (same[:, _ONE] & same[:, _SECOND] & same[:, _THIRD]).argmax(axis=1) == key[x] >> 24
                x, y, d = x[first], y[first], d[first]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(cid[x]), pa.array(cid[y]), pa.array(key[x].astype(np.int64)), pa.nulls(len(x), pa.int32()) if d is None else pa.array(d)], names=names)
            s = e
    release()


def _block_pairs(batches: Iterator[pa.RecordBatch], most: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(src, dst, d) of the near pairs of members of different groups in cells of two blocks, or of one.
    Rows: key, size classes and blocks of the cell, side (0 or 1), grp, cid, size, fp; sorted by the first six."""
    cell, held = None, []

    def meet() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        side, grp, cid, size = (t.column(i).to_numpy() for i in range(5, 9))
        fp = np.frombuffer(b"".join(t.column(9).to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)
        one = cell[1] == cell[2] and cell[3] == cell[4]
        parts = [np.flatnonzero(side == 0), np.flatnonzero(side == int(not one))]
        left, right = (p[np.argsort(size[p], kind="stable")] for p in parts)
        sizes = size[right]
        for s in range(0, len(left), 64):
            x = left[s : s + 64]
            low, high = np.searchsorted(sizes, [similarity * size[x[0]] - 1e-9, size[x[-1]] / similarity + 1e-6])
            for r in range(low, high, 1 << 13):
                y = right[r : min(high, r + (1 << 13))]
                d = np.zeros((len(x), len(y)), dtype=np.uint16)
                for w in range(BITS // 64):
                    d += np.bitwise_count(fp[x, w][:, None] ^ fp[y, w][None, :])
                a, b = size[x][:, None], size[y][None, :]
                fit = ((d <= most) | (np.minimum(a, b) <= SHORT)) & (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9) & (grp[x][:, None] != grp[y][None, :])
                if one:
                    fit &= cid[x][:, None] < cid[y][None, :]
                i, j = np.nonzero(fit)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(cid[x[i]]), pa.array(cid[y[j]]), pa.array(d[i, j].astype(np.int32))], names=["src", "dst", "d"])

    for b in batches:
        if not b.num_rows:
            continue
        at = np.stack([b.column(i).to_numpy() for i in range(5)])
        cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            this = tuple(at[:, s].tolist())
            if held and this != cell:
                yield from meet()
                held = []
            cell = this
            held.append(b.slice(s, e - s))
    if held:
        yield from meet()
    release()


def _cells(lists: DataFrame, similarity: float, block: int) -> DataFrame:
    """Rows of _block_pairs from (key, grp, cid, size, fp): members of like size are dealt into blocks, and
    every two blocks of one list whose sizes may meet, or one with itself, make a cell."""
    like = F.col("size").cast("int") if similarity >= 1 else F.floor(F.log(F.greatest("size", F.lit(1))) / -math.log(similarity) + 1e-9).cast("int")
    d = lists.withColumn("g", like)
    per = materialise(d.groupBy("key", "g").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "blocks")
    d = d.join(per, ["key", "g"]).withColumn("i", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rest = ["grp", "cid", "size", "fp"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("j")
    own = d.select("key", "g", "i", *rest, each("blocks"))
    own = own.select("key", F.col("g").alias("g1"), F.col("g").alias("g2"), F.least("i", "j").alias("b1"), F.greatest("i", "j").alias("b2"), (F.col("i") > F.col("j")).cast("int").alias("side"), *rest)
    beside = lambda step: d.join(per.select("key", (F.col("g") - step).alias("g"), F.col("blocks").alias("others")), ["key", "g"]).select("key", "g", "i", *rest, each("others"))
    up = beside(1).select("key", F.col("g").alias("g1"), (F.col("g") + 1).alias("g2"), F.col("i").alias("b1"), F.col("j").alias("b2"), F.lit(0).alias("side"), *rest)
    down = beside(-1).select("key", (F.col("g") - 1).alias("g1"), F.col("g").alias("g2"), F.col("j").alias("b1"), F.col("i").alias("b2"), F.lit(1).alias("side"), *rest)
    cell = ["key", "g1", "g2", "b1", "b2"]
    return own.unionByName(up).unionByName(down).repartition(*cell).sortWithinPartitions(*cell, "side")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, th) of rows with an id; th tells texts of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))


def _grouped_rows(df: DataFrame, id_col: str, text_col: str, similarity: float, shingle: int) -> DataFrame:
    """(id, th, root): one row per row with an id; rows of one near-duplicate group share a root."""
    kind = dict(df.dtypes)[id_col]
    known = _rows(df, id_col, text_col)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_hashes(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([*map(_vote, sets)], type=pa.binary()), pa.array([*map(len, sets)], type=pa.int32())], names=["id", "th", "fp", "size"])
        release()

    d = materialise(known.mapInArrow(prints, f"id {kind}, th long, fp binary, size int"), "wide")
    named = d.groupBy("fp", "size").agg(F.min(F.struct("id", "th")).alias("least")).withColumn("cid", F.monotonically_increasing_id())
    classes = materialise(named, "classes")  # written down, so that the numbers stay

    def post(batches: Iterator[pa.RecordBatch], start: int = 0, stop: int = TRIPLES, with_fp: bool = False) -> Iterator[pa.RecordBatch]:
        table, use = np.arange(stop - start, dtype=np.int64)[None, :] << 24, slice(start, stop)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                f = np.frombuffer(b"".join(part.column(0).to_pylist()), dtype=np.uint8).reshape(-1, _BYTES).astype(np.int64)
                keys = table | f[:, _ONE[use]] | f[:, _SECOND[use]] << 8 | f[:, _THIRD[use]] << 16
                row = pa.array(np.repeat(np.arange(len(f)), stop - start))
                more = [*range(1, part.num_columns), *[0] * with_fp]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *[part.column(c).take(row) for c in more]], names=["key", *[part.schema.names[c] for c in more]])
        release()

    a, b = (classes.select(F.col("cid").alias(n), F.col("fp").alias(f"{n}_fp"), F.col("size").alias(f"{n}_size")) for n in ("src", "dst"))
    sure, most = radius(1 - 0.6 * (1 - similarity)), radius(similarity, 3)

    def distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            x, y = (np.frombuffer(b"".join(r.column(i).to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64) for i in (2, 3))
            d = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32)
            near = (d <= most) | (r.column(4).to_numpy() <= SHORT)
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.array(d)], names=["src", "dst", "d"]).filter(pa.array(near))
        release()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of a stream of cells: of each, the sets of its classes (cell, 0, class, null, set), then its pairs (cell, 1, src, dst, null)."""
        cell, sets = None, {}
        for r in batches:
            found = []
            for c, kind, x, y, raw in zip(*(r.column(i).to_pylist() for i in range(5)), strict=True):
                if c != cell:
                    cell, sets = c, {}
                if kind == 0:
                    sets[x] = np.frombuffer(raw, dtype=np.uint64)
                    continue
                a, b = sets[x], sets[y]
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both >= similarity * (len(a) + len(b) - both) - 1e-9:
                    found.append((x, y))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found]), pa.array([y for _, y in found])], names=["src", "dst"])
        release()

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            yield pa.RecordBatch.from_arrays([r.column(0), pa.array([shingle_hashes(t, shingle).tobytes() for t in r.column(1).to_pylist()], type=pa.binary())], names=["cid", "s"])
        release()

    def texts_of(cids: DataFrame) -> DataFrame:
        """(cid, text) of classes, from their least rows; rows alike give a text several times."""
        least = classes.join(cids, "cid").select("cid", F.col("least.id").alias("l_id"), F.col("least.th").alias("l_th"))
        return known.join(least, (F.col("id") == F.col("l_id")) & (F.col("th") == F.col("l_th"))).select("cid", "text")

    def near(pairs: DataFrame) -> DataFrame:
        """(src, dst, d) of the pairs whose fingerprints are near."""
        return pairs.join(a, "src").join(b, "dst").select("src", "dst", "src_fp", "dst_fp", F.least("src_size", "dst_size")).mapInArrow(distance, "src long, dst long, d int")

    def linked(met: DataFrame) -> DataFrame:
        unsure = met.where(F.col("d") > sure).select("src", "dst")
        asked = materialise(unsure.select(F.col("src").alias("cid")).unionByName(unsure.select(F.col("dst").alias("cid"))).distinct(), "asked")
        sets = materialise(texts_of(asked).mapInArrow(shingles, "cid long, s binary").groupBy("cid").agg(F.min("s").alias("s")), "shingles")
        # Classes are dealt into blocks, pairs into cells of two blocks: a set moves once a cell, not once a pair.
        blocks = max(1, -(-asked.count() // CELL))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
        cell = F.least(block("src"), block("dst")) * blocks + F.greatest(block("src"), block("dst"))
        pairs = unsure.withColumn("cell", cell)
        need = pairs.select("cell", F.col("src").alias("cid")).unionByName(pairs.select("cell", F.col("dst").alias("cid"))).distinct()
        none = F.lit(None)
        held = need.join(sets, "cid").select("cell", F.lit(0).alias("kind"), F.col("cid").alias("src"), none.cast("long").alias("dst"), "s")
        cells = held.unionByName(pairs.select("cell", F.lit(1).alias("kind"), "src", "dst", none.cast("binary").alias("s")))
        exact = cells.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(compare, "src long, dst long")
        return materialise(met.where(F.col("d") <= sure).select("src", "dst").unionByName(exact), "links")

    def ordered(pairs: DataFrame, *more: str) -> DataFrame:
        return pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *more).distinct()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(BUCKETS, dtype=np.int64)
        for r in batches:
            for t in r.column(0).to_pylist():
                np.add.at(count, (shingle_hashes(t, shingle) % np.uint64(BUCKETS)).astype(np.int64), 1)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["bucket", "n"])
        release()

    def prefixes(often: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in batches:
                for at in range(r.num_rows):
                    h = shingle_hashes(r.column(2)[at].as_py(), shingle)
                    if not len(h):
                        continue
                    rare = h[np.lexsort((h, often[(h % np.uint64(BUCKETS)).astype(np.int64)]))]
                    key = rare[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1].view(np.int64)
                    row = pa.array(np.full(len(key), at))
                    yield pa.RecordBatch.from_arrays([pa.array(key), r.column(1).take(row), r.column(0).take(row), pa.array(np.full(len(key), len(h), dtype=np.int32))], names=["key", "grp", "cid", "size"])
            release()

        return run

    def lists(posts: DataFrame) -> DataFrame:
        return posts.repartition("key").sortWithinPartitions("key", "grp")

    out, held, block = "src long, dst long, key long, d int", HELD, BLOCK
    once = classes.select("fp", "cid").mapInArrow(lambda x: post(x, 0, FIRST), "key long, cid long")
    ends = materialise(once.groupBy("key").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low <> high"), "ends")
    met = once.join(ends, "key")
    stars = met.select(F.col("cid").alias("src"), F.col("low").alias("dst")).unionByName(met.select(F.col("cid").alias("src"), F.col("high").alias("dst"))).where("src <> dst")
    first = linked(materialise(near(ordered(stars)), "met"))
    so_far = connected_components(first).select(F.col("node").alias("cid"), F.col("root"))
    grouped = materialise(classes.join(so_far, "cid", "left").select("fp", F.coalesce("root", "cid").alias("grp"), "cid", "size"), "grouped")
    posts = grouped.mapInArrow(post, "key long, grp long, cid long, size int")
    found = materialise(lists(posts).mapInArrow(lambda x: _cross_pairs(x, PLAIN, similarity, held=held), out), "pairs")
    crowded = found.where("dst is null and d is null").select(F.col("src").alias("cid")).distinct()
    family = materialise(grouped.join(crowded, "cid", "left_semi").select(*grouped.columns).repartition("cid"), "family")
    again = family.mapInArrow(lambda x: post(x, 0, ALL, True), "key long, grp long, cid long, size int, fp binary")
    inside = materialise(lists(again).mapInArrow(lambda x: _cross_pairs(x, PAIRED, similarity, most, held), out), "inside")
    left = found.where("dst is null and d is not null").unionByName(inside.where("dst is null")).select(F.col("src").alias("cid"))
    exact = left.unionByName(classes.where(F.col("size").between(1, SHORT)).select("cid")).distinct()
    long = materialise(texts_of(exact).join(grouped.select("cid", "grp"), "cid").select("cid", "grp", "text").dropDuplicates(["cid"]), "long")
    often, counts = np.zeros(BUCKETS, dtype=np.int64), long.select("text").mapInArrow(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    often[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    exact_pairs = materialise(lists(long.mapInArrow(prefixes(often), "key long, grp long, cid long, size int")).mapInArrow(lambda x: _cross_pairs(x, math.inf, similarity, held=held), out), "exact")
    longest = exact_pairs.where("dst is null").select("key", F.col("src").alias("cid"))
    pairs = ordered(found.where("dst is not null").unionByName(exact_pairs.where("dst is not null")))
    met = near(pairs).unionByName(ordered(inside.where("dst is not null"), "d")).distinct()  # short lists hold family too
    if longest.limit(1).count():  # lists that no task holds
        cells = _cells(longest.join(grouped, "cid").select("key", "grp", "cid", "size", "fp"), similarity, block)
        met = met.unionByName(ordered(cells.mapInArrow(lambda x: _block_pairs(x, most, similarity), "src long, dst long, d int"), "d")).distinct()
    links = first.unionByName(linked(materialise(met, "met")))
    comps = connected_components(links).select(F.col("node").alias("cid"), "root")
    roots = classes.join(comps, "cid", "left").select("fp", "size", F.coalesce("root", "cid").alias("root"))
    return d.join(roots, ["fp", "size"]).select("id", "th", "root")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(id, group): group is the smallest id that near-duplicate links reach; one row per row.

    Null and empty texts are copies of each other. Rows that share an id keep a row each, by their own
    texts. Null ids take no part. Columns other than the two named play no part.
    """
    rows = materialise(_grouped_rows(df, id_col, text_col, similarity, shingle), "rows")
    return rows.join(rows.groupBy("root").agg(F.min("id").alias("group")), "root").select("id", "group")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """df without near duplicates: of each group the row with the smallest id stays.

    Rows that share an id are rows like others: the smallest hash of the text decides between them, and
    of rows alike in id and text the one whose columns have the smallest hash stays. Rows with a null id
    stay. All columns pass, whatever their names.
    """
    rows = materialise(_grouped_rows(df, id_col, text_col, similarity, shingle), "rows")
    stays = rows.groupBy("root").agg(F.min(F.struct("id", "th")).alias("stays"))
    gone = materialise(rows.join(stays, "root").where(F.struct("id", "th") != F.col("stays")).select(F.col("id").alias("__sievework_id"), F.col("th").alias("__sievework_th")).distinct(), "gone")
    th = F.xxhash64(F.coalesce(df[text_col], F.lit("")))
    kept = df.join(gone, (df[id_col] == gone["__sievework_id"]) & (th == gone["__sievework_th"]), "left_anti")
    if rows.groupBy("id", "th").count().where("count > 1").limit(1).count():  # rows alike in id and text
        nulls, kept = kept.where(F.col(id_col).isNull()), kept.where(F.col(id_col).isNotNull())
        alike = Window.partitionBy(id_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).orderBy(F.xxhash64(*[F.col(c) for c in df.columns if not dict(df.dtypes)[c].startswith("map")]))
        kept = kept.withColumn("__sievework_n", F.row_number().over(alike)).where("__sievework_n = 1").drop("__sievework_n").unionByName(nulls)
    return kept

"""Document fingerprints: SimHash over weighted terms, searched through permuted block tables.

Terms are runs of two words, weighted 1 + ln(count). Each term's hash gives 256 signed votes; the
sign of a bit's sum is the bit. For a search within r bits the fingerprint is cut into r + c blocks,
of which c at least are untouched by r differing bits; a table per choice of c blocks, with these
moved to the front as the key, holds every fingerprint, so the tables meet every pair. c is the
least for which few unrelated fingerprints share a key: more fingerprints get longer keys and more
tables, and the same answer. A pair that meets in several tables counts in the first alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sievework.llm.common import documents, release
from sievework.plans.staging import materialise

BITS = 256
_LANES = (np.arange(BITS // 64, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1
_AT = (np.arange(BITS // 8) * 256)[None, :]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def simhash256(text: str) -> bytes:
    """32 bytes; no words: all zero. Votes are counted per byte value, then spread to bits."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(BITS // 8)
    h = np.array([*map(xxhash.xxh64_intdigest, words)], dtype=np.uint64)
    if len(h) > 1:
        h = _mix(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:])
    terms, count = np.unique(h, return_counts=True)
    weight = 1 + np.log(count)
    votes = np.zeros((BITS // 8, 256))
    for s in range(0, len(terms), 1 << 14):
        rows = _mix(terms[s : s + (1 << 14), None] + _LANES[None, :]).view(np.uint8)
        votes += np.bincount((rows + _AT).ravel(), np.repeat(weight[s : s + (1 << 14)], BITS // 8), BITS // 8 * 256).reshape(-1, 256)
    return np.packbits((votes @ _SIGNS > 0).ravel()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down, in code points) replaced by as much of following's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc_id, text, fp, nxt, nxt_fp) -> tuple:
    new = edited(text, nxt)
    new_fp = simhash256(new)
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fp.hex(), new_fp.hex(), likeness(fp, new_fp), likeness(fp, nxt_fp))


_COLUMNS = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprint_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edit with the next document's start, and their likeness.

    Next goes by ascending id, then text; null ids first; after the last comes the first; a lone
    document follows itself. Null texts count as empty. One shuffle by ranges of the id carries the
    texts; each task streams its sorted range with one document in hand, and what a range cannot
    know, the document after its last, is settled from two edge rows a range.
    """
    kind = dict(df.dtypes)[id_col]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edge", "part", "text"]
    numbers = {"n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64(), "edge": pa.int32(), "part": pa.int32()}

    def batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, type=id_type if n == "doc_id" else numbers.get(n, pa.string())) for n, c in zip(names, cols, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, id_type = TaskContext.get().partitionId(), None, None
        for b in batches:
            rows, id_type = [], b.schema.field(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                now = (doc_id, text or "", simhash256(text or ""))
                if held is None:
                    rows.append((doc_id, None, None, now[2].hex(), None, None, None, 0, part, now[1]))
                else:
                    rows.append((*_row(*held, now[1], now[2]), None, part, None))
                held = now
            if rows:
                yield batch(rows, id_type)
        if held is not None:
            yield batch([(held[0], None, None, held[2].hex(), None, None, None, 1, part, held[1])], id_type)
        release()

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                rows.append((*_row(r["doc_id"], r["text"], bytes.fromhex(r["fp"]), r["next_text"], bytes.fromhex(r["next_fp"])), None, 0, None))
            if rows:
                yield batch(rows, b.schema.field(0).type)
        release()

    dealt = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = f"doc_id {kind}, {_COLUMNS}, edge int, part int, text string"
    done = materialise(dealt.mapInArrow(run, schema), "fingerprints")
    first = done.where("edge = 0").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp"))
    order = Window.orderBy("part")  # one row for each range, without texts
    parts = first.select("part").withColumn("following", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())))
    last = done.where("edge = 1").select("doc_id", "text", F.col("fingerprint").alias("fp"), "part")
    joined = last.join(parts, "part").join(first.withColumnRenamed("part", "following"), "following").select("doc_id", "text", "fp", "next_text", "next_fp")
    rest = materialise(joined.mapInArrow(close, schema), "closed")
    keep = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return done.where("edge is null").select(*keep).unionByName(rest.select(*keep))


def _longs(column: str):
    """The four 64-bit words of a hex fingerprint, from two halves each so that none overflows."""
    half = lambda at: F.conv(F.substring(column, at, 8), 16, 10).cast("long")
    return F.array(*[F.shiftleft(half(16 * i + 1), 32).bitwiseOR(half(16 * i + 9)) for i in range(4)])


#: Bits within which op5 looks for other fingerprints: about one edited word in three hundred.
RADIUS = 12
#: Rows of a search's own postings up to which they are broadcast.
FEW_POSTS = 200_000


#: Tables that a search may take; a wide radius over many fingerprints then meets more unrelated ones.
MOST_TABLES = 1_000


def plan(radius: int, n: int, few: float = 8.0) -> list[tuple[tuple[int, int], ...]]:
    """Tables complete for the radius: per table the (first bit, bits) of its blocks.

    With the least number of whole blocks for which a fingerprint meets, over all tables, at most
    `few` of n unrelated ones; or else the largest number that needs no more than MOST_TABLES.
    """
    if not 0 <= radius < BITS:
        raise ValueError(f"a radius of 0 to {BITS - 1} bits")
    whole = 1
    while (
        n * math.comb(radius + whole, whole) > few * 2.0 ** (whole * (BITS // (radius + whole)))
        and radius + whole < BITS and math.comb(radius + whole + 1, whole + 1) <= MOST_TABLES
    ):
        whole += 1
    cuts = [BITS * i // (radius + whole) for i in range(radius + whole + 1)]
    return [*combinations([(s, e - s) for s, e in zip(cuts, cuts[1:])], whole)]


def _block(words, start: int, bits: int):
    """Bits start to start + bits of four 64-bit words, as a long; a block may stand in two or more words."""
    parts = []
    while bits:
        i, at = divmod(start, 64)
        n = min(bits, 64 - at)
        part = F.shiftrightunsigned(words[i], 64 - at - n)
        parts.append((part.bitwiseAND(F.lit((1 << n) - 1)) if n < 64 else part, n))
        start, bits = start + n, bits - n
    return parts


def _same(a, b, blocks) -> object:
    """Whether two fingerprints agree on all the blocks."""
    test = F.lit(True)
    for block in blocks:
        for (x, _), (y, _) in zip(_block(a, *block), _block(b, *block)):
            test = test & (x == y)
    return test


def links(fps: DataFrame, radius: int = RADIUS, of: DataFrame | None = None) -> DataFrame:
    """(src, dst, distance) for all distinct fingerprints within radius bits of each other.

    fps: a column fingerprint of 64 hex digits; nulls take no part, repeated ones count once. Without
    `of` every pair stands once, src < dst. With `of`, a table of the same column, src runs over its
    fingerprints and dst over those of fps other than src. An empty table has no links.
    """
    words = [f"w{i}" for i in range(4)]

    def numbered(df: DataFrame) -> DataFrame:
        d = df.where("fingerprint is not null").select("fingerprint").distinct().withColumn("w", _longs("fingerprint"))
        return d.select("fingerprint", *[F.element_at("w", i + 1).alias(x) for i, x in enumerate(words)])

    unique = materialise(numbered(fps).withColumn("n", F.monotonically_increasing_id()), "blocks")  # written down, so that the numbers stay
    rows = unique.count()
    tables = plan(radius, rows)
    key = lambda t: F.xxhash64(F.lit(t), *[x for block in tables[t] for x, _ in _block([F.col(w) for w in words], *block)])
    post = lambda df: df.select("n", *words, F.posexplode(F.array(*[key(t) for t in range(len(tables))])).alias("t", "key"))
    asked = unique if of is None else unique.join(of.select("fingerprint").distinct(), "fingerprint")
    a = post(asked).select("key", "t", F.col("n").alias("src"), *[F.col(w).alias(f"a_{w}") for w in words])
    b = post(unique).select("key", F.col("n").alias("dst"), *[F.col(w).alias(f"b_{w}") for w in words])
    x, y = ([F.col(f"{s}_{w}") for w in words] for s in "ab")
    if of is not None and asked.count() * len(tables) <= FEW_POSTS:
        a = F.broadcast(a)  # so many rows at most; a larger search is dealt out by key
    other = F.col("src") < F.col("dst") if of is None else F.col("src") != F.col("dst")
    apart = sum(F.bit_count(p.bitwiseXOR(q)) for p, q in zip(x, y))
    first = F.coalesce(*[F.when(_same(x, y, blocks), F.lit(t)) for t, blocks in enumerate(tables)])
    met = b.join(a, (a["key"] == b["key"]) & other & (apart <= radius)).where(F.col("t") == first).select("src", "dst", apart.alias("distance"))
    names = unique.select("n", "fingerprint")
    found = met.join(names.select(F.col("n").alias("src"), F.col("fingerprint").alias("s")), "src").join(names.select(F.col("n").alias("dst"), F.col("fingerprint").alias("d")), "dst").select("s", "d", "distance")
    if of is None:  # by number each pair came once; by name the lesser is src
        return found.select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst"), "distance")
    return found.select(F.col("s").alias("src"), F.col("d").alias("dst"), "distance")


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: class_id, the smallest id with this fingerprint, and n_near: for the
    search's queries, the rows whose id is divisible by 20, how many other distinct fingerprints of all
    rows lie within the radius; null for other rows."""
    found = fingerprint_with_next(documents(spark, sf_dir))
    query = F.col("doc_id") % 20 == 0
    near = links(found, of=found.where(query)).groupBy(F.col("src").alias("fingerprint")).agg(F.count("*").alias("n_near"))
    classes = found.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")).join(near, "fingerprint", "left")
    return found.join(classes, "fingerprint").select(*found.columns, "class_id", F.when(query, F.coalesce("n_near", F.lit(0))).alias("n_near"))

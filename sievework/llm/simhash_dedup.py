"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint of B/8 bytes posts under (byte position, value). Two fingerprints that differ in at
most d bits differ in at most d bytes, so they share at least B/8 - d positional bytes: the
guaranteed minimum. Posting single bytes would give lists of a 256th of the corpus, so the index
posts composites of positional bytes that the guarantee keeps complete: of four byte pairs at most
two can hold a difference of d <= 2 bits, hence two whole pairs agree, and the six choices of two
pairs (four bytes, 2^32 values each) meet every pair within reach. For each pair that meets, shared
positional bytes are tallied, pairs under the minimum go, and the rest are verified bit by bit.

A posting list longer than list_cap (one huge family of near copies) is not paired up. Its
fingerprints go to an exact second way: each posts itself and its 64 one-bit variants. Two
fingerprints lie within two bits exactly when they share a variant, all members of a variant are
within two bits of each other, and a variant has at most 65 members, so a star per variant gives
the same components without a pair more.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sievework.llm.common import documents, map_texts
from sievework.operators.components import connected_components
from sievework.plans.staging import materialise

CHUNK = 1 << 15


def shingle_slices(words: list[bytes], k: int) -> list[bytes]:
    """Space-joined k-word shingles, repeats included; fewer words: the whole sequence; none: []."""
    if not words:
        return []
    whole = b" ".join(words)
    if len(words) <= k:
        return [whole]
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends + 1 - size)[: len(words) - k + 1].tolist()
    return [whole[s:e] for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)]


def fingerprint64(text: str, k: int = 3) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if set in over half of the shingles' XXH64 (seed 42)."""
    parts = shingle_slices(text.encode("utf-8", "surrogatepass").lower().split(), k)
    if not parts:
        return 0
    votes = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(parts), CHUNK):
        rows = np.frombuffer(b"".join([digest(p, 42) for p in parts[at : at + CHUNK]]), dtype=np.uint8).reshape(-1, 8)
        votes += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(parts)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long): the signed form of each text's 64-bit SimHash. A null text counts as empty."""

    def make():
        def fn(ids, texts):
            fps = np.array([fingerprint64(t, shingle) for t in texts], dtype=np.uint64)
            return [pa.array(fps.view(np.int64))]

        return fn

    kind = dict(df.dtypes)[id_col]
    return map_texts(df, make, id_col, text_col, f"id {kind}, fp long", ["id", "fp"], [pa.int64()])


def _shared_bytes(x, y):
    d = x.bitwiseXOR(y)
    return sum(((F.shiftrightunsigned(d, 8 * j).bitwiseAND(F.lit(255))) == 0).cast("int") for j in range(8))


def links_within(fps: DataFrame, radius: int = 2, list_cap: int = 32) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints (column fp, 64 bits) within radius bits.

    radius is 0, 1 or 2. Every two fingerprints within it end in one component of the edges; no
    edge joins fingerprints farther apart. Edges from short lists are all the links there; long
    lists give stars. Null fingerprints take no part.
    """
    if radius not in (0, 1, 2):
        raise ValueError("the composites are complete for a radius of 0 to 2 bits")
    need = 8 - radius
    pair = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = F.array(*[
        F.lit(t << 32).bitwiseOR(F.shiftleft(pair[a], 16)).bitwiseOR(pair[b]) for t, (a, b) in enumerate(combinations(range(4), 2))
    ])
    unique = materialise(fps.where("fp is not null").select("fp").distinct(), "fps")
    posts = unique.select("fp", F.explode(keys).alias("key"))
    sizes = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(posts.join(sizes, "key"), "postings")
    lists = met.where(F.col("n") <= list_cap).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("l"))
    close = lambda x, y: (_shared_bytes(x, y) >= need) & (F.bit_count(x.bitwiseXOR(y)) <= radius)
    pairs = F.flatten(F.transform("l", lambda x: F.transform(F.filter("l", lambda y: (y > x) & close(x, y)), lambda y: F.struct(x.alias("src"), y.alias("dst")))))
    near = lists.select(F.explode(pairs).alias("p")).select("p.src", "p.dst")
    hot = met.where(F.col("n") > list_cap).select("fp").distinct()
    if radius == 2:
        own = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
        stars = hot.select("fp", F.explode(own).alias("v")).groupBy("v").agg(F.collect_set("fp").alias("l")).where("size(l) > 1")
        star = stars.select(F.array_min("l").alias("src"), F.explode("l").alias("dst")).where("src <> dst")
    else:
        flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
        probe = hot.select(F.col("fp").alias("src"), F.explode(flips).alias("dst")).where("src < dst")
        star = probe.join(hot.select(F.col("fp").alias("dst")), "dst", "left_semi").select("src", "dst").where(F.lit(radius == 1))
    return near.unionByName(star)


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, list_cap: int = 32) -> DataFrame:
    """(id, fp, component): the component is the smallest id reachable over links of radius bits.

    Rows: one per input row. Null and empty texts share fingerprint zero and link like any other.
    Rows that share an id keep a row each; a null id is never the smallest unless it is alone, and
    then the component is null. Extra columns, whatever their names, are left out.
    """
    d = materialise(fingerprints(df, id_col, text_col, shingle), "docs")
    classes = d.groupBy("fp").agg(F.min("id").alias("first_id"))
    comps = connected_components(links_within(d, radius, list_cap)).select(F.col("node").alias("fp"), "root")
    rooted = materialise(classes.join(comps, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classes")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return d.join(named, "fp").select("id", "fp", "component")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component; null texts are empty, and all texts without words are linked."""
    found = near_components(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))

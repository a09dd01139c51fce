"""Connected components by alternating large-star and small-star steps.

No step gathers a component: each round is two grouped minima (combined map-side) and two
equi-joins, so a node with very many neighbours is only a skewed join key, which adaptive
execution splits. Rounds grow with the logarithm of the component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievework.plans.staging import discard, materialise


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum((F.xxhash64("u", "v") % F.lit(1 << 40))).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node it reaches.

    Self-loops and rows with a null end are ignored; repeated edges count once. Node values need
    an order (numbers or strings). Raises RuntimeError if max_rounds pass without a fixed point.
    """
    e = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where((F.col(src) != F.col(dst)) & F.col(src).isNotNull() & F.col(dst).isNotNull())
        .distinct()
    )
    e = materialise(e, "edges")
    before = _summary(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(floor.select("u", F.col("m").alias("v"))).distinct()
        )
        last, e = e, materialise(small, "edges")
        discard(last)
        after = _summary(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

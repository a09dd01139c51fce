"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame operations only.

Targets fill the sources by weight up to `limit` times their size. Each source is cut, in a hashed
order of its documents, into blocks of as many words each. Slots 0, 1, 2, ... map to the points
(slot * golden) mod 2^31, a Weyl sequence by the golden ratio in whole numbers, so that reruns and
engines agree; a point falls into one source's interval of the cumulative demand for blocks. A
slot's rank within its source names its block: rank mod blocks, on pass rank div blocks.

Nothing numbers a source in one task: ranks and word offsets run inside chunks of slots and hashed
ranges of documents, whose few totals are then accumulated per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sievework.llm.common import documents
from sievework.plans.staging import materialise

WEIGHTS, LIMIT, BLOCK = (5, 2, 1), 3, 32
#: Odd, and 2^31 / golden ratio to the nearest such number.
GOLDEN, PERIOD = 1327217885, 1 << 31
WORD = r"[^\x20\x09-\x0D]+"
_CHUNK, _BIN, _RANGE = 1 << 16, 1 << 19, 20_000


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """(doc_id, source, size, h, th): words of the text, null text 0; h orders a source's documents."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary")).alias("h"), F.xxhash64(text).alias("th"),
    )


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """One row per source: src (its place by code point, null last), source_size, target, b, blocks, lo, hi.

    b words make a block, the last perhaps fewer. [lo, hi) is its interval of points. A source
    without words has target 0 and no interval. The windows see one row per source.
    """
    every = Window.partitionBy()
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("src", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long"))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights)).cast("int") + 1))
    per = per.withColumn("cap", limit * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    line = Window.orderBy("ratio", "src")
    per = per.withColumn("pos", F.row_number().over(line)).withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        / F.sum("w").over(line.rowsBetween(0, Window.unboundedFollowing)),
    )
    free = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("pos", "level"))).over(every)
    per = per.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("w") * free["level"]), F.col("cap").cast("double")))
    some = F.col("source_size") > 0
    wanted = F.greatest(F.lit(1), F.round(F.col("source_size") / block).cast("long"))
    per = per.withColumn("b", F.when(some, F.ceil(F.col("source_size") / wanted)).otherwise(1).cast("long"))
    per = per.withColumn("blocks", F.ceil(F.col("source_size") / F.col("b")).cast("long"))
    per = per.withColumn("milli", F.when(some, F.round(1000 * F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long"))
    run, total = F.sum("milli").over(Window.orderBy("src")), F.sum("milli").over(every)
    edge = lambda c: F.floor(c / total * PERIOD).cast("long")
    return per.withColumn("demand", total).withColumn("hi", F.when(run == total, F.lit(PERIOD)).otherwise(edge(run))).withColumn(
        "lo", F.when(total > 0, edge(run - F.col("milli"))).otherwise(F.col("hi"))
    ).select("src", "source", "source_size", "target", "b", "blocks", "lo", "hi", "demand")


def schedule(spark, plan: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(slot, src, rank, block, pass): the mixture's order. Ranks past `limit` passes are left out."""
    demand = plan.agg(F.max("demand")).first()[0] or 0
    slots = spark.range(0, -(-demand // 1000)).select(F.col("id").alias("slot"), ((F.col("id") % PERIOD) * GOLDEN % PERIOD).alias("p"))
    bins = plan.where("hi > lo").select("src", "lo", "hi", "blocks", F.explode(F.sequence(F.expr(f"lo div {_BIN}"), F.expr(f"(hi - 1) div {_BIN}"))).alias("bin"))
    drawn = slots.withColumn("bin", F.expr(f"p div {_BIN}")).join(bins, "bin").where("p >= lo and p < hi")
    drawn = materialise(drawn.select("slot", F.expr(f"slot div {_CHUNK}").alias("chunk"), "src", "blocks"), "slots")
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = drawn.groupBy("src", "chunk").agg(F.count("*").alias("n")).select("src", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("inside", inside).join(offsets, ["src", "chunk"]).withColumn("rank", F.col("before") + F.col("inside"))
    return ranked.where(F.col("rank") < limit * F.col("blocks")).select("slot", "src", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.expr("rank div blocks").alias("pass"))


def placed(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents with src, target, b and start: the words before them in their source's hashed order."""
    n = sizes.count()
    ranges = max(1, -(-n // _RANGE))
    d = sizes.join(plan.select("source", "src", "source_size", "target", "b"), sizes["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    d = d.withColumn("r", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("long"))
    line = lambda *by: Window.partitionBy("src", *by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy("src", "r").agg(F.sum("size").alias("n")).select("src", "r", F.coalesce(F.sum("n").over(line(["r"])), F.lit(0)).alias("before"))
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(line("r", ["h", "doc_id", "size", "th"])), F.lit(0)))
    return d.join(offsets, ["src", "r"]).withColumn("start", F.col("before") + F.col("inside"))


def mix(df: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, th, source, size, source_size, target, taken), one row per row.

    taken: the words of the document that the schedule's blocks hold, repeats counted, at most limit
    times its size. Texts that are null or have no word have size and taken 0. A null source is a
    source. Rows alike in every column are placed one after another. Columns other than the three
    named play no part.
    """
    spark = df.sparkSession
    sizes = materialise(sized(df, id_col, text_col, source_col), "sizes")
    plan = materialise(targets(sizes, weights, limit, block), "targets")
    uses = schedule(spark, plan, limit).groupBy("src", "block").agg(F.count("*").alias("uses"))
    docs = placed(sizes, plan)
    keys = ["src", "start", "doc_id", "th", "size"]
    pieces = docs.where("size > 0").select(*keys, "b", F.explode(F.sequence(F.expr("start div b"), F.expr("(start + size - 1) div b"))).alias("block"))
    cut = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("b")) - F.greatest(F.col("start"), F.col("block") * F.col("b"))
    taken = pieces.withColumn("words", cut).join(uses, ["src", "block"]).groupBy(*keys).agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    part = docs.select(*keys, "source", "source_size", "target")
    t = taken.select(*[F.col(k).alias(f"t_{k}") for k in keys], "taken")
    same = (part["src"] == t["t_src"]) & (part["start"] == t["t_start"]) & (part["size"] == t["t_size"]) & part["doc_id"].eqNullSafe(t["t_doc_id"]) & (part["th"] == t["t_th"])
    return part.join(t, same, "left").select("doc_id", "th", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op2_mixture(spark, sf_dir: str) -> DataFrame:
    """How many words the mixture takes of every document; null texts and those without words give none."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


#: The same mixture for DuckDB: its windows may number a source at once.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR || ':0') AS h FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[src % 3 + 1] AS w, {LIMIT} * source_size AS cap FROM per
), levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, src) AS pos,
    ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
      / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), filled AS (
  SELECT *, coalesce(least(cap::DOUBLE, w * (SELECT arg_min(level, pos) FROM levels WHERE cap / w > level)), cap::DOUBLE) AS target FROM levels
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN ceil(source_size / greatest(1, round(source_size / {BLOCK}))) ELSE 1 END::BIGINT AS b FROM filled
), counted AS (
  SELECT *, ceil(source_size / b)::BIGINT AS blocks FROM cut
), asked AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(1000 * target * blocks / source_size) ELSE 0 END::BIGINT AS milli FROM counted
), summed AS (
  SELECT *, (sum(milli) OVER (ORDER BY src))::BIGINT AS run, (sum(milli) OVER ())::BIGINT AS total FROM asked
), plan AS (
  SELECT *, CASE WHEN run = total THEN {PERIOD} ELSE floor(run / total * {PERIOD})::BIGINT END AS hi, floor((run - milli) / total * {PERIOD})::BIGINT AS lo FROM summed
), slots AS (
  SELECT i AS slot, (i % {PERIOD}) * {GOLDEN} % {PERIOD} AS p FROM range((SELECT CAST(ceil(max(total) / 1000.0) AS BIGINT) FROM plan)) t(i)
), ranked AS (
  SELECT src, blocks, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank FROM slots JOIN plan ON p >= lo AND p < hi
), uses AS (
  SELECT src, rank % blocks AS block, count(*) AS uses FROM ranked WHERE rank < {LIMIT} * blocks GROUP BY ALL
), placed AS (
  SELECT d.*, src, source_size, target, b, coalesce(sum(size) OVER (PARTITION BY src ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source
), pieces AS (
  SELECT doc_id, src, start, size, b, unnest(range(start // b, (start + size - 1) // b + 1)) AS block FROM placed WHERE size > 0
), taken AS (
  SELECT doc_id, src, start, sum((least(start + size, (block + 1) * b) - greatest(start, block * b)) * uses)::BIGINT AS taken FROM pieces JOIN uses USING (src, block) GROUP BY ALL
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN taken USING (doc_id, src, start)
"""

"""Reports: each a DataFrame computed from rows; a figure that cannot be computed is null."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sievework.operators.filters import EMPTY
from sievework.operators.rows import KEY, OCC, ORIGIN, SOURCE, SPLIT, Refused, as_text, content_text, ngrams, rank_within, word_count, words
from sievework.plans.staging import materialise


#: Distribution function of the Poisson weight of mean 1, up to 10.
_POISSON = np.cumsum([exp(-1) / factorial(k) for k in range(11)])


def value_of(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(EMPTY)) if column in df.columns else F.lit(EMPTY)


def cross_tab(df: DataFrame, columns: list[str], limit: int = 2_000) -> DataFrame:
    """Rows per split and combination of one to four columns, the largest first; an absent column is null."""
    if not 1 <= len(columns) <= 4:
        raise Refused("params_invalid")
    cols = [F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return df.select(SPLIT, *cols).groupBy(SPLIT, *columns).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), SPLIT, *columns).limit(limit)


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The n most frequent values (ties by value) and the rest as one line with a null value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows"))
    top = counts.orderBy(F.desc("rows"), "value").limit(n)
    total, seen = counts.agg(F.sum("rows").alias("t")), top.agg(F.sum("rows").alias("s"))
    other = total.crossJoin(seen).select(F.lit(None).cast("string").alias("value"), (F.col("t") - F.coalesce("s", F.lit(0))).alias("rows")).where("rows > 0")
    return top.unionByName(other)


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: rows, nulls, empty strings, distinct values, mean length. One pass over the data."""
    columns = columns or df.columns
    aggs = []
    for c in columns:
        x, s = F.col(c), F.col(c).cast("string")
        aggs += [F.count(F.when(x.isNull(), 1)).alias(f"{c}__nulls"), F.count(F.when(s == "", 1)).alias(f"{c}__empty"), F.countDistinct(x).alias(f"{c}__distinct"), F.avg(F.length(s)).alias(f"{c}__mean")]
    one = df.agg(F.count("*").alias("__rows"), *aggs)
    lines = [F.struct(F.lit(c).alias("column"), F.col("__rows").alias("rows"), F.col(f"{c}__nulls").alias("nulls"), F.col(f"{c}__empty").alias("empty"), F.col(f"{c}__distinct").alias("distinct_values"), F.round(f"{c}__mean", 6).alias("mean_length")) for c in columns]
    return one.select(F.explode(F.array(*lines)).alias("l")).select("l.*")


def quantiles(df: DataFrame, column: str, points: list[float], by: list[str] | None = None) -> DataFrame:
    """Interpolated quantiles, one row per point (and group)."""
    q = df.groupBy(*(by or [])).agg(F.percentile(column, F.array(*[F.lit(p) for p in points])).alias("q"))
    return q.select(*(by or []), F.posexplode("q").alias("i", "value")).select(*(by or []), F.element_at(F.array(*[F.lit(p) for p in points]), F.col("i") + 1).alias("point"), "value")


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts of equal bins over [low, high]; the top edge belongs to the last bin; outside counts nowhere."""
    edges = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    edges = edges.select(F.lit(low).cast("double").alias("lo") if low is not None else F.col("lo"), F.lit(high).cast("double").alias("hi") if high is not None else F.col("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edges)).where((F.col(column) >= F.col("lo")) & (F.col(column) <= F.col("hi"))).groupBy(b.alias("bin")).agg(F.count("*").alias("rows"))  # edges: one row


def version_profile(df: DataFrame, content: list[str]) -> DataFrame:
    """Counts by split, source and origin; and of rows whose key stands more than once."""
    parts = [df.groupBy(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("rows")) for c in (SPLIT, SOURCE, ORIGIN)]
    dup = df.groupBy(KEY).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("r"))
    parts.append(dup.select(F.lit("exact_duplicate_groups").alias("what"), F.lit(None).cast("string").alias("value"), F.col("groups").alias("rows")))
    parts.append(dup.select(F.lit("exact_duplicate_rows").alias("what"), F.lit(None).cast("string").alias("value"), F.col("r").alias("rows")))
    return reduce(DataFrame.unionByName, parts)


def turns_by_role(df: DataFrame, column: str = "messages") -> DataFrame:
    return df.select(F.explode(column).alias("m")).groupBy(F.col("m.role").alias("role")).agg(F.count("*").alias("turns"))


def coverage(df: DataFrame) -> DataFrame:
    """Rows, distinct keys, keys with copies, rows of such keys."""
    return df.groupBy(KEY).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated_keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_rows"))


def copies_disagree(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the keys whose copies hold different values, a null beside a value included."""
    aggs = [F.coalesce((F.countDistinct(c) > 1) | ((F.count(c) > 0) & (F.count(c) < F.count("*"))), F.lit(False)).alias(c) for c in columns]
    per = df.groupBy(KEY).agg(*aggs)
    one = per.agg(*[F.count(F.when(F.col(c), 1)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("keys")) for c in columns])).alias("l")).select("l.*")


def drop_log(events: DataFrame) -> DataFrame:
    return events.groupBy("kind", "reason_code").agg(F.count("*").alias("rows"), F.min("reason").alias("example"))


def group_columns(df: DataFrame, columns: list[str], most: int | None = 10_000, cap: int | None = 32) -> DataFrame:
    """Columns fit to group by: not unique per row, not too many values; fewest values first.

    most: values that a column may have; cap: columns that are listed; None: any number."""
    n = df.agg(F.count("*").alias("n"), *[(F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns])
    lines = n.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("values")) for c in columns])).alias("l")).select("l.column", "l.values", "n")
    few = F.lit(True) if most is None else F.col("values") <= most
    fit = lines.where(few & (F.col("values") < F.col("n"))).select("column", "values").orderBy("values", "column")
    return fit if cap is None else fit.limit(cap)


def band_overlap(df: DataFrame, column: str, side: str, a: str, b: str) -> DataFrame:
    """The smaller of: a's share inside b's 5-95 % band, and b's inside a's."""
    q = df.where(F.col(side).isin(a, b)).groupBy(side).agg(F.percentile(column, F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    other = q.select(F.when(F.col(side) == a, b).otherwise(a).alias("__s"), "q")
    d = df.join(F.broadcast(other), F.col(side) == F.col("__s"))  # two rows
    return d.groupBy(side).agg(F.avg(F.col(column).between(F.col("q")[0], F.col("q")[1]).cast("double")).alias("share")).agg(F.min("share").alias("overlap"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column, Column]:
    """Share, and its Wilson interval; null without cases."""
    p = hits / n
    mid, half, den = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    ok = n > 0
    return F.when(ok, p), F.when(ok, F.greatest(F.lit(0.0), (mid - half) / den)), F.when(ok, F.least(F.lit(1.0), (mid + half) / den))


def agreement(df: DataFrame, a: str, b: str, positive: str, stratum: str | None = None) -> DataFrame:
    """Confusion counts, agreement with its interval, and Cohen's kappa, per stratum; the worst first."""
    x, y = F.col(a).cast("string") == positive, F.col(b).cast("string") == positive
    by = [value_of(df, stratum).alias("stratum")] if stratum else [F.lit("all").alias("stratum")]
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(*[F.count(F.when(t, 1)).alias(n) for n, t in (("tp", x & y), ("fp", x & ~y), ("fn", ~x & y), ("tn", ~x & ~y))])
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    share, low, high = wilson(F.col("tp") + F.col("tn"), n)
    chance = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn"))) / (n * n)
    c = c.select("*", share.alias("agreement"), low.alias("low"), high.alias("high"), F.when(chance < 1, (share - chance) / (1 - chance)).alias("kappa"))
    return c.orderBy("agreement", "stratum")


def auroc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the curve by ranks, ties a half, over one aggregate of the distinct scores.

    The window runs over distinct score values in ranges, not over rows in one task.
    """
    per = df.where(F.col(score).isNotNull() & positive.isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count(F.when(positive, 1)).alias("p"), F.count(F.when(~positive, 1)).alias("n"))
    b = F.floor(F.col("s") * 1024).cast("long")
    d = per.withColumn("b", b)
    inside = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ahead = d.groupBy("b").agg(F.sum("n").alias("m")).withColumn("ahead", F.coalesce(F.sum("m").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    u = d.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(ahead.select("b", "ahead"), "b")
    return u.agg(F.sum(F.col("p") * (F.col("below") + F.col("ahead") + F.col("n") / 2)).alias("u"), F.sum("p").alias("positives"), F.sum("n").alias("negatives")).select(
        "positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("u") / (F.col("positives") * F.col("negatives"))).alias("auroc")
    )


def macro_auroc(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """One-versus-rest area per class and their mean ('macro')."""
    each = [auroc(df, c, F.col(label) == k).select(F.lit(k).alias("class"), "auroc") for k, c in scores.items()]
    both = reduce(DataFrame.unionByName, each)
    return both.unionByName(both.agg(F.lit("macro").alias("class"), F.avg("auroc").alias("auroc")))


def reliability(df: DataFrame, p: str, y: Column, bins: int = 10, sparse: int = 30) -> DataFrame:
    """Right-closed bins of a probability: rows, mean p, observed share, and whether few."""
    b = F.greatest(F.ceil(F.col(p) * bins) - 1, F.lit(0)).cast("int")
    return df.where(F.col(p).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("rows"), F.avg(p).alias("mean_p"), F.avg(y.cast("double")).alias("share")).withColumn("sparse", F.col("rows") < sparse)


def band_shares(df: DataFrame, p: str, low: float, high: float, by: str | None = None) -> DataFrame:
    x = F.col(p)
    key = [value_of(df, by).alias("class")] if by else [F.lit("all").alias("class")]
    return df.where(x.isNotNull()).groupBy(*key).agg(F.avg((x >= high).cast("double")).alias("positive"), F.avg((x <= low).cast("double")).alias("negative"), F.avg(((x > low) & (x < high)).cast("double")).alias("between"))


def paired_score(df: DataFrame, group: str, positive: Column, score: str) -> DataFrame:
    """Share of positive-negative pairs inside a group that the score orders right, ties a half.

    Pairs are counted from counts of equal scores, none is made: per group the running number of
    negatives under each distinct score.
    """
    c = df.where(F.col(group).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(group).alias("g"), F.col(score).alias("s")).agg(F.count(F.when(positive, 1)).alias("p"), F.count(F.when(~positive, 1)).alias("n"))
    w = Window.partitionBy("g").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    d = c.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    g = d.groupBy("g").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("wins"))
    return g.agg(F.sum(F.col("p") * F.col("n")).alias("pairs"), (F.sum("wins") / F.sum(F.col("p") * F.col("n"))).alias("paired_score"))


def bootstrap_mean(df: DataFrame, column: str, unit: str, resamples: int = 2_000, seed: int = 0) -> DataFrame:
    """Percentile interval of a mean over resampled units.

    Units fold into their sums first; each draws a Poisson(1) weight per resample from a hash of
    (seed, unit, resample). A task adds its units up and sends one line a resample, so what moves does
    not grow with the units.
    """
    per = df.where(F.col(column).isNotNull()).groupBy(F.col(unit).alias("u")).agg(F.sum(F.col(column).cast("double")).alias("s"), F.count(column).alias("c")).select(F.xxhash64(F.lit(seed), "u").alias("h"), "s", "c")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(resamples), np.zeros(resamples)
        place = np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            h, s, c = (batch.column(i).to_numpy() for i in range(3))
            for at in range(0, len(h), 1024):
                x = h[at : at + 1024].view(np.uint64)[:, None] + place[None, :]
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                w = np.searchsorted(_POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), side="right")
                sums += s[at : at + 1024] @ w
                counts += c[at : at + 1024] @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(sums), pa.array(counts)], names=["b", "s", "c"])

    means = per.mapInArrow(add_up, "b long, s double, c double").groupBy("b").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).where("c > 0").select((F.col("s") / F.col("c")).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def distinct_n(df: DataFrame, content: list[str], n: int, by: list[str] | None = None) -> DataFrame:
    """Distinct n-grams over n-grams; null without any. Partial counts combine before the shuffle."""
    g = df.select(*(by or []), F.explode(ngrams(words(content_text(df, content)), n)).alias("g")).groupBy(*(by or []), "g").agg(F.count("*").alias("c"))
    return g.groupBy(*(by or [])).agg(F.count("*").alias("distinct_grams"), F.sum("c").alias("grams"), (F.count("*") / F.sum("c")).alias("ratio"))


def centroid_spread(vectors: DataFrame) -> DataFrame:
    """Mean cosine distance of unit vectors to their mean direction. vectors: (key, vector)."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    d = vectors.where("vector is not null").select("key", F.transform("vector", lambda x: x / norm).alias("v"))
    mean = d.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    m = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))  # one entry a dimension
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return d.crossJoin(F.broadcast(m)).agg(F.count("*").alias("rows"), F.avg(1 - dot("v", "m") / F.sqrt(dot("m", "m"))).alias("spread"))


def compare_versions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (key, occurrence) by what became of them: kept, removed, added; and split changes."""
    x, y = a.select(KEY, OCC, F.col(SPLIT).alias("sa")), b.select(KEY, OCC, F.col(SPLIT).alias("sb"))
    j = x.join(y, [KEY, OCC], "full")
    what = F.when(F.col("sa").isNull(), "added").when(F.col("sb").isNull(), "removed").when(F.col("sa") != F.col("sb"), "moved").otherwise("kept")
    return j.groupBy(what.alias("what"), F.coalesce("sb", "sa").alias("split")).agg(F.count("*").alias("rows"))


def shared_histograms(a: DataFrame, b: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Both sides' counts in the same equal bins over their joint range."""
    both = a.select(F.lit("a").alias("side"), column).unionByName(b.select(F.lit("b").alias("side"), column))
    e = both.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    d = both.where(F.col(column).isNotNull()).crossJoin(F.broadcast(e))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    return d.groupBy(at.alias("bin")).agg(F.count(F.when(F.col("side") == "a", 1)).alias("rows_a"), F.count(F.when(F.col("side") == "b", 1)).alias("rows_b"))


def logical_digest(df: DataFrame) -> DataFrame:
    """Order-free digest of the pairs: count, xor and sum of their hashes; equal tables, equal digests.

    Equal pairs cancel each other in the xor and not in the sum.
    """
    h = F.xxhash64(KEY, OCC)
    return df.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("digest"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"))


def contamination(df: DataFrame, content: list[str], benchmark: DataFrame, n: int = 13) -> DataFrame:
    """(key, occurrence, grams, hits, overlap, item): the share of a row's n-grams that the benchmark
    holds, and the item that shares most of its distinct ones.

    benchmark: (item_id, text). Grams meet as 64-bit hashes first, beside a hash of the row, so that
    neither texts nor grams move; only rows with a hit are then joined by the grams themselves.
    """
    b = benchmark.select("item_id", F.explode(F.array_distinct(ngrams(words(F.coalesce("text", F.lit(""))), n))).alias("g")).select("item_id", F.xxhash64("g").alias("h"), "g")
    items = b.groupBy("g").agg(F.count("*").alias("m"))
    base = df.select(KEY, OCC, ngrams(words(content_text(df, content)), n).alias("gs"))
    total = base.select(KEY, OCC, F.size("gs").alias("grams"))
    row = F.xxhash64(KEY, OCC).alias("r")
    met = base.select(row, F.explode(F.transform("gs", lambda g: F.xxhash64(g))).alias("h")).join(b.select("h").distinct(), "h").select(F.col("r").alias("__r")).distinct()
    each = base.join(materialise(met, "met"), F.xxhash64(KEY, OCC) == F.col("__r"), "left_semi").select(KEY, OCC, F.explode("gs").alias("g"))
    hit = materialise(each.join(items.select("g"), "g").groupBy(KEY, OCC, "g").agg(F.count("*").alias("c")), "hits")
    hits = hit.groupBy(KEY, OCC).agg(F.sum("c").alias("hits"))
    best = hit.join(b.select("item_id", "g"), "g").groupBy(KEY, OCC, "item_id").agg(F.count("*").alias("shared")).groupBy(KEY, OCC).agg(F.max_by("item_id", F.struct("shared", -F.col("item_id"))).alias("item"))
    return total.join(hits, [KEY, OCC], "left").join(best, [KEY, OCC], "left").select(KEY, OCC, "grams", F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("grams") > 0, F.coalesce("hits", F.lit(0)) / F.col("grams")).otherwise(0.0).alias("overlap"), "item")


def decontaminate(df: DataFrame, ctx, n: int = 13, threshold: float = 0.5):
    """Drop rows whose overlap with ctx.inputs['benchmark'] reaches the threshold."""
    from sievework.operators.rows import Reason, drop

    c = contamination(df, list(ctx.content), ctx.inputs["benchmark"], n).where(F.col("overlap") >= threshold).select(F.col(KEY).alias("__k"), F.col(OCC).alias("__o"), "overlap", "item")
    d = df.join(c, (F.col(KEY) == F.col("__k")) & (F.col(OCC) == F.col("__o")), "left")
    return drop(d, [Reason(F.col("__k").isNotNull(), "benchmark_overlap", "ngram_overlap", F.col("overlap"), text=F.col("item").cast("string"), threshold=f">= {threshold:g}")], ["__k", "__o", "overlap", "item"])


def leakage(df: DataFrame, content: list[str], group_column: str | None = None, near: DataFrame | None = None) -> DataFrame:
    """(kind, side_a, side_b, pairs): crossings of splits by equal key or text, by group value, and
    near ones from verified pairs (a, b). Blank text never matches. Counts are products of per-side
    counts: no pair is made."""
    text = F.sha2(content_text(df, content), 256)
    blank = F.length(F.trim(content_text(df, content))) == 0

    def crossing(kind: str, value: Column, rows: DataFrame) -> DataFrame:
        c = rows.select(value.alias("v"), SPLIT, KEY).where("v is not null").distinct().groupBy("v", SPLIT).agg(F.count("*").alias("n"))
        x, y = c.select("v", F.col(SPLIT).alias("side_a"), F.col("n").alias("na")), c.select("v", F.col(SPLIT).alias("side_b"), F.col("n").alias("nb"))
        return x.join(y, "v").where("side_a < side_b").groupBy("side_a", "side_b").agg(F.sum(F.col("na") * F.col("nb")).alias("pairs")).select(F.lit(kind).alias("kind"), "side_a", "side_b", "pairs")

    parts = [crossing("exact", text, df.where(~blank))]
    if group_column:
        parts.append(crossing("group", F.col(group_column).cast("string"), df))
    if near is not None:
        s = df.select(KEY, SPLIT).distinct()
        j = near.join(s.select(F.col(KEY).alias("a"), F.col(SPLIT).alias("sa")), "a").join(s.select(F.col(KEY).alias("b"), F.col(SPLIT).alias("sb")), "b").where("sa <> sb and a <> b")
        parts.append(j.groupBy(F.least("sa", "sb").alias("side_a"), F.greatest("sa", "sb").alias("side_b")).agg(F.count("*").alias("pairs")).select(F.lit("near").alias("kind"), "side_a", "side_b", "pairs"))
    return reduce(DataFrame.unionByName, parts)


def decile_band(df: DataFrame, column: str) -> Column:
    """Quantile bands of a numeric column; a value on an edge belongs to the upper band."""
    edges = sorted(set(df.agg(F.percentile(column, F.array(*[F.lit(i / 10) for i in range(1, 10)]))).first()[0] or []))
    out = F.lit(0)
    for e in edges:
        out = out + (F.col(column) >= e).cast("int")
    return F.when(F.col(column).isNull(), EMPTY).otherwise(F.concat(F.lit("band "), out.cast("string")))


def shortcut_audit(df: DataFrame, columns: list[str], label_column: str = "label", folds: int = 5, control_runs: int = 5, tolerance_pp: float = 2.0, seed: int = 0) -> DataFrame:
    """How well each column alone gives the label away: out-of-fold balanced accuracy of the majority
    label per value, against a control with permuted labels.

    Folds are hash ranks within a label, mod folds. The permuted label of a row is the label at its
    place in another seeded order. All is done on counts of (value, fold, label): rows are read once.
    invalid: the control itself beats chance; warn: 10 points over chance and over the control.
    """
    numeric = (T.LongType, T.IntegerType, T.DoubleType, T.FloatType)
    d = df.where(F.col(label_column).isNotNull()).withColumn("__l", F.col(label_column).cast("string"))
    values = [(decile_band(d, c) if isinstance(d.schema[c].dataType, numeric) else value_of(d, c)).alias(f"v{i}") for i, c in enumerate(columns)]
    d = d.select("__l", F.xxhash64(F.lit(seed), KEY, OCC).alias("__h"), *values, KEY, OCC)
    d = rank_within(d, ["__l"], ["__h", KEY, OCC], F.shiftright("__h", 54), "__r").withColumn("fold", (F.col("__r") % folds).cast("int"))
    d = materialise(d.drop("__r"), "audit")
    sizes = {r["__l"]: r["n"] for r in d.groupBy("__l").agg(F.count("*").alias("n")).collect()}  # one row a label
    if len(sizes) < 2:
        raise Refused("single_class")
    chance = 1 / len(sizes)
    bounds, at = [], 0
    for k in sorted(sizes):
        at += sizes[k]
        bounds.append((k, at))
    runs = [d.withColumn("run", F.lit(-1))]
    for c in range(control_runs):
        s = d.withColumn("__p", F.xxhash64(F.lit(seed + 1 + c), KEY, OCC))
        s = rank_within(s, [], ["__p", KEY, OCC], F.shiftright("__p", 54), "__at")
        lab = F.lit(bounds[-1][0])
        for k, top in reversed(bounds[:-1]):
            lab = F.when(F.col("__at") < top, k).otherwise(lab)
        runs.append(s.withColumn("__l", lab).withColumn("run", F.lit(c)).select(*d.columns, "run"))
    every = reduce(DataFrame.unionByName, runs)
    long = every.select("run", "fold", "__l", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("value")) for i, c in enumerate(columns)])).alias("x")).select("run", "fold", F.col("__l").alias("l"), "x.column", "x.value")
    counts = materialise(long.groupBy("run", "column", "value", "l", "fold").agg(F.count("*").alias("n")), "cells")
    whole = counts.groupBy("run", "column", "value", "l").agg(F.sum("n").alias("t"))
    every_fold = counts.select("run", "column", "value", "fold").distinct()
    rest = every_fold.join(whole, ["run", "column", "value"]).join(counts, ["run", "column", "value", "l", "fold"], "left").withColumn("o", F.col("t") - F.coalesce("n", F.lit(0)))
    guess = rest.where("o > 0").groupBy("run", "column", "value", "fold").agg(F.min_by("l", F.struct(-F.col("o"), F.col("l"))).alias("guess"))
    default = min(sizes, key=lambda k: (-sizes[k], k))
    scored = counts.join(guess, ["run", "column", "value", "fold"], "left").withColumn("right", F.when(F.coalesce("guess", F.lit(default)) == F.col("l"), F.col("n")).otherwise(0))
    recall = scored.groupBy("run", "column", "l").agg((F.sum("right") / F.sum("n")).alias("recall"))
    acc = recall.groupBy("run", "column").agg(F.avg("recall").alias("a"))
    out = acc.groupBy("column").agg(F.max(F.when(F.col("run") < 0, F.col("a"))).alias("accuracy"), F.avg(F.when(F.col("run") >= 0, F.col("a"))).alias("control"), F.stddev(F.when(F.col("run") >= 0, F.col("a"))).alias("sd"))
    se = F.coalesce("sd", F.lit(0.0)) / max(1, control_runs) ** 0.5
    over = F.greatest(F.lit(tolerance_pp / 100), 3 * se)
    return out.select("column", "accuracy", "control", F.lit(chance).alias("chance"), (F.col("control") > chance + over).alias("invalid"), ((F.col("accuracy") >= chance + 0.1) & (F.col("accuracy") >= F.col("control") + 0.1)).alias("warn"))


def text_clusters(df: DataFrame, content: list[str], k: int = 50, seed: int = 0, features: int = 1 << 15) -> DataFrame:
    """(key, cluster, distance): k-means over hashed TF-IDF; k is at most the distinct texts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    d = df.groupBy(KEY).agg(F.first(words(content_text(df, content))).alias("w"))
    k = min(k, d.select("w").distinct().limit(k).count())
    if k < 2:
        raise Refused("params_invalid")
    tf = materialise(HashingTF(inputCol="w", outputCol="tf", numFeatures=features).transform(d).select(KEY, "tf"), "tf")
    x = Normalizer(inputCol="idf", outputCol="features").transform(IDF(inputCol="tf", outputCol="idf").fit(tf).transform(tf)).select(KEY, "features")
    return _kmeans(x, k, seed)


def vector_clusters(vectors: DataFrame, k: int = 50, seed: int = 0) -> DataFrame:
    """The same over unit embedding vectors. vectors: (key, vector)."""
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    v = vectors.where("vector is not null").select(F.col("key").alias(KEY), array_to_vector(F.col("vector").cast("array<double>")).alias("raw"))
    return _kmeans(Normalizer(inputCol="raw", outputCol="features").transform(v).select(KEY, "features"), k, seed)


def _kmeans(x: DataFrame, k: int, seed: int) -> DataFrame:
    from pyspark.ml.clustering import KMeans

    model = KMeans(k=k, seed=seed, maxIter=10, featuresCol="features", predictionCol="cluster").fit(x)
    centres = x.sparkSession.sparkContext.broadcast([(np.asarray(c), float(np.dot(c, c))) for c in model.clusterCenters()])  # k rows

    @F.udf("double")
    def far(v, i):
        """By |x|^2 - 2xc + |c|^2: a sparse row costs its own entries, not the centre's."""
        c, square = centres.value[i]
        at, own = (v.indices, v.values) if hasattr(v, "indices") else (slice(None), v.toArray())
        return float(max(0.0, np.dot(own, own) - 2 * np.dot(own, c[at]) + square) ** 0.5)

    return model.transform(x).select(F.col(KEY).alias("row_key"), "cluster", far("features", "cluster").alias("distance"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """Rows of each cluster, its exemplar, and the share of the largest."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("rows"), F.min_by("row_key", F.struct("distance", "row_key")).alias("exemplar"), F.avg("distance").alias("mean_distance"))


def text_baseline(df: DataFrame, content: list[str], label_column: str, positive: str, seed: int = 0, folds: int = 5, features: int = 1 << 15) -> DataFrame:
    """Out-of-fold area of a TF-IDF logistic regression, of length alone, and under permuted labels."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.functions import vector_to_array

    w = words(content_text(df, content))
    d = df.where(F.col(label_column).isNotNull()).select(KEY, OCC, F.concat(w, ngrams(w, 2)).alias("w"), F.length(content_text(df, content)).cast("double").alias("len"), (F.col(label_column).cast("string") == positive).cast("double").alias("y"))
    d = materialise(d.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), KEY), F.lit(folds))).withColumn("z", F.pmod(F.xxhash64(F.lit(seed + 1), KEY, OCC), F.lit(2)).cast("double")), "baseline")
    steps = [HashingTF(inputCol="w", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="x")]
    scored = []
    for target in ("y", "z"):
        for f in range(folds):
            model = Pipeline(stages=[*steps, LogisticRegression(featuresCol="x", labelCol=target, maxIter=30, regParam=0.01)]).fit(d.where(F.col("fold") != f))
            scored.append(model.transform(d.where(F.col("fold") == f)).select(F.lit(target).alias("t"), F.col(target).alias("y"), vector_to_array("probability")[1].alias("p")))
    both = materialise(reduce(DataFrame.unionByName, scored), "scored")
    top = d.agg(F.max("len")).first()[0] or 1.0
    return reduce(DataFrame.unionByName, [
        auroc(both.where("t = 'y'"), "p", F.col("y") == 1).select(F.lit("text").alias("model"), "auroc"), auroc(d.withColumn("p", F.col("len") / top), "p", F.col("y") == 1).select(F.lit("length").alias("model"), "auroc"),
        auroc(both.where("t = 'z'"), "p", F.col("y") == 1).select(F.lit("permuted").alias("model"), "auroc"),
    ])


def census(plan: DataFrame, actual: DataFrame, by: list[str]) -> DataFrame:
    """Planned against actual rows of each combination, with the shortfall."""
    a = actual.groupBy(*by).agg(F.count("*").alias("actual"))
    return plan.groupBy(*by).agg(F.sum("planned").alias("planned")).join(a, by, "left").select(*by, "planned", F.coalesce("actual", F.lit(0)).alias("actual"), F.greatest(F.col("planned") - F.coalesce("actual", F.lit(0)), F.lit(0)).alias("shortfall"))


def vote(df: DataFrame, row: str, verdict: str) -> DataFrame:
    """Per row the most frequent verdict, whether all agree, and whether it is a tie (then null)."""
    c = df.where(F.col(verdict).isNotNull()).groupBy(F.col(row).alias("row"), F.col(verdict).alias("v")).agg(F.count("*").alias("n"))
    g = c.groupBy("row").agg(F.max("n").alias("top"), F.sum("n").alias("votes"), F.max_by("v", F.struct("n", "v")).alias("v"), F.collect_list("n").alias("ns"))
    tie = F.size(F.filter("ns", lambda x: x == F.col("top"))) > 1
    return g.select("row", F.when(~tie, F.col("v")).alias("verdict"), "votes", (F.col("top") == F.col("votes")).alias("unanimous"), tie.alias("tie"))


def effective_labels(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows with decisions folded in, oldest first: the last flag of anyone, or decision of an operator, counts.

    decisions: (row_key, decision flag|override|accept|reject, origin, value, at, and id where times may
    be equal). flag: flagged_unresolved, without a label; override: overridden, with the decision's;
    reject: rejected, without one; accept, or no decision: model, with the row's own.
    """
    order = F.struct("at", *[c for c in ("id",) if c in decisions.columns], "decision", "value")
    counted = decisions.where("decision in ('flag', 'override', 'accept', 'reject') and (decision = 'flag' or origin = 'operator')")
    last = counted.groupBy("row_key").agg(F.max_by(F.struct("decision", "value"), order).alias("__last"))
    d, what = rows.join(last, "row_key", "left"), F.col("__last.decision")
    state = F.when(what == "flag", "flagged_unresolved").when(what == "override", "overridden").when(what == "reject", "rejected").otherwise("model")
    label = F.when(what == "override", F.col("__last.value")).when(what.isin("flag", "reject"), F.lit(None)).otherwise(F.col("label"))
    return d.select(*rows.columns, state.alias("state"), label.alias("effective_label"))


def row_history(events: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Events that touched a row across steps, walking back through changed keys; bounded by the steps.

    The keys so far are a table that each step's events meet by join, so a row that many were
    normalised into has all their events.
    """
    if not events:
        raise Refused("params_invalid", "no steps")
    keys, found = events[0][1].sparkSession.createDataFrame([(key,)], "__k string"), []
    for step, ev in reversed(events):
        old, new = ev.join(keys, F.col("row_key") == F.col("__k"), "left_semi"), ev.join(keys, F.col("new_row_key") == F.col("__k"), "left_semi")
        hit = materialise(old.unionByName(new.join(keys, F.col("row_key") == F.col("__k"), "left_anti")).withColumn("step", F.lit(step)), "history")
        found.append(hit)
        keys = materialise(keys.unionByName(hit.where("kind = 'changed'").select(F.col("row_key").alias("__k"))).where("__k is not null").distinct(), "keys")
    return reduce(DataFrame.unionByName, found)

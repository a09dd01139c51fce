"""Calibration of a labeller against human labels, and the gates over reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sievework.operators.filters import EMPTY
from sievework.operators.reports import auroc, band_shares, reliability
from sievework.plans.staging import materialise

#: Without a target or a rater ceiling the interval's low end must reach this.
PLAIN_TARGET = 0.70


def bootstrap_auroc(df: DataFrame, score: str, label: str, positive: str, unit: str, resamples: int = 200, seed: int = 0) -> DataFrame:
    """(auroc, low, high): percentile interval over resampled units.

    Rows fold into counts per (unit, score, class) first. Each unit draws a Poisson weight per
    resample from a hash; areas come from running sums per resample, all in one aggregate plan.
    """
    y = F.col(label).cast("string") == positive
    cells = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(unit).alias("u"), F.round(F.col(score).cast("double"), 6).alias("s")).agg(F.count(F.when(y, 1)).alias("p"), F.count(F.when(~y, 1)).alias("n"))
    x = (F.pmod(F.xxhash64(F.lit(seed), "u", "b"), F.lit(1 << 52)) + 0.5) / (1 << 52)
    cuts, total, term = [], 0.0, 0.36787944117144233
    for k in range(10):
        total += term
        cuts.append(total)
        term /= k + 1
    weight = reduce(lambda a, b: a + b, [(x >= c).cast("int") for c in cuts])
    each = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).withColumn("w", weight).groupBy("b", "s").agg(F.sum(F.col("w") * F.col("p")).alias("p"), F.sum(F.col("w") * F.col("n")).alias("n"))
    from pyspark.sql import Window

    below = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    areas = each.withColumn("below", below).groupBy("b").agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.sum("p").alias("tp"), F.sum("n").alias("tn")).where("tp > 0 and tn > 0").select((F.col("u") / (F.col("tp") * F.col("tn"))).alias("a"))
    point = auroc(df.where(F.col(label).isNotNull()), score, y).select("auroc")
    return point.crossJoin(areas.agg(F.percentile("a", F.lit(0.025)).alias("low"), F.percentile("a", F.lit(0.975)).alias("high")))  # one row each


def rater_ceiling(ratings: DataFrame, draws: int = 20, seed: int = 0) -> DataFrame:
    """(draws, ceiling): how well one rater, drawn per row and round, ranks the consensus of the rest.

    ratings: (row_key, rater, score). A row with fewer than two raters takes no part; the consensus
    is the majority of the others' scores over one half, ties out.
    """
    r = ratings.select("row_key", "rater", "score", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("d")).withColumn("h", F.xxhash64(F.lit(seed), "row_key", "rater", "d"))
    g = r.groupBy("row_key", "d").agg(F.min_by("score", "h").alias("one"), F.sum((F.col("score") >= 0.5).cast("int")).alias("yes"), F.count("*").alias("n")).where("n > 1")
    rest = F.col("yes") - (F.col("one") >= 0.5).cast("int")
    g = materialise(g.withColumn("y", F.when(rest * 2 != F.col("n") - 1, rest * 2 > F.col("n") - 1)).where("y is not null"), "ceiling")
    each = [auroc(g.where(F.col("d") == i), "one", F.col("y")).select("auroc") for i in range(draws)]
    return reduce(DataFrame.unionByName, each).agg(F.count("auroc").alias("draws"), F.avg("auroc").alias("ceiling"))


def sanity_checks(df: DataFrame, score: str, label: str, positive: str, seed: int = 0) -> dict[str, bool]:
    """both_classes: either class is there. permutation_null: shuffled labels rank near chance.
    row_alignment: no key has two labels."""
    y = F.col(label).cast("string") == positive
    c = df.where(F.col(label).isNotNull()).agg(F.count(F.when(y, 1)).alias("p"), F.count(F.when(~y, 1)).alias("n")).first()
    out = {"both_classes": bool(c["p"] and c["n"])}
    if out["both_classes"]:
        fake = F.pmod(F.xxhash64(F.lit(seed), "row_key"), F.lit(10_000)) < F.lit(10_000 * c["p"] // (c["p"] + c["n"]))
        a = auroc(df.where(F.col(label).isNotNull()), score, fake).first()["auroc"]
        out["permutation_null"] = a is None or abs(a - 0.5) <= max(0.05, 3 * (1 / (12 * max(1, min(c["p"], c["n"])))) ** 0.5)
    out["row_alignment"] = df.where(F.col(label).isNotNull()).groupBy("row_key").agg(F.countDistinct(label).alias("k")).where("k > 1").limit(1).count() == 0
    return out


#: Fixed value: a held-out rater that ranks so well is part of its own consensus.
CIRCULAR = 0.99


def further_checks(area: float | None, ceiling: float | None = None, shortcuts: dict[str, float] | None = None, negative_low: float | None = None) -> dict[str, bool]:
    """The checks that apply, by what there is: ceiling_circularity, that no rater is part of the consensus it
    is held against; shortcut_comparison, that no column alone (column -> area) ranks the labels as well as the
    scores do; negative_class_control, that negatives in the positives' place do not win more than half the
    time (the low end of their interval)."""
    out = {}
    if ceiling is not None:
        out["ceiling_circularity"] = ceiling < CIRCULAR
    if shortcuts is not None and area is not None:
        out["shortcut_comparison"] = all(v < area for v in shortcuts.values())
    if negative_low is not None:
        out["negative_class_control"] = negative_low <= 0.5
    return out


def shortcut_areas(df: DataFrame, columns: list[str], label: str, positive: str) -> DataFrame:
    """(column, auroc): how well each column's own values rank the labels, by the positives' share of a value."""
    y = F.col(label).cast("string") == positive
    known = df.where(F.col(label).isNotNull())

    def one(c: str) -> DataFrame:
        v = F.coalesce(F.col(c).cast("string"), F.lit(EMPTY))
        share = known.groupBy(v.alias("__v")).agg(F.avg(y.cast("double")).alias("__share"))
        return auroc(known.join(share, v.eqNullSafe(F.col("__v"))), "__share", y).select(F.lit(c).alias("column"), "auroc")

    return reduce(DataFrame.unionByName, [one(c) for c in columns])


def verdict(checks: dict[str, bool], area: float | None, low: float | None, target: float | None = None, comparison: float | None = None, ceiling_low: float | None = None) -> str:
    """invalid, insufficient, passes or fails; the first rule that decides."""
    if not all(checks.values()):
        return "invalid"
    if area is None or low is None:
        return "insufficient"
    if target is not None and low >= target:
        return "passes"
    if ceiling_low is not None and comparison is not None and comparison >= ceiling_low:
        return "passes"
    if target is None and ceiling_low is None and low >= PLAIN_TARGET:
        return "passes"
    return "fails"


def calibration_record(df: DataFrame, score: str, label: str, positive: str, unit: str, target: float | None = None, seed: int = 0, ceiling: float | None = None, columns: list[str] | None = None, negative_low: float | None = None) -> dict:
    """Area with interval, reliability bins, band shares, checks and verdict. df: row_key and the named columns.

    ceiling, columns and negative_low, where given, add the checks that need them.
    """
    checks = sanity_checks(df, score, label, positive, seed)
    a = bootstrap_auroc(df, score, label, positive, unit, seed=seed).first() if checks["both_classes"] else {"auroc": None, "low": None, "high": None}
    y = F.col(label).cast("string") == positive
    shortcuts = {r["column"]: r["auroc"] for r in shortcut_areas(df, columns, label, positive).collect() if r["auroc"] is not None} if columns else None  # one row a column
    checks |= further_checks(a["auroc"], ceiling, shortcuts, negative_low)
    known = df.where(F.col(label).isNotNull())
    return {
        "auroc": a["auroc"], "low": a["low"], "high": a["high"], "checks": checks, "verdict": verdict(checks, a["auroc"], a["low"], target),
        "reliability": [r.asDict() for r in reliability(known, score, y).orderBy("bin").collect()], "bands": [r.asDict() for r in band_shares(known, score, 0.3, 0.7, label).collect()],
    }


#: Checks of a detector set: those that refuse it, and those that are noted.
REFUSING, NOTING = ("D-1", "D-2", "D-3", "D-4", "D-7", "D-11"), ("D-5", "D-6", "D-8", "D-9", "D-10")


def detector_gate(facts: dict) -> dict[str, str]:
    """Check -> 'ok', 'refused' or 'note', from facts that reports give; a missing fact is not computed.

    rows (per role), label_unmapped, audit (rows of shortcut_audit), crossing_pairs, length_overlap,
    calibration (verdict), shared_values.
    """
    out = {}
    say = lambda k, fact, bad: out.__setitem__(k, "not_computed" if facts.get(fact) is None else ("refused" if k in REFUSING else "note") if bad(facts[fact]) else "ok")
    say("D-1", "rows", lambda r: not r or min(r.values()) == 0)
    say("D-2", "label_unmapped", lambda n: n > 0)
    say("D-3", "audit", lambda a: any(x["warn"] or x["invalid"] for x in a))
    say("D-4", "crossing_pairs", lambda n: n > 0)
    say("D-5", "length_overlap", lambda o: o < 0.5)
    say("D-7", "calibration", lambda v: v in (None, "invalid", "insufficient"))
    say("D-11", "shared_values", lambda n: n > 0)
    return out


def may_send(gate: dict[str, str]) -> bool:
    return all(gate.get(k) == "ok" for k in REFUSING if k in gate) and "refused" not in gate.values()


def label_mapping_check(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """(value, target, rows): every value with where it maps; a null target is unmapped."""
    v = F.col(column).cast("string")
    table = F.create_map(*[F.lit(x) for p in mapping.items() for x in p])
    return df.groupBy(v.alias("value")).agg(F.count("*").alias("rows")).select("value", F.when(F.col("value").isNotNull(), F.try_element_at(table, F.col("value"))).alias("target"), "rows")


def threshold_statistics(df: DataFrame, statistic, name: str = "value") -> DataFrame:
    """Spread of an operator's statistic: rows, quantiles, and whether it is constant."""
    d = df.select(statistic.alias(name))
    return d.agg(F.count(name).alias("rows"), F.min(name).alias("low"), F.percentile(name, F.lit(0.5)).alias("middle"), F.max(name).alias("high"), (F.min(name) == F.max(name)).alias("constant"))

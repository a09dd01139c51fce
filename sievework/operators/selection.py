"""Deduplicators, samplers, balancers and splitters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sievework.operators.components import connected_components
from sievework.operators.filters import EMPTY
from sievework.operators.rows import KEY, OCC, ORIGIN, SPLIT, Context, Reason, Refused, StepResult, as_text, collapse_whitespace, content_text, drawn_rank, drop, require, words
from sievework.plans.staging import materialise


def _keep_lowest(df: DataFrame, group: str, code: str, statistic: str, value=None, threshold=None) -> StepResult:
    """Of each group (column; null: alone) the lowest (key, occurrence) stays; a group that spans
    splits stays whole. Two grouped aggregates and one join: no group is gathered."""
    per = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("__g")).agg(F.min(F.struct(KEY, OCC)).alias("__low"), F.count("*").alias("__n"), F.min(SPLIT).alias("__s1"), F.max(SPLIT).alias("__s2")).where("__n > 1")
    d = df.join(per, F.col(group) == F.col("__g"), "left")
    late = F.col("__g").isNotNull() & (F.col("__s1") == F.col("__s2")) & (F.struct(KEY, OCC) != F.col("__low"))
    extra = ["__g", "__low", "__n", "__s1", "__s2", group]
    out = drop(d, [Reason(late, code, statistic, value, text=F.col(group).cast("string"), threshold=threshold, related=F.col("__low")[KEY])], [c for c in extra if c.startswith("__")])
    out.report["spanning_groups"] = per.where("__s1 <> __s2").select(F.col("__g").alias("group"), F.col("__n").alias("rows"))
    return out


def dedup_exact(df: DataFrame, ctx: Context, collapse_whitespace_: bool = False) -> StepResult:
    """One row per key, or per key of the content with its white space collapsed."""
    same = F.col(KEY) if not collapse_whitespace_ else F.sha2(F.to_json(F.array(*[collapse_whitespace(as_text(df, c)) for c in sorted(ctx.content)])), 256)
    return _keep_lowest(df.withColumn("__group", same), "__group", "exact_duplicate", "comparison_key")


def document_deduplicator(df: DataFrame, ctx: Context, column: str = "text") -> StepResult:
    """The first row of each text stays, whatever the splits."""
    d = df.withColumn("__h", F.sha2(as_text(df, column), 256))
    low = d.groupBy(F.col("__h").alias("__g")).agg(F.min(F.struct(KEY, OCC)).alias("__low"))
    d = d.join(low, F.col("__h") == F.col("__g"))
    return drop(d, [Reason(F.struct(KEY, OCC) != F.col("__low"), "dj.document_deduplicator", "hash", text=F.col("__h"), related=F.col("__low")[KEY])], ["__h", "__g", "__low"])


def bands_for(threshold: float, permutations: int) -> tuple[int, int]:
    """(bands, rows): of the divisions of the permutations, that whose midpoint (1/bands)^(1/rows) is nearest."""
    pairs = [(permutations // r, r) for r in range(1, permutations + 1) if permutations % r == 0]
    return min(pairs, key=lambda p: (abs((1 / p[0]) ** (1 / p[1]) - threshold), p[1]))


def minhash_signatures(df: DataFrame, text, shingle: str, size: int, permutations: int) -> DataFrame:
    """df with column __sig: per permutation the least of the upper halves of a*h + b (mod 2^64, a odd) over
    the distinct shingles' hashes; a text of fewer than `size` tokens is one shingle, one without any has none."""
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 64, permutations, dtype=np.uint64) for _ in range(2))
    a |= np.uint64(1)

    @F.pandas_udf("array<int>")
    def sign(column: pd.Series) -> pd.Series:
        import xxhash

        def hashes(tokens) -> np.ndarray:
            h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
            n = min(size, len(h))
            out = h[: len(h) - n + 1].copy()
            for i in range(1, n):
                out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[i : len(h) - n + 1 + i]
            out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            return np.unique(out ^ (out >> np.uint64(27)))

        def one(h: np.ndarray) -> np.ndarray:
            low = np.full(permutations, np.iinfo(np.uint64).max, dtype=np.uint64)
            for s in range(0, len(h), 4096):
                low = np.minimum(low, (h[s : s + 4096, None] * a[None, :] + b[None, :]).min(axis=0))
            return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)

        tokens = ([t for t in row if t != ""] for row in column)
        return pd.Series([one(hashes(t)) if t else None for t in tokens], dtype=object)

    source = F.split(F.lower(text), "") if shingle == "char" else words(text)
    return df.withColumn("__sig", sign(source))


def minhash_pairs(signed: DataFrame, key: str, threshold: float, permutations: int) -> DataFrame:
    """(a, b, estimate) star pairs: each member of an LSH bucket with the bucket's lowest, if the
    estimate reaches the threshold. signed: (key, __sig). A bucket costs one pair a member."""
    bands, rows = bands_for(threshold, permutations)
    unique = materialise(signed.where("__sig is not null").groupBy(key).agg(F.first("__sig").alias("__sig")), "signatures")
    buckets = unique.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(F.slice("__sig", i * rows + 1, rows)).alias("h")) for i in range(bands)])).alias("bk")).select(key, "bk.i", "bk.h")
    first = buckets.groupBy("i", "h").agg(F.min(key).alias("a"), F.count("*").alias("n")).where("n > 1")
    cand = buckets.join(first, ["i", "h"]).where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b")).distinct()
    x, y = unique.select(F.col(key).alias("a"), F.col("__sig").alias("sa")), unique.select(F.col(key).alias("b"), F.col("__sig").alias("sb"))
    estimate = F.aggregate(F.zip_with("sa", "sb", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v) / permutations
    return cand.join(x, "a").join(y, "b").withColumn("estimate", estimate).where(F.col("estimate") >= threshold).select("a", "b", "estimate")


def dedup_minhash(df: DataFrame, ctx: Context, threshold: float = 0.8, shingle: str = "word", size: int = 5, permutations: int = 128) -> StepResult:
    """Near duplicates by MinHash: components of verified star pairs; the lowest key of each stays."""
    keys = df.groupBy(KEY).agg(F.first(content_text(df, ctx.content)).alias("__t"))
    pairs = materialise(minhash_pairs(minhash_signatures(keys, F.col("__t"), shingle, size, permutations).select(KEY, "__sig"), KEY, threshold, permutations), "pairs")
    comps = connected_components(pairs, "a", "b").select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    d = df.join(comps, F.col(KEY) == F.col("__node"), "left").withColumn("__group", F.coalesce("__root", KEY)).drop("__node", "__root")
    return _keep_lowest(d, "__group", "near_duplicate_minhash", "jaccard_estimate", threshold=f">= {threshold:g}")


def cosine_pairs(vectors: DataFrame, threshold: float, blocks: int | None = None, per_block: int = 2_000) -> DataFrame:
    """(a, b, cosine) of all pairs with cosine >= threshold, a < b; exact.

    Rows are dealt into blocks and each unordered pair of blocks meets once, in one matrix product:
    work is quadratic by definition, memory is two blocks a task. vectors: (key, vector array).
    """
    n = vectors.count()
    blocks = blocks or max(1, math.ceil(n / per_block))
    d = vectors.where("vector is not null").select("key", F.col("vector").cast("array<float>").alias("vector"), F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"))
    pair = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    dealt = d.select("key", "vector", "block", F.explode(pair).alias("p")).select("key", "vector", "block", "p.i", "p.j")
    kind = dict(vectors.dtypes)["key"]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        x, y = pdf[pdf.block == i], pdf[pdf.block == j]
        if x.empty or y.empty:
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        unit = lambda m: (lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30))(np.stack(m.vector.to_numpy()).astype(np.float64))
        c = unit(x) @ unit(y).T
        r, s = np.nonzero(c >= threshold)
        a, b = x.key.to_numpy()[r], y.key.to_numpy()[s]
        low = a < b
        keep = low if i == j else np.ones(len(a), dtype=bool)
        a, b, v = a[keep], b[keep], c[r, s][keep]
        return pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "cosine": v})

    return dealt.groupBy("i", "j").applyInPandas(meet, f"a {kind}, b {kind}, cosine double")


def dedup_embedding(df: DataFrame, ctx: Context, threshold: float = 0.95) -> StepResult:
    """Near duplicates by exact cosine; ctx.inputs['vectors']: (key, vector). Rows without one stay."""
    pairs = materialise(cosine_pairs(ctx.inputs["vectors"], threshold), "pairs")
    comps = connected_components(pairs, "a", "b").select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    d = df.join(comps, F.col(KEY) == F.col("__node"), "left").withColumn("__group", F.coalesce("__root", KEY)).drop("__node", "__root")
    return _keep_lowest(d, "__group", "near_duplicate_embedding", "cosine", threshold=f">= {threshold:g}")


def sample(df: DataFrame, ctx: Context, mode: str = "count", count: int | None = None, fraction: float | None = None, seed: int | None = None) -> StepResult:
    """A seeded sample of exactly so many rows: min(count, n), or max(1, floor(fraction * n + 0.5))."""
    if (mode == "count" and not count) or (mode == "fraction" and not fraction):
        raise Refused("params_invalid")
    n = df.count()
    k = min(count, n) if mode == "count" else max(1, math.floor(fraction * n + 0.5))
    d = drawn_rank(df, [], ctx.seed if seed is None else seed, "__rank", ctx.rank_digits)
    return drop(d, [Reason(F.col("__rank") >= k, "not_sampled", "sample_rank", F.col("__rank"), threshold=f"< {k}")], ["__rank"])


def sample_stratified(
    df: DataFrame, ctx: Context, strata: list[str], per_stratum: int, always_keep_column: str | None = None, instructed_column: str | None = None, instructed_values: list[str] | None = None,
    instructed_rate: float = 0.0, instructed_min: int = 0, seed: int | None = None,
) -> StepResult:
    """Up to per_stratum rows of each stratum; rows whose flag is true stay besides; instructed rows
    (a listed value) are drawn apart, at a rate but at least so many."""
    require(df, *strata, *[c for c in (always_keep_column, instructed_column) if c])
    always = F.coalesce(F.col(always_keep_column), F.lit(False)) if always_keep_column else F.lit(False)
    told = F.coalesce(F.col(instructed_column).cast("string").isin(instructed_values or []), F.lit(False)) if instructed_column else F.lit(False)
    d = df.withColumn("__pool", F.when(always, "always").when(told, "told").otherwise("plain"))
    keys = [f"__s{i}" for i in range(len(strata))]
    for k, c in zip(keys, strata, strict=True):
        d = d.withColumn(k, F.when(F.col("__pool") == "plain", F.coalesce(F.col(c).cast("string"), F.lit(EMPTY))).otherwise(""))
    told_rows = d.where("__pool = 'told'").count()
    want = min(told_rows, max(instructed_min, math.floor(instructed_rate * told_rows + 0.5)))
    d = drawn_rank(d, ["__pool", *keys], ctx.seed if seed is None else seed, "__rank", ctx.rank_digits)
    cap = F.when(F.col("__pool") == "told", want).when(F.col("__pool") == "plain", per_stratum)
    return drop(d, [Reason((F.col("__pool") != "always") & (F.col("__rank") >= cap), "not_sampled", "sample_rank", F.col("__rank"), threshold=cap.cast("string"))], ["__rank", "__pool", *keys])


def largest_remainder(weights: list[float], total: int) -> list[int]:
    """Hamilton's method: floors, then one each by the largest remainder, ties in order."""
    s = sum(weights)
    exact = [total * w / s for w in weights]
    out = [math.floor(x) for x in exact]
    for i in sorted(range(len(weights)), key=lambda i: (-(exact[i] - out[i]), i))[: total - sum(out)]:
        out[i] += 1
    return out


def proportional_allocation(sizes: dict[str, int], total: int) -> dict[str, int]:
    """Exactly total rows over strata in proportion, at least one each, never over a stratum's size."""
    names = sorted(sizes)
    total = min(total, sum(sizes.values()))
    got = dict(zip(names, largest_remainder([sizes[n] for n in names], total), strict=True))
    for n in names:
        if got[n] == 0 and total >= len(names):
            giver = max((m for m in names if got[m] > 1), key=lambda m: (got[m], m), default=None)
            if giver:
                got[n], got[giver] = 1, got[giver] - 1
    for n in names:
        while got[n] > sizes[n]:
            other = min((m for m in names if got[m] < sizes[m]), key=lambda m: got[m] / sizes[m])
            got[n], got[other] = got[n] - 1, got[other] + 1
    return got


def _labels(df: DataFrame, label_column: str) -> None:
    if label_column not in df.columns:
        raise Refused("no_label_column")
    if df.where(F.col(label_column).isNull()).limit(1).count():
        raise Refused("label_has_nulls")


def label_balancer(df: DataFrame, ctx: Context, label_column: str = "label", classes: list[str] | None = None, max_per_class: int | None = None) -> StepResult:
    """Per split every class comes down to the smallest, or to max_per_class if that is less."""
    _labels(df, label_column)
    d = df.withColumn("__l", F.col(label_column).cast("string"))
    if classes:
        d = d.where(F.col("__l").isin(classes))
    counts = d.groupBy(SPLIT, "__l").agg(F.count("*").alias("__n"))
    n = counts.groupBy(SPLIT).agg(F.count("*").alias("c"), F.min("__n").alias("low")).agg(F.min("c").alias("c")).first()["c"]
    if (n or 0) < 2 or (classes and n < len(classes)):
        raise Refused("single_class")
    cap = counts.groupBy(F.col(SPLIT).alias("__sp")).agg(F.min("__n").alias("__cap"))
    if max_per_class:
        cap = cap.withColumn("__cap", F.least("__cap", F.lit(max_per_class)))
    size = counts.select(F.col(SPLIT).alias("__sp2"), F.col("__l").alias("__l2"), F.col("__n").alias("__size"))
    r = drawn_rank(d, [SPLIT, "__l"], ctx.seed, "__rank", ctx.rank_digits)
    r = r.join(cap, r[SPLIT] == cap["__sp"]).join(size, (r[SPLIT] == size["__sp2"]) & (r["__l"] == size["__l2"]))
    return drop(r, [Reason(F.col("__rank") >= F.col("__cap"), "label_cap", "class_size", F.col("__size"), threshold=F.concat(F.lit("sampled_to "), F.col("__cap").cast("string")))], ["__l", "__rank", "__sp", "__cap", "__sp2", "__l2", "__size"])


def cell_cap(df: DataFrame, column: str, label_column: str, exclude_values: list[str] | None = None) -> tuple[DataFrame, int]:
    """Counts of the value-by-label cells and their smallest; an empty cell is refused."""
    d = df.withColumn("__v", F.coalesce(F.col(column).cast("string"), F.lit(EMPTY))).withColumn("__l", F.col(label_column).cast("string"))
    d = d.where(~F.col("__v").isin(exclude_values or []))
    counts = d.groupBy("__v", "__l").agg(F.count("*").alias("__n"))
    s = counts.agg(F.countDistinct("__v").alias("v"), F.countDistinct("__l").alias("l"), F.count("*").alias("cells"), F.min("__n").alias("low")).first()
    if s["v"] < 2 or s["l"] < 2:
        raise Refused("single_class" if s["l"] < 2 else "single_value")
    if s["cells"] < s["v"] * s["l"]:
        raise Refused("empty_cell")
    return counts, s["low"]


def cell_balancer(df: DataFrame, ctx: Context, column: str, exclude_values: list[str] | None = None, label_column: str = "label") -> StepResult:
    """Every value-by-label cell comes down to the smallest cell of the whole table."""
    if column not in df.columns:
        raise Refused("invalid_balance_column")
    _labels(df, label_column)
    counts, cap = cell_cap(df, column, label_column, exclude_values)
    d = df.withColumn("__v", F.coalesce(F.col(column).cast("string"), F.lit(EMPTY))).withColumn("__l", F.col(label_column).cast("string"))
    r = drawn_rank(d, ["__v", "__l"], ctx.seed, "__rank", ctx.rank_digits)
    size = counts.select(F.col("__v").alias("__v2"), F.col("__l").alias("__l2"), F.col("__n").alias("__size"))
    r = r.join(size, (F.col("__v") == F.col("__v2")) & (F.col("__l") == F.col("__l2")), "left")
    return drop(r, [
        Reason(F.col("__v").isin(exclude_values or []), "value_excluded", column, text=F.col("__v")), Reason(F.col("__rank") >= cap, "cell_cap", "cell_size", F.col("__size"), threshold=f"sampled_to {cap}"),
    ], ["__v", "__l", "__rank", "__v2", "__l2", "__size"])


def extreme_values(df: DataFrame, column: str, label_column: str, rows: int = 50, share: float = 0.99) -> DataFrame:
    """Values of at least so many rows of which one label has nearly all."""
    c = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(EMPTY)).alias("value"), F.col(label_column).cast("string").alias("label")).agg(F.count("*").alias("n"))
    return c.groupBy("value").agg(F.sum("n").alias("rows"), F.max_by("label", F.struct("n", "label")).alias("top_label"), F.max("n").alias("top")).where((F.col("rows") >= rows) & (F.col("top") / F.col("rows") >= share))


def cap_clusters(df: DataFrame, ctx: Context, clusters: DataFrame, cap: int | None = None, cap_share: float | None = None, applies_to: str = "all") -> StepResult:
    """At most cap rows of each cluster. clusters: (row_key, cluster). For generated rows the default
    cap is the largest cluster of source rows."""
    d = df.join(clusters.select(F.col("row_key").alias("__k"), F.col("cluster").alias("__c")), F.col(KEY) == F.col("__k"), "left")
    pool = d.where(F.col(ORIGIN) == "generated") if applies_to == "generated" else d
    if cap is None and cap_share is not None:
        cap = max(1, math.floor(cap_share * pool.count()))
    if cap is None:
        if applies_to != "generated":
            raise Refused("params_invalid")
        cap = d.where(F.col(ORIGIN) == "source").groupBy("__c").count().agg(F.max("count")).first()[0] or 0
    d = d.withColumn("__in", F.lit(True) if applies_to == "all" else F.col(ORIGIN) == "generated")
    r = drawn_rank(d, ["__c", "__in"], ctx.seed, "__rank", ctx.rank_digits)
    return drop(r, [Reason(F.col("__in") & F.col("__c").isNotNull() & (F.col("__rank") >= cap), "cluster_cap", "cluster_size", F.col("__rank"), threshold=f"sampled_to {cap}")], ["__k", "__c", "__in", "__rank"])


def split_targets(n: int, fractions: list[float]) -> list[int]:
    """Rows of each split but the first: round half to even."""
    return [round(f * n) for f in fractions[1:]]


def split(
    df: DataFrame, ctx: Context, split_names: tuple = ("train", "test"), split_fractions: tuple = (0.9, 0.1), stratify_by: tuple = (), group_columns: tuple = (),
    directing_columns: tuple = (), held_out_values: tuple = (), held_out: tuple = ("test",), mode: str = "reassign", fold: str | None = None,
) -> StepResult:
    """Assign splits: per stratum, units in seeded order fill each split but the first to its target.

    A unit is a row, or a component of rows that share a value of any group column (null ties
    nothing); fold ('unicode' or 'ascii', see folded) ties other spellings of a value too. A stratum with fewer units than splits goes to the first split whole. Units with a
    row whose directing column holds a held-out value go to the first held-out split, before the
    rest is dealt. A generated row in a held-out split is refused. Units are numbered with their
    sizes accumulated in seeded order; a unit that would overshoot its target passes to the first.
    """
    if len(split_names) != len(split_fractions) or abs(sum(split_fractions) - 1) > 1e-6:
        raise Refused("params_invalid")
    if mode == "keep_source":
        return StepResult(df, _assigned(df, df))
    require(df, *stratify_by, *group_columns, *directing_columns)
    d = df.withColumn("__row", F.concat_ws(":", KEY, OCC))
    if group_columns:
        d = _units(d, group_columns, fold)
    else:
        d = d.withColumn("__unit", F.col("__row"))
    stratum = F.concat_ws("\x1f", F.lit("s"), *[F.coalesce(F.col(c).cast("string"), F.lit(EMPTY)) for c in stratify_by])
    directed = F.lit(False)
    for c in directing_columns:
        directed = directed | F.coalesce(F.col(c).cast("string").isin(list(held_out_values)), F.lit(False))
    units = d.groupBy("__unit").agg(F.count("*").alias("__size"), F.min(stratum).alias("__stratum"), F.max(directed).alias("__directed"), F.min(KEY).alias("__low"))
    units = units.withColumn("__draw", F.sha2(F.concat_ws(":", F.lit(str(ctx.seed)), "__unit"), 256))
    free = materialise(units.where("not __directed"), "units")
    per = free.groupBy("__stratum").agg(F.sum("__size").alias("__rows"), F.count("*").alias("__units"))
    line = Window.partitionBy("__stratum").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    b = F.substring("__draw", 1, 3)
    ahead = free.withColumn("__b", b).groupBy("__stratum", "__b").agg(F.sum("__size").alias("__n")).withColumn("__ahead", F.coalesce(F.sum("__n").over(line), F.lit(0))).drop("__n")
    inside = Window.partitionBy("__stratum", "__b").orderBy("__draw", "__unit").rowsBetween(Window.unboundedPreceding, -1)
    placed = free.withColumn("__b", b).withColumn("__in", F.coalesce(F.sum("__size").over(inside), F.lit(0))).join(ahead, ["__stratum", "__b"]).join(per, "__stratum")
    at = F.col("__in") + F.col("__ahead")
    choice, low = F.lit(split_names[0]), F.lit(0)
    for name, fraction in list(zip(split_names, split_fractions, strict=True))[1:]:
        high = low + F.bround(F.lit(fraction) * F.col("__rows")).cast("long")
        choice = F.when((at >= low) & (at + F.col("__size") <= high) & (F.col("__units") >= len(split_names)), name).otherwise(choice)
        low = high
    chosen = placed.select("__unit", choice.alias("__to")).unionByName(units.where("__directed").select("__unit", F.lit(held_out[0] if held_out else split_names[-1]).alias("__to")))
    out = d.join(chosen, "__unit")
    if held_out and out.where(F.col("__to").isin(list(held_out)) & (F.col(ORIGIN) == "generated")).limit(1).count():
        raise Refused("generated_in_held_out")
    done = out.withColumn(SPLIT, F.col("__to")).select(*df.columns)
    return StepResult(done, _assigned(df, done))


def folded(value: Column, how: str | None) -> Column:
    """A spelling that values share which differ in case and runs of white space only; None: the value.

    'unicode' takes all white space, and case by words. 'ascii' takes white space of ASCII without the
    vertical tab, spaces of any kind at the ends, and case letter by letter, as DuckDB's SQL does.
    """
    if how is None:
        return value
    if how == "ascii":
        return F.lower(F.translate(F.regexp_replace(F.regexp_replace(value, r"[ \t\n\f\r]+", " "), r"^\p{Zs}+|\p{Zs}+\z", ""), "Σİ", "σi"))
    if how == "unicode":
        return F.lower(collapse_whitespace(value))
    raise Refused("params_invalid", how)


def _units(d: DataFrame, group_columns: tuple, fold: str | None = None) -> DataFrame:
    """d with __unit: the smallest row or value node that its row's group values reach."""
    nodes = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"~{i}:"), folded(F.col(c).cast("string"), fold))) for i, c in enumerate(group_columns)]
    if len(nodes) == 1:
        return d.withColumn("__unit", F.coalesce(nodes[0], "__row"))
    edges = d.select(F.array_compact(F.array(*nodes)).alias("v")).where("size(v) > 1").distinct().select(F.col("v")[0].alias("src"), F.explode(F.slice("v", 2, 100)).alias("dst"))
    comps = connected_components(edges).select(F.col("node").alias("__node"), "root")
    first = d.withColumn("__first", F.coalesce(*nodes))
    return first.join(comps, F.col("__first") == F.col("__node"), "left").withColumn("__unit", F.coalesce("root", "__first", "__row")).drop("__first", "__node", "root")


def _assigned(before: DataFrame, after: DataFrame) -> DataFrame:
    none = F.lit(None)
    return after.select(
        F.lit("split_assigned").alias("kind"), F.col(KEY).alias("row_key"), F.col(OCC).alias("occurrence"), none.cast("string").alias("new_row_key"), none.cast("int").alias("new_occurrence"), none.cast("string").alias("related_row_key"),
        none.cast("array<string>").alias("parent_keys"), F.col(SPLIT).alias("split"), F.lit("split_assigned").alias("reason_code"), F.lit("split_assigned").alias("reason"), none.cast("string").alias("statistic_name"),
        none.cast("double").alias("statistic_value"), none.cast("string").alias("statistic_text"), none.cast("string").alias("threshold"),
    )


def move(df: DataFrame, ctx: Context, where, move_to: str, move_fraction: float, move_from: tuple = ("train",), group_columns: tuple = ()) -> StepResult:
    """Move a seeded share of the matching units to another split; a unit with a row outside move_from stays."""
    if not 0 < move_fraction <= 1:
        raise Refused("move_params_invalid")
    d = df.withColumn("__row", F.concat_ws(":", KEY, OCC))
    d = _units(d, group_columns) if group_columns else d.withColumn("__unit", F.col("__row"))
    units = d.groupBy("__unit").agg(F.max(F.coalesce(where, F.lit(False))).alias("hit"), F.min(F.col(SPLIT).isin(list(move_from))).alias("inside")).where("hit and inside")
    units = units.withColumn(KEY, F.col("__unit")).withColumn(OCC, F.lit(0))
    ranked = materialise(drawn_rank(units, [], ctx.seed, "__rank", ctx.rank_digits), "units")
    n = round(move_fraction * ranked.count())
    moved = ranked.where(F.col("__rank") < n).select(F.col("__unit").alias("__m"))
    out = d.join(moved, F.col("__unit") == F.col("__m"), "left").withColumn(SPLIT, F.when(F.col("__m").isNotNull(), move_to).otherwise(F.col(SPLIT)))
    events = _assigned(df, out.where(F.col("__m").isNotNull()))
    return StepResult(out.select(*df.columns), events)


def held_out_proof(df: DataFrame, columns: list[str], held_out: list[str], fold: str | None = "unicode") -> DataFrame:
    """Per column how many of its values, folded, stand on both sides; every count must be 0."""
    side = F.col(SPLIT).isin(held_out)
    one = None
    for c in columns:
        v = folded(F.col(c).cast("string"), fold)
        n = df.where(F.col(c).isNotNull()).groupBy(v.alias("v")).agg(F.max(side.cast("int")).alias("o"), F.min(side.cast("int")).alias("i")).agg(F.count("*").alias("values"), F.coalesce(F.sum((F.col("o") != F.col("i")).cast("long")), F.lit(0)).alias("shared"))
        n = n.select(F.lit(c).alias("column"), "values", "shared")
        one = n if one is None else one.unionByName(n)
    return one

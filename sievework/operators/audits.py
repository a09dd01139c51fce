"""Joins and reports around a version: what was excluded, what is unrecorded, what crosses splits,
pairs inside groups, cells and their samples, and checks that read every row and change none."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sievework.operators.filters import EMPTY
from sievework.operators.rows import KEY, OCC, SPLIT, Context, Refused, StepResult, content_text, draw, require, row_key
from sievework.sources.writers import canonical_json

#: Kinds of columns that a label may have.
_LABEL_KINDS = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def excluded_by_band(events: DataFrame, previous: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, rows): the values of rows that a labeller's band excluded, taken from the step's input.

    A column that the input lacks is left out; a null value is '(empty)'.
    """
    gone = events.where("kind = 'dropped' and reason_code = 'excluded_by_band'").select(F.col("row_key").alias("__k"), F.col("occurrence").alias("__o"))
    d = previous.join(gone, (F.col(KEY) == F.col("__k")) & (F.col(OCC) == F.col("__o")))
    known = [c for c in columns if c in previous.columns]
    if not known:
        raise Refused("column_not_found", ", ".join(columns))
    lines = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(EMPTY)).alias("value")) for c in known])
    return d.select(F.explode(lines).alias("l")).groupBy("l.column", "l.value").agg(F.count("*").alias("rows"))


def verify_keys(output: DataFrame, events: DataFrame, content: Sequence[str], composed: bool = False) -> DataFrame:
    """(row_key, occurrence, actual, matches): the keys of changed and added rows computed again.

    Of these events the first by (key, occurrence), a hundredth but at least a hundred, are checked:
    the limit is the report's own.
    """
    moved = events.where("kind in ('changed', 'added')").select(F.coalesce("new_row_key", "row_key").alias("__k"), F.coalesce("new_occurrence", "occurrence").alias("__o"))
    targets = moved.orderBy("__k", "__o").limit(max(100, moved.count() // 100))
    d = output.join(targets, (F.col(KEY) == F.col("__k")) & (F.col(OCC) == F.col("__o")))
    return d.withColumn("actual", row_key(d, content, composed)).select(F.col(KEY).alias("row_key"), F.col(OCC).alias("occurrence"), "actual", (F.col("actual") == F.col(KEY)).alias("matches"))


def unrecorded_rows(df: DataFrame, recorded: DataFrame) -> DataFrame:
    """Rows whose key no record has, in key order. recorded: (row_key)."""
    return df.join(recorded.select(F.col("row_key").alias("__k")).distinct(), F.col(KEY) == F.col("__k"), "left_anti").orderBy(KEY, OCC)


def row_cap(df: DataFrame, cap: int) -> DataFrame:
    """All copies of the first cap keys."""
    first = df.select(F.col(KEY).alias("__k")).distinct().orderBy("__k").limit(cap)
    return df.join(first, F.col(KEY) == F.col("__k"), "left_semi")


def held_out_overlap(held: DataFrame, others: DataFrame, shown: int = 20) -> DataFrame:
    """(shared_keys, sample): distinct keys of held that others hold too, and the first few of them."""
    shared = held.select(KEY).distinct().join(others.select(KEY).distinct(), KEY)
    first = shared.orderBy(KEY).limit(shown).agg(F.array_sort(F.collect_list(KEY)).alias("sample"))
    return shared.agg(F.count("*").alias("shared_keys")).crossJoin(first)  # one row each


def excerpt(text: Column, most: int = 160) -> Column:
    """The text on one line, cut to `most` characters of which the last is then an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def list_lengths(df: DataFrame, column: str) -> DataFrame:
    """(rows, nulls, shortest, longest, mean): the lengths of a list column; null lists count as nulls."""
    n = F.when(F.col(column).isNotNull(), F.size(column))
    return df.agg(F.count("*").alias("rows"), F.count(F.when(n.isNull(), 1)).alias("nulls"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.avg(n).alias("mean"))


def leakage_pairs(df: DataFrame, content: Sequence[str], group_column: str | None = None, near: DataFrame | None = None) -> DataFrame:
    """(kind, key_a, side_a, key_b, side_b, similarity, excerpt_a, excerpt_b): what crosses splits.

    Exact texts pair through one key a side (the smallest of that text), so copies cost no pairs of
    their own; group values likewise; near pairs (a, b, estimate) as given. Blank texts never match.
    key_a stands in the lesser split's name.
    """
    text = content_text(df, content)
    base = df.select(KEY, SPLIT, text.alias("__t"))
    shown = base.groupBy(KEY).agg(F.min("__t").alias("__t")).select(F.col(KEY).alias("__k"), excerpt(F.col("__t")).alias("__e"))

    def crossing(kind: str, rows: DataFrame) -> DataFrame:
        one = rows.where("v is not null").groupBy("v", SPLIT).agg(F.min(KEY).alias("k"))
        a, b = (one.select("v", F.col(SPLIT).alias(f"side_{s}"), F.col("k").alias(f"key_{s}")) for s in "ab")
        return a.join(b, "v").where("side_a < side_b").select(F.lit(kind).alias("kind"), "key_a", "side_a", "key_b", "side_b", F.lit(1.0).alias("similarity"))

    pairs = crossing("exact", base.where(F.length(F.trim("__t")) > 0).select(F.sha2("__t", 256).alias("v"), SPLIT, KEY))
    if group_column:
        pairs = pairs.unionByName(crossing("group", df.select(F.col(group_column).cast("string").alias("v"), SPLIT, KEY)))
    if near is not None:
        s = df.select(KEY, SPLIT).distinct()
        j = near.join(s.select(F.col(KEY).alias("a"), F.col(SPLIT).alias("sa")), "a").join(s.select(F.col(KEY).alias("b"), F.col(SPLIT).alias("sb")), "b").where("sa <> sb and a <> b")
        low = F.col("sa") < F.col("sb")
        pairs = pairs.unionByName(j.select(F.lit("near").alias("kind"), *[F.when(low, x).otherwise(F.col(y)).alias(n) for x, y, n in ((F.col("a"), "b", "key_a"), (F.col("sa"), "sb", "side_a"), (F.col("b"), "a", "key_b"), (F.col("sb"), "sa", "side_b"))], F.col("estimate").alias("similarity")))
    ea, eb = (shown.select(F.col("__k").alias(f"key_{s}"), F.col("__e").alias(f"excerpt_{s}")) for s in "ab")
    return pairs.join(ea, "key_a").join(eb, "key_b").select("kind", "key_a", "side_a", "key_b", "side_b", "similarity", "excerpt_a", "excerpt_b")


def paired_counts(df: DataFrame, group: str, positive: Column, score: str, stratum: str | None = None) -> DataFrame:
    """(pairs, wins): positive-negative pairs of rows in one group and stratum, and those that the score
    orders right, ties a half. No pair is made: both come from counts of equal scores."""
    by = [F.col(group).alias("g"), (F.col(stratum).cast("string") if stratum else F.lit("")).alias("s")]
    c = df.where(F.col(group).isNotNull() & F.col(score).isNotNull() & positive.isNotNull()).groupBy(*by, F.col(score).cast("double").alias("x")).agg(F.count(F.when(positive, 1)).alias("p"), F.count(F.when(~positive, 1)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("g", "s").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = c.withColumn("below", below).groupBy("g", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("w"))
    return t.agg(F.coalesce(F.sum(F.col("p") * F.col("n")), F.lit(0)).alias("pairs"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("wins"))


def reference_pairs(df: DataFrame, group: str, is_reference: Column, positive: Column, score: str, order: str) -> DataFrame:
    """(label, rows, wins): rows that score strictly over their group's reference, by label.

    A group's reference is its first reference row by order. Reference rows themselves, rows without a
    label and groups without a reference take no part.
    """
    d = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), is_reference.alias("ref"), positive.alias("y"), F.col(score).cast("double").alias("s"), F.col(order).alias("o"))
    first = d.where("ref").groupBy("g").agg(F.min_by("s", "o").alias("at"))
    return d.where("not coalesce(ref, false) and y is not null").join(first, "g").groupBy(F.col("y").cast("int").alias("label")).agg(F.count("*").alias("rows"), F.count(F.when(F.col("s") > F.col("at"), 1)).alias("wins"))


def two_valued_columns(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(column, type, low, high) of columns with exactly two values that could be labels: booleans first,
    then names with 'label', then by name. One pass: a column's least and greatest value, and whether
    any other stands between."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, _LABEL_KINDS) and not f.name.startswith("_dw_") and f.name not in exclude]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, type string, low string, high string")
    ends = df.agg(*[x for c in names for x in (F.min(F.col(c).cast("string")).alias(f"{c}__low"), F.max(F.col(c).cast("string")).alias(f"{c}__high"))])
    d = df.select(*[F.col(c).cast("string").alias(c) for c in names]).crossJoin(F.broadcast(ends))  # one row
    other = d.agg(*[F.coalesce(F.max((F.col(c) != F.col(f"{c}__low")) & (F.col(c) != F.col(f"{c}__high"))), F.lit(False)).alias(c) for c in names], *[F.max(f"{c}__{e}").alias(f"{c}__{e}") for c in names for e in ("low", "high")])
    kinds = dict(df.dtypes)
    lines = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(f"{c}__low").alias("low"), F.col(f"{c}__high").alias("high"), F.col(c).alias("__more")) for c in names])
    found = other.select(F.explode(lines).alias("l")).select("l.*").where("not __more and low <> high").drop("__more")
    return found.orderBy(F.col("type") != "boolean", ~F.lower("column").contains("label"), "column")


def cell_sample(df: DataFrame, content: Sequence[str], column: str, value: str, label_column: str, label: str, seed: int = 0, sample_size: int = 30, page: int = 0, limit: int = 30) -> DataFrame:
    """(place, row_key, occurrence, label, excerpt): a page of a cell's seeded sample; the same seed shows the same rows."""
    require(df, column, label_column, code="cell_not_found")
    cell = df.where((F.coalesce(F.col(column).cast("string"), F.lit(EMPTY)) == value) & (F.col(label_column).cast("string") == label))
    drawn = cell.withColumn("__d", draw(seed)).orderBy("__d", KEY, OCC).limit(sample_size)
    at = drawn.withColumn("place", F.row_number().over(Window.orderBy("__d", KEY, OCC)) - 1)  # sample_size rows
    return at.where((F.col("place") >= page * limit) & (F.col("place") < (page + 1) * limit)).select("place", F.col(KEY).alias("row_key"), F.col(OCC).alias("occurrence"), F.col(label_column).cast("string").alias("label"), excerpt(content_text(df, content)).alias("excerpt"))


def balancer_preview(df: DataFrame, column: str, label_column: str = "label", exclude_values: Sequence[str] = ()) -> DataFrame:
    """(value, label, before, kept, cap): what cell_balancer would leave of each cell. Refusals are its own."""
    from sievework.operators.selection import cell_cap

    require(df, column, label_column, code="invalid_balance_column")
    if df.where(F.col(label_column).isNull()).limit(1).count():
        raise Refused("label_has_nulls")
    counts, cap = cell_cap(df, column, label_column, list(exclude_values))
    return counts.select(F.col("__v").alias("value"), F.col("__l").alias("label"), F.col("__n").alias("before"), F.least("__n", F.lit(cap)).alias("kept"), F.lit(cap).cast("long").alias("cap"))


def balance_check(before: DataFrame, after: DataFrame, columns: Sequence[str], label_column: str = "label") -> DataFrame:
    """(column, before, after): how unevenly a label falls on a column's values, before and after a balancer:
    the largest share of one label in a value less that label's share of all rows."""

    def worst(df: DataFrame, c: str) -> DataFrame:
        cells = df.where(F.col(label_column).isNotNull()).groupBy(F.coalesce(F.col(c).cast("string"), F.lit(EMPTY)).alias("v"), F.col(label_column).cast("string").alias("l")).agg(F.count("*").alias("n"))
        per = cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("v"))).withColumn("all", F.sum("n").over(Window.partitionBy("l")) / F.sum("n").over(Window.partitionBy()))  # one row a cell
        return per.agg(F.max(F.col("share") - F.col("all")).alias("x"))

    lines = [worst(before, c).select(F.lit(c).alias("column"), F.col("x").alias("before")).crossJoin(worst(after, c).select(F.col("x").alias("after"))) for c in columns]
    out = lines[0]
    for x in lines[1:]:
        out = out.unionByName(x)
    return out


def label_balance(a: DataFrame, b: DataFrame, label_column: str = "label") -> DataFrame:
    """(split, label, rows_a, rows_b, share_a, share_b) of two versions."""
    def one(d: DataFrame, s: str) -> DataFrame:
        c = d.groupBy(F.col(SPLIT).alias("split"), F.coalesce(F.col(label_column).cast("string"), F.lit(EMPTY)).alias("label")).agg(F.count("*").alias(f"rows_{s}"))
        return c.withColumn(f"share_{s}", F.col(f"rows_{s}") / F.sum(f"rows_{s}").over(Window.partitionBy("split")))

    return one(a, "a").join(one(b, "b"), ["split", "label"], "full").fillna(0).select("split", "label", "rows_a", "rows_b", "share_a", "share_b")


def drop_log_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(kind, reason_code, rows_a, rows_b) of two versions' events, where they differ."""
    c = lambda d, s: d.groupBy("kind", "reason_code").agg(F.count("*").alias(f"rows_{s}"))
    return c(a, "a").join(c(b, "b"), ["kind", "reason_code"], "full").fillna(0).where("rows_a <> rows_b").select("kind", "reason_code", "rows_a", "rows_b")


def top_values_compared(a: DataFrame, b: DataFrame, column: str, n: int = 20) -> DataFrame:
    """(value, rows_a, rows_b): the n most frequent values of both together, and 'other'."""
    both = a.select(F.lit("a").alias("s"), F.col(column).cast("string").alias("v")).unionByName(b.select(F.lit("b").alias("s"), F.col(column).cast("string").alias("v")))
    counts = both.groupBy("v").agg(F.count(F.when(F.col("s") == "a", 1)).alias("rows_a"), F.count(F.when(F.col("s") == "b", 1)).alias("rows_b"))
    top = counts.orderBy(F.desc(F.col("rows_a") + F.col("rows_b")), F.asc_nulls_last("v")).limit(n).select(F.col("v").alias("__v"), F.lit(True).alias("__top"))
    named = counts.join(F.broadcast(top), F.col("v").eqNullSafe(F.col("__v")), "left")  # n rows
    return named.groupBy(F.when(F.col("__top"), F.coalesce("v", F.lit(EMPTY))).otherwise("other").alias("value")).agg(F.sum("rows_a").alias("rows_a"), F.sum("rows_b").alias("rows_b"))


def embedding_groups(vectors: DataFrame, threshold: float = 0.95, most: int = 200_000) -> DataFrame:
    """(size, groups): groups of vectors tied by cosines at or over the threshold. Refused over `most` vectors."""
    from sievework.operators.components import connected_components
    from sievework.operators.selection import cosine_pairs

    if vectors.count() > most:
        raise Refused("too_many_rows")
    comps = connected_components(cosine_pairs(vectors, threshold), "a", "b")
    return comps.groupBy("root").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def assign_to_centroids(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(key, cluster, distance): the nearest stored centre of each vector, ties to the smaller number.

    vectors: (key, vector). centroids: (cluster, centre), as many rows as clusters, broadcast whole.
    Null vectors take no part.
    """
    far = lambda c: F.sqrt(F.aggregate(F.zip_with("v", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    table = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster", F.col("centre").cast("array<double>").alias("centre")))).alias("cs"))
    d = vectors.where("vector is not null").select("key", F.col("vector").cast("array<double>").alias("v")).crossJoin(F.broadcast(table))  # one row
    near = d.select("key", F.array_min(F.transform("cs", lambda c: F.struct(far(c["centre"]).alias("distance"), c["cluster"].alias("cluster")))).alias("n"))
    return near.select("key", "n.cluster", "n.distance")


def cluster_coverage(clusters: DataFrame, reference_clusters: int) -> DataFrame:
    """(occupied, largest): the share of the reference's clusters that hold a row, and the largest's share of rows."""
    c = clusters.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("n"))
    empty = F.lit(0.0)
    return c.agg(F.when(F.lit(reference_clusters > 0), F.count("*") / F.lit(max(1, reference_clusters))).otherwise(empty).alias("occupied"), F.coalesce(F.max("n") / F.sum("n"), empty).alias("largest"))


def length_points(df: DataFrame, column: str, bins: int = 30) -> tuple[DataFrame, DataFrame]:
    """(1,001 per-mille points of a length, counts of equal bins over 0 to its 99th percentile).

    Longer rows stand in no bin; percentile points interpolate.
    """
    points = df.agg(F.percentile(F.col(column), F.array(*[F.lit(i / 1000) for i in range(1001)])).alias("q")).select(F.posexplode("q").alias("permille", "value"))
    top = df.agg(F.percentile(F.col(column), F.lit(0.99)).alias("top"))
    d = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(top)).where(F.col(column) <= F.col("top"))  # one row
    at = F.when(F.col("top") > 0, F.least(F.floor(F.col(column) / F.col("top") * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    return points, d.groupBy(at.alias("bin")).agg(F.count("*").alias("rows"))


def swap_and_agree(first: Column, swapped: Column) -> Column:
    """A pairwise verdict asked in both orders, the second mapped back."""
    return F.when(first.isNull() | swapped.isNull(), "parse_failure").when(first == swapped, first).otherwise("position_inconsistent")


def aggregate_verdict(df: DataFrame, row: str, verdict: str) -> DataFrame:
    """(row, verdict, flag) over several judges' lines: unanimous, a majority (flagged), or a tie (excluded).

    Missing verdicts do not vote; no vote at all is excluded.
    """
    c = df.groupBy(F.col(row).alias("row"), F.col(verdict).alias("v")).agg(F.count("*").alias("n"))
    g = c.groupBy("row").agg(F.sum("n").alias("asked"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("votes"), F.max(F.when(F.col("v").isNotNull(), F.struct("n", "v"))).alias("best"), F.count("v").alias("kinds"))
    tops = c.where("v is not null").join(g.select("row", F.col("best.n").alias("top")), "row").where("n = top").groupBy("row").agg(F.count("*").alias("tops"))
    g = g.join(tops, "row", "left")
    tie = F.coalesce(F.col("tops"), F.lit(0)) > 1
    return g.select("row", F.when((F.col("votes") == 0) | tie, "excluded").otherwise(F.col("best.v")).alias("verdict"), F.when(F.col("votes") == 0, "no_verdicts").when(tie | (F.col("kinds") > 1), "disagreement").when(F.col("votes") < F.col("asked"), "missing_verdict").alias("flag"))


def labeler_identity(protocol: str, model_id: str, model_revision: str | None, template_ref: str, question: str | None) -> dict:
    """What calibration of a labeller is kept under; a revision that was not given is never filled in."""
    return {"protocol": protocol, "model_id": model_id, "model_revision": "not reported" if model_revision is None else model_revision, "template": template_ref, "question": question}


def fingerprint(identity: dict, sampling: dict, structured_output: str, packing: str) -> str:
    """Digest of everything that changes a probability; thresholds do not."""
    return hashlib.sha256(canonical_json({"identity": identity, "sampling": sampling, "structured_output": structured_output, "packing": packing})).hexdigest()


def code_rule(df: DataFrame, rule: Callable[[dict], int | str | None], columns: Sequence[str], output: str = "code_rule") -> DataFrame:
    """df with a rule's answer per row in `output`: struct (count, reason).

    rule is called with a dict of the named columns and gives a count, a string that says why it gives
    none, or null. An exception becomes the reason. Rules run in the workers, batch by batch.
    """
    require(df, *columns)

    @F.pandas_udf("count long, reason string")
    def ask(cells: pd.DataFrame) -> pd.DataFrame:
        counts, reasons = [], []
        for row in cells.to_dict("records"):
            try:
                got = rule({k: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v for k, v in row.items()})
            except Exception as e:  # a rule is its author's code
                got = f"{type(e).__name__}: {e}"
            counts.append(int(got) if isinstance(got, (int, bool)) else None)
            reasons.append(got if isinstance(got, str) else None)
        return pd.DataFrame({"count": pd.array(counts, dtype="Int64"), "reason": pd.array(reasons, dtype="object")})

    return df.withColumn(output, ask(F.struct(*[F.col(c) for c in columns])))


def run_check(df: DataFrame, ctx: Context, operator: Callable[..., StepResult], params: dict | None = None) -> dict:
    """A check operator over every row of a version: {'result': 'pass', 'rows': n} or its refusal.

    A check that changes, drops or adds a row, or a column, is itself refused.
    """
    n = df.count()
    try:
        r = operator(df, ctx, **(params or {}))
        moved = [] if r.events is None else [x[0] for x in r.events.select("kind").distinct().collect()]  # at most four
    except Refused as e:
        return {"result": "refused", "code": e.code, "message": str(e), "rows": n}
    if moved or r.output.columns != df.columns or r.output.count() != n:
        raise Refused("check_changed_rows", ", ".join([*moved, *sorted(set(r.output.columns) ^ set(df.columns))]))
    return {"result": "pass", "rows": n}


def partition_roles(df: DataFrame, roles: dict[str, str], text_column: str, min_chars: int = 1) -> DataFrame:
    """(split, role, rows, too_short, shared_keys): what split@1.3.0 checks of its marked splits.

    roles: split -> 'practice' or 'held_out'. shared_keys: keys of a held-out split that any other split
    has; too_short: rows of under min_chars characters.
    """
    if not roles or set(roles.values()) - {"practice", "held_out"}:
        raise Refused("params_invalid", "roles")
    require(df, text_column)
    role = F.coalesce(*[F.when(F.col(SPLIT) == s, F.lit(r)) for s, r in roles.items()])
    spread = df.groupBy(KEY).agg(F.countDistinct(SPLIT).alias("__n")).where("__n > 1").select(F.col(KEY).alias("__k"))
    short = F.length(F.coalesce(F.col(text_column).cast("string"), F.lit(""))) < min_chars
    rows = df.groupBy(SPLIT).agg(F.count("*").alias("rows"), F.count(F.when(short, 1)).alias("too_short"))
    shared = df.select(SPLIT, KEY).distinct().join(spread, F.col(KEY) == F.col("__k")).groupBy(F.col(SPLIT).alias("__s")).agg(F.count("*").alias("m"))
    d = rows.join(shared, F.col(SPLIT) == F.col("__s"), "left").select(F.col(SPLIT).alias("split"), role.alias("role"), "rows", "too_short", F.when(role == "held_out", F.coalesce("m", F.lit(0))).otherwise(0).cast("long").alias("shared_keys"))
    return d.where("role is not null")


def split_marked(df: DataFrame, ctx: Context, split_names=("train", "test"), split_fractions=(0.9, 0.1), roles: dict | None = None, text_column: str = "text", min_chars: int = 1, **rest) -> StepResult:
    """split@1.3.0: split@1.1.0 with practice and held-out splits marked, refused where one holds too short
    a row or a held-out one shares a key with another."""
    from sievework.operators.selection import split

    r = split(df, ctx, split_names, split_fractions, **rest)
    if roles:
        bad = partition_roles(r.output, roles, text_column, min_chars).where("too_short > 0 or shared_keys > 0").first()
        if bad is not None:
            raise Refused("held_out_overlap" if bad["shared_keys"] else "text_too_short", bad["split"])
    return r


def model_identity(name: Column) -> Column:
    """A model's name without its revision: what follows the last @ goes, or else the last colon."""
    return F.when(F.contains(name, F.lit("@")), F.regexp_replace(name, "@[^@]*$", "")).otherwise(F.regexp_replace(name, ":[^:]*$", ""))


#: Checks before a version is published; only the second can stop it, the others are shown.
PUBLISH_CHECKS = ("C-1", "C-2", "C-3", "C-4", "C-5", "C-6", "C-7", "C-8", "C-9")


def publish_gate(facts: dict) -> dict[str, str]:
    """Check -> 'green', 'amber', 'refused' or 'not_checked', from facts; a missing fact is not checked.

    licences (source -> may be redistributed), can_write, held_out_pairs (near pairs into a held-out
    split; 0 where there is none), model_terms (models -> terms known), audit_done, calibrated (labeller ->
    has a record), audit (rows of shortcut_audit), private_rule_sets, visibility (floor, wanted).
    """
    rules = {
        "C-1": ("licences", lambda x: all(x.values())), "C-3": ("held_out_pairs", lambda x: x == 0), "C-4": ("model_terms", lambda x: all(x.values())), "C-5": ("audit_done", bool),
        "C-6": ("calibrated", lambda x: all(x.values())), "C-7": ("audit", lambda x: not any(r["warn"] or r["invalid"] for r in x)), "C-8": ("private_rule_sets", lambda x: x == 0),
        "C-9": ("visibility", lambda x: x[0] != "private_only" or x[1] == "private"),
    }
    out = {k: "not_checked" if facts.get(fact) is None else "green" if good(facts[fact]) else "amber" for k, (fact, good) in rules.items()}
    out["C-2"] = "not_checked" if facts.get("can_write") is None else "green" if facts["can_write"] else "refused"
    return {k: out[k] for k in PUBLISH_CHECKS}


def may_publish(gate: dict[str, str], acknowledged: Sequence[str] = ()) -> bool:
    """No refusal, and every amber check named by the one who publishes."""
    return "refused" not in gate.values() and all(k in acknowledged for k, v in gate.items() if v == "amber")

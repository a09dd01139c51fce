"""Rows, their identity, and the accounting of what a step does to them."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# Fixed values of the row format: the key scheme and the reserved columns.
KEY_SCHEME = "dw.rowkey/v1"
KEY, OCC, SPLIT, ORIGIN, SOURCE, LOCATOR, PARENTS = (
    "_dw_row_key", "_dw_occurrence", "_dw_split", "_dw_origin", "_dw_source_id", "_dw_source_locator", "_dw_parent_keys",
)
SYSTEM = (KEY, OCC, SPLIT, ORIGIN, SOURCE, LOCATOR, PARENTS)

EVENT_SCHEMA = T.StructType([
    T.StructField(n, t) for n, t in (
        ("kind", T.StringType()), ("row_key", T.StringType()), ("occurrence", T.IntegerType()), ("new_row_key", T.StringType()), ("new_occurrence", T.IntegerType()),
        ("related_row_key", T.StringType()), ("parent_keys", T.ArrayType(T.StringType())), ("split", T.StringType()), ("reason_code", T.StringType()), ("reason", T.StringType()),
        ("statistic_name", T.StringType()), ("statistic_value", T.DoubleType()), ("statistic_text", T.StringType()), ("threshold", T.StringType()),
    )
])


class Refused(ValueError):
    """A step that cannot run on its input or parameters; code names why."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


@dataclass
class StepResult:
    output: DataFrame
    events: DataFrame | None = None
    report: dict = field(default_factory=dict)


@dataclass
class Context:
    """content: the columns that identify a row. seed: of the step. inputs: side tables by name."""

    content: Sequence[str] = ("text",)
    seed: int = 0
    inputs: dict = field(default_factory=dict)
    #: More buckets let ranks spread wider; they change no result.
    rank_digits: int = 3


def require(df: DataFrame, *columns: str, code: str = "column_not_found") -> None:
    for c in columns:
        if c not in df.columns:
            raise Refused(code, c)


def as_text(df: DataFrame, column: str) -> Column:
    """A cell's text: null is empty, a chat is its contents joined by line feeds."""
    require(df, column)
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.coalesce(F.array_join(F.transform(F.col(column), lambda m: F.coalesce(m["content"], F.lit(""))), "\n"), F.lit(""))
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def content_text(df: DataFrame, content: Sequence[str]) -> Column:
    return F.concat_ws("\n", *[as_text(df, c) for c in content])


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: an expression inside a lambda would run per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of an array, repeats kept; none if it is shorter."""
    made = lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return let(tokens, made)


def repeated_share(items: Column) -> Column:
    """Share of an array's items that stand in it more than once; 0 if it is empty. One pass over the sorted array."""
    start = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("rep"), F.lit(0).alias("n"))

    def step(a, x):
        same = F.coalesce(a["prev"] == x, F.lit(False))
        return F.struct(x.alias("prev"), F.when(same, a["run"] + 1).otherwise(1).alias("run"), (a["rep"] + F.when(~same, 0).when(a["run"] == 1, 2).otherwise(1)).alias("rep"), (a["n"] + 1).alias("n"))

    return F.aggregate(F.array_sort(items), start, step, lambda a: F.when(a["n"] > 0, a["rep"] / a["n"]).otherwise(F.lit(0.0)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", "")


def collapse_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[\s\p{Z}\x1c-\x1f\x85]+", " "))


def _plain(value):
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value).replace("\r\n", "\n").replace("\r", "\n").strip()
    if value is None or isinstance(value, (bool, int)):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise Refused("rowkey_unsupported_type", "non-finite float")
        return value
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if hasattr(value, "tolist"):
        return _plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    raise Refused("rowkey_unsupported_type", type(value).__name__)


def row_key_of(content: dict) -> str:
    """The key of one row from its content cells."""
    body = json.dumps({c: _plain(content[c]) for c in sorted(content)}, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return hashlib.sha256(f"{KEY_SCHEME}\n{body}".encode()).hexdigest()


def row_key(df: DataFrame, content: Sequence[str], composed: bool = False) -> Column:
    """Key column of df's rows. composed: all text is known to be in NFC, so that string columns
    need no Python: then the key is built-in expressions alone."""
    if not content:
        raise Refused("no_content_column")
    require(df, *content, code="rowkey_missing_column")
    kinds = [df.schema[c].dataType for c in content]
    if any(isinstance(k, (T.DecimalType, T.DateType, T.TimestampType, T.BinaryType)) for k in kinds):
        raise Refused("rowkey_unsupported_type")
    if composed and all(isinstance(k, T.StringType) for k in kinds):
        def cell(c: str) -> Column:
            body = F.to_json(F.struct(strip(F.regexp_replace(c, "\r\n?", "\n")).alias("v")))
            return F.concat(F.lit(f"{json.dumps(c, ensure_ascii=False)}:"), F.when(F.col(c).isNull(), "null").otherwise(F.substring(body, F.lit(6), F.length(body) - 6)))

        cells = [cell(c) for c in sorted(content)]
        return F.sha2(F.concat(F.lit(f"{KEY_SCHEME}\n{{"), F.concat_ws(",", *cells), F.lit("}")), 256)

    @F.pandas_udf("string")
    def keys(cells: pd.DataFrame) -> pd.Series:
        names = list(cells.columns)
        return pd.Series([row_key_of({n: None if not isinstance(v, (list, dict)) and not hasattr(v, "tolist") and pd.isna(v) else v for n, v in zip(names, row)}) for row in cells.itertuples(index=False, name=None)], dtype=object)

    return keys(F.struct(*[F.col(c) for c in sorted(content)]))


def rank_within(df: DataFrame, keys: list[str], order: list, bucket: Column, name: str) -> DataFrame:
    """0-based place of each row within its keys by order, as column `name`.

    bucket never decreases along order. Rows are numbered inside (keys, bucket) and buckets are
    offset by their counts, so that a key with a third of all rows still spreads over many tasks.
    """
    b, inside, ahead = "__bucket", "__inside", "__ahead"
    d = df.withColumn(b, bucket).withColumn(inside, F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)) - 1)
    line = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    before = df.withColumn(b, bucket).groupBy(*keys, b).agg(F.count("*").alias("__n")).withColumn(ahead, F.coalesce(F.sum("__n").over(line), F.lit(0)))
    before = before.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(b).alias("__kb"), ahead)
    same = reduce(lambda x, y: x & y, [d[k].eqNullSafe(before[f"__k{i}"]) for i, k in enumerate(keys)], d[b].eqNullSafe(before["__kb"]))
    return d.join(before, same).select(*[d[c] for c in df.columns], (F.col(inside) + F.col(ahead)).cast("long").alias(name))


def draw(seed: int, *parts: str) -> Column:
    """Hex digest by which a seeded draw orders rows: of the seed, the row key and the occurrence."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in (parts or (KEY, OCC))]), 256)


def drawn_rank(df: DataFrame, keys: list[str], seed: int, name: str, digits: int = 3) -> DataFrame:
    """Place of each row within keys in the seeded order."""
    d = df.withColumn("__draw", draw(seed))
    return rank_within(d, keys, ["__draw", KEY, OCC], F.substring("__draw", 1, digits), name).drop("__draw")


def assemble(parts: Sequence[tuple[str, str, DataFrame]], content: Sequence[str], order: str, composed: bool = False, origin: str = "source") -> DataFrame:
    """Ordered union of (source id, split, frame) parts with the system columns.

    Columns unite by name in the order they first appear; a clash of types is refused, but an
    all-null column takes the other's type. order: a numeric column that orders a part's rows; the
    locator and the numbering of occurrences follow it.
    """
    kinds: dict[str, T.DataType] = {}
    for _, _, df in parts:
        for f in df.schema.fields:
            old = kinds.get(f.name)
            if old is None or isinstance(old, T.NullType):
                kinds[f.name] = f.dataType
            elif old != f.dataType and not isinstance(f.dataType, T.NullType):
                raise Refused("input_schema_conflict", f.name)
    frames = []
    for i, (source, split, df) in enumerate(parts):
        cols = [(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
        one = df.select(*cols)
        frames.append(one.select("*", F.lit(split).alias(SPLIT), F.lit(origin).alias(ORIGIN), F.lit(source).alias(SOURCE), F.concat_ws(":", F.lit(split), F.col(order).cast("string")).alias(LOCATOR), F.lit(i).alias("__part")))
    both = reduce(DataFrame.unionByName, frames)
    both = both.withColumn(KEY, row_key(both, content, composed))
    place = F.col("__part").cast("long") * F.lit(1 << 40) + F.col(order).cast("long")
    ranked = rank_within(both.withColumn("__place", place), [KEY], ["__place"], F.expr("__place div 100000"), OCC)
    user = [c for c in kinds if c not in SYSTEM]
    return ranked.select(*user, KEY, F.col(OCC).cast("int").alias(OCC), SPLIT, ORIGIN, SOURCE, LOCATOR, F.array().cast("array<string>").alias(PARENTS))


@dataclass
class Reason:
    """Rows where `when` holds drop with this reason; the first that holds counts."""

    when: Column
    code: str
    statistic: str = ""
    value: Column | None = None
    text: Column | None = None
    threshold: Column | str | None = None
    related: Column | None = None


def drop(df: DataFrame, reasons: Sequence[Reason], extra: Sequence[str] = ()) -> StepResult:
    """Output and events of a step that drops rows, from one decision per row; so they cannot differ.

    extra: helper columns of df that do not belong to the output.
    """
    none = F.lit(None)
    col = lambda x, kind: (x if isinstance(x, Column) else F.lit(x) if x is not None else none).cast(kind)
    decided = none.cast("struct<code:string,statistic:string,value:double,text:string,threshold:string,related:string>")
    for r in reversed(reasons):
        what = F.struct(F.lit(r.code).alias("code"), F.lit(r.statistic).alias("statistic"), col(r.value, "double").alias("value"), col(r.text, "string").alias("text"), col(r.threshold, "string").alias("threshold"), col(r.related, "string").alias("related"))
        decided = F.when(F.coalesce(r.when, F.lit(False)), what).otherwise(decided)
    d = df.withColumn("__why", decided)
    output = d.where("__why is null").drop("__why", *extra)
    events = d.where("__why is not null").select(
        F.lit("dropped").alias("kind"), F.col(KEY).alias("row_key"), F.col(OCC).alias("occurrence"), none.cast("string").alias("new_row_key"), none.cast("int").alias("new_occurrence"),
        F.col("__why.related").alias("related_row_key"), none.cast("array<string>").alias("parent_keys"), F.col(SPLIT).alias("split"), F.col("__why.code").alias("reason_code"),
        F.concat_ws(" ", F.col("__why.statistic"), F.coalesce(F.col("__why.value").cast("string"), F.col("__why.text")), F.col("__why.threshold")).alias("reason"),
        F.col("__why.statistic").alias("statistic_name"), F.col("__why.value").alias("statistic_value"), F.col("__why.text").alias("statistic_text"), F.col("__why.threshold").alias("threshold"),
    )
    return StepResult(output, events)


def changes(before: DataFrame, after: DataFrame, code: str) -> DataFrame:
    """Events for rows whose key changed: after has the old pair in __old_key and __old_occ."""
    none = F.lit(None)
    moved = after.where((F.col("__old_key") != F.col(KEY)) | (F.col("__old_occ") != F.col(OCC)))
    return moved.select(
        F.lit("changed").alias("kind"), F.col("__old_key").alias("row_key"), F.col("__old_occ").alias("occurrence"), F.col(KEY).alias("new_row_key"), F.col(OCC).alias("new_occurrence"), none.cast("string").alias("related_row_key"),
        F.array("__old_key").alias("parent_keys"), F.col(SPLIT).alias("split"), F.lit(code).alias("reason_code"), F.lit(code).alias("reason"), none.cast("string").alias("statistic_name"), none.cast("double").alias("statistic_value"), none.cast("string").alias("statistic_text"), none.cast("string").alias("threshold"),
    )


def rekey(df: DataFrame, content: Sequence[str], composed: bool = False) -> DataFrame:
    """df with keys computed anew, and the old pair in __old_key and __old_occ.

    A changed row takes the smallest occurrence that no unchanged row of the key holds.
    """
    d = df.withColumn("__old_key", F.col(KEY)).withColumn("__old_occ", F.col(OCC)).withColumn(KEY, row_key(df, content, composed))
    same = d.where(F.col(KEY) == F.col("__old_key"))
    new = d.where(F.col(KEY) != F.col("__old_key"))
    taken = same.join(new.select(F.col(KEY).alias("__k")).distinct(), F.col(KEY) == F.col("__k"), "left_semi").groupBy(F.col(KEY).alias("__k")).agg(F.collect_set(OCC).alias("__taken"))
    ranked = rank_within(new, [KEY], ["__old_key", "__old_occ"], F.substring("__old_key", 1, 3), "__place")
    placed = ranked.join(taken, F.col(KEY) == F.col("__k"), "left")
    free = F.when(F.col("__taken").isNull(), F.col("__place")).otherwise(
        F.element_at(F.array_except(F.sequence(F.lit(0), (F.size("__taken") + F.col("__place")).cast("int")), F.col("__taken")), F.col("__place").cast("int") + 1)
    )
    return same.unionByName(placed.withColumn(OCC, free.cast("int")).drop("__k", "__taken", "__place"))


def conservation(before: DataFrame, result: StepResult) -> dict:
    """Counts that must be zero: rows lost without an event, rows that appear from nowhere, and
    events on rows that were not there. All over pairs (key, occurrence)."""
    pair = lambda d, k=KEY, o=OCC: d.select(F.col(k).alias("k"), F.col(o).cast("int").alias("o"))
    ins, outs, ev = pair(before), pair(result.output), result.events
    gone = pair(ev.where("kind in ('dropped','changed')"), "row_key", "occurrence")
    come = pair(ev.where("kind in ('added','changed')"), "new_row_key", "new_occurrence")
    stay = ins.subtract(gone)
    return {
        "lost": stay.subtract(outs).count(), "from_nowhere": outs.subtract(stay).subtract(come).count(), "events_on_absent": gone.subtract(ins).count(),
        "kept_though_gone": gone.intersect(outs).subtract(come).count(), "repeated_pairs": outs.groupBy("k", "o").count().where("count > 1").count(),
    }

"""Filters: each decides per row and gives output and drop events from that one decision."""

from __future__ import annotations

import fnmatch
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sievework.operators.rows import KEY, OCC, SPLIT, Context, Reason, Refused, StepResult, as_text, content_text, drop, ngrams, repeated_share, require, strip, word_count, words

EMPTY = "(empty)"


def text_of(df: DataFrame, ctx: Context, column: str | None) -> Column:
    return as_text(df, column) if column else content_text(df, ctx.content)


def length_band(df: DataFrame, ctx: Context, column: str | None = None, unit: str = "characters", min_length: float = 0, max_length: float | None = 100_000) -> StepResult:
    """Keep rows whose length lies in the band, both ends included. max_length None: no upper end."""
    if max_length is not None and min_length > max_length or unit not in ("characters", "words"):
        raise Refused("params_invalid")
    text = text_of(df, ctx, column)
    d = df.withColumn("__n", (F.length(text) if unit == "characters" else word_count(text)).cast("long"))
    n = F.col("__n")
    reasons = [Reason(n < min_length, "length_out_of_band", "length", n, threshold=f"< {min_length:g}")]
    if max_length is not None:
        reasons.append(Reason(n > max_length, "length_out_of_band", "length", n, threshold=f"> {max_length:g}"))
    return drop(d, reasons, ["__n"])


def turn_count_band(df: DataFrame, ctx: Context, column: str = "messages", min_turns: int = 1, max_turns: int = 64) -> StepResult:
    """Keep chats with so many turns; a cell that is no list has none."""
    require(df, column)
    if min_turns > max_turns:
        raise Refused("params_invalid")
    n = F.coalesce(F.when(F.col(column).isNotNull(), F.size(column)), F.lit(0)) if isinstance(df.schema[column].dataType, T.ArrayType) else F.lit(0)
    return drop(df, [Reason(n < min_turns, "turns_out_of_band", "turns", n, threshold=f"< {min_turns}"), Reason(n > max_turns, "turns_out_of_band", "turns", n, threshold=f"> {max_turns}")])


def empty_content(df: DataFrame, ctx: Context) -> StepResult:
    """Drop rows whose content has no character but white space."""
    n = reduce(lambda a, b: a + b, [F.length(strip(as_text(df, c))) for c in ctx.content])
    return drop(df, [Reason(n == 0, "empty_content", "content_chars", n)])


def repetition_ratio(text: Column, n: int) -> Column:
    """Share of the n-grams that stand more than once; 0 without n-grams."""
    return repeated_share(ngrams(words(text), n))


def ngram_repetition(df: DataFrame, ctx: Context, column: str | None = None, n: int = 3, max_ratio: float = 0.5) -> StepResult:
    """Drop rows in which more than max_ratio of the word n-grams are repeats of another."""
    d = df.withColumn("__r", repetition_ratio(text_of(df, ctx, column), n))
    return drop(d, [Reason(F.col("__r") > max_ratio, "ngram_repetition", "repeated_ngram_ratio", F.col("__r"), threshold=f"> {max_ratio:g}")], ["__r"])


def metadata_value_filter(df: DataFrame, ctx: Context, column: str, values: list[str]) -> StepResult:
    """Drop rows whose value, as text, is listed; '(empty)' stands for null."""
    require(df, column)
    value = F.coalesce(F.col(column).cast("string"), F.lit(EMPTY))
    return drop(df, [Reason(value.isin(values), "value_excluded", column, text=value)])


def screen_filter(df: DataFrame, ctx: Context, flag_columns: list[str]) -> StepResult:
    """Drop rows that any flag marks; of the rest those that any flag left open."""
    require(df, *flag_columns, code="screen_column_missing")
    if any(not isinstance(df.schema[c].dataType, T.BooleanType) for c in flag_columns):
        raise Refused("screen_column_not_boolean")
    first = lambda test: F.coalesce(*[F.when(test(F.col(c)), F.lit(c)) for c in flag_columns])
    hit, open_ = first(lambda c: c), first(lambda c: c.isNull())
    return drop(df, [Reason(hit.isNotNull(), "screened_out", "flag", text=hit), Reason(open_.isNotNull(), "not_screened", "flag", text=open_)])


def feature_filter(df: DataFrame, ctx: Context, features: list[int], min_activation: float) -> StepResult:
    """Keep rows in which a named feature is active enough anywhere.

    ctx.inputs['tags']: (row_key, activations array<struct<index,value>>). No row there: not_tagged;
    none of the features there: activation_unknown.
    """
    tags = ctx.inputs["tags"].select(F.col("row_key").alias("__k"), F.col("activations").alias("__a"))
    d = df.join(tags, F.col(KEY) == F.col("__k"), "left")
    wanted = F.filter("__a", lambda a: a["index"].isin(features))
    best = F.array_max(F.transform(wanted, lambda a: a["value"]))
    return drop(d, [
        Reason(F.col("__k").isNull(), "not_tagged", "activation"), Reason(best.isNull(), "activation_unknown", "activation", threshold=f">= {min_activation:g}"),
        Reason(best < min_activation, "below_activation", "activation", best, threshold=f">= {min_activation:g}"),
    ], ["__k", "__a"])


def drop_leakage_pairs(df: DataFrame, ctx: Context, drop_side: str, keep_sides: list[str]) -> StepResult:
    """Drop rows of drop_side that a pair ties to a row of one of keep_sides.

    ctx.inputs['pairs']: (side_a, key_a, side_b, key_b).
    """
    p = ctx.inputs["pairs"]
    one = p.where((F.col("side_a") == drop_side) & F.col("side_b").isin(keep_sides)).select(F.col("key_a").alias("__k"))
    two = p.where((F.col("side_b") == drop_side) & F.col("side_a").isin(keep_sides)).select(F.col("key_b").alias("__k"))
    listed = one.unionByName(two).distinct()
    d = df.join(listed, (F.col(KEY) == F.col("__k")) & (F.col(SPLIT) == drop_side), "left")
    return drop(d, [Reason(F.col("__k").isNotNull(), "leakage_pair", "leakage_pair", text=F.col(SPLIT))], ["__k"])


def drop_columns(df: DataFrame, ctx: Context, columns: list[str] | None = None, patterns: list[str] | None = None) -> StepResult:
    """Drop metadata columns by name or glob pattern; content and reserved ones are refused."""
    require(df, *(columns or []))
    gone = list(columns or [])
    for p in patterns or []:
        hit = [c for c in df.columns if fnmatch.fnmatchcase(c, p) and not c.startswith("_dw_")]
        if not hit:
            raise Refused("pattern_matches_nothing", p)
        gone += hit
    if any(c.startswith("_dw_") or c in ctx.content for c in gone):
        raise Refused("column_not_droppable")
    return StepResult(df.drop(*gone))


OPS = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v,
    "contains": lambda c, v: F.lower(c.cast("string")).contains(str(v).lower()), "is_null": lambda c, v: c.isNull(), "not_null": lambda c, v: c.isNotNull(),
}


def where(df: DataFrame, conditions: list[dict]) -> DataFrame:
    """Rows that satisfy every {column, op, value}."""
    for x in conditions:
        require(df, x["column"])
        if x["op"] not in OPS:
            raise Refused("unknown_op", x["op"])
        df = df.where(OPS[x["op"]](F.col(x["column"]), x.get("value")))
    return df


def search(df: DataFrame, columns: list[str], term: str) -> DataFrame:
    """Rows in which any column holds the term, whatever its case."""
    return df.where(reduce(lambda a, b: a | b, [OPS["contains"](F.col(c), term) for c in columns]))


def key_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.where(F.col(KEY).startswith(prefix)).select(KEY).distinct()


def row_page(df: DataFrame, conditions: list[dict], term: str | None, search_in: list[str], columns: list[str], limit: int, offset: int = 0) -> DataFrame:
    d = where(df, conditions)
    if term:
        d = search(d, search_in, term)
    return d.orderBy(KEY, OCC).offset(offset).limit(limit).select(KEY, OCC, *columns)


# Statistics of the text filters of the second operator family: bounds are inclusive.
def _ratio(hit: Column, text: Column) -> Column:
    return F.when(F.length(text) > 0, hit / F.length(text)).otherwise(F.lit(0.0))


def _gram_numbers(codes: np.ndarray, n: int) -> np.ndarray:
    """A number of every n-gram of characters, equal where the n-grams are equal and nowhere else."""
    found = np.unique(codes)
    if len(found) ** n < 1 << 64:
        place = np.zeros(int(found[-1]) + 1, dtype=np.uint64)
        place[found] = np.arange(len(found), dtype=np.uint64)
        digit, out = place[codes], np.zeros(len(codes) - n + 1, dtype=np.uint64)
        for i in range(n):
            out *= np.uint64(len(found))
            out += digit[i : len(out) + i]
        return out
    half = n - n // 2  # two overlapping halves make an n-gram
    rank = np.unique(_gram_numbers(codes, half), return_inverse=True)[1].astype(np.uint64)
    return rank[: len(codes) - n + 1] << np.uint64(32) | rank[n - half :]


def repeated_grams(text: str, n: int) -> float:
    """Share of the n-grams of code points that stand more than once; 0 without n-grams."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) < n:
        return 0.0
    g = np.sort(_gram_numbers(codes, n))
    same = g[1:] == g[:-1]
    return float(np.count_nonzero(np.append(same, False) | np.append(False, same)) / len(g))


def statistic(name: str, text: Column, rep_len: int = 10) -> Column:
    if name == "text_len":
        return F.length(text).cast("double")
    if name == "num_words":
        return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "))).cast("double")
    if name == "alnum_ratio":
        return _ratio(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), text)
    if name == "special_char_ratio":
        return _ratio(F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", "")), text)
    if name == "char_rep_ratio":
        @F.pandas_udf("double")
        def repeated(texts: pd.Series) -> pd.Series:
            return pd.Series([repeated_grams(t, rep_len) for t in texts], dtype="float64")

        return repeated(F.coalesce(text, F.lit("")))
    raise Refused("params_invalid", name)


STATISTIC_FILTERS = {
    "text_length_filter": ("text_len", "min_len", "max_len"), "words_num_filter": ("num_words", "min_num", "max_num"), "alphanumeric_filter": ("alnum_ratio", "min_ratio", "max_ratio"),
    "special_characters_filter": ("special_char_ratio", "min_ratio", "max_ratio"), "character_repetition_filter": ("char_rep_ratio", "min_ratio", "max_ratio"),
}


def statistic_filter(df: DataFrame, ctx: Context, name: str, column: str = "text", low: float = 0.0, high: float = float("inf"), rep_len: int = 10) -> StepResult:
    stat = STATISTIC_FILTERS[name][0]
    d = df.withColumn("__s", statistic(stat, as_text(df, column), rep_len))
    s = F.col("__s")
    return drop(d, [Reason((s < low) | (s > high), f"dj.{name}", stat, s, threshold=f"[{low:g}, {high:g}]")], ["__s"])


def template_column(df: DataFrame, template: str, dtype: str = "string") -> Column:
    """A column from a template: {{ column }} becomes its text, null becomes empty."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*\}\}", template):
        require(df, m[1])
        parts += [F.lit(template[at : m.start()]), as_text(df, m[1])]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:])).cast(dtype)


def render_template(df: DataFrame, template: str) -> Column:
    """{column} becomes its text, null is empty; {{ and }} are braces."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{(\w+)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(F.lit(m[0][0]) if m[1] is None else as_text(df, m[1]))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))

"""Planned carriers, inserted elements, and their siblings."""

from __future__ import annotations

import hashlib
import itertools
import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sievework.operators.generation import add_rows
from sievework.operators.rows import KEY, OCC, PARENTS, SPLIT, Context, Reason, Refused, StepResult, as_text, changes, drawn_rank, drop, rekey, require
from sievework.operators.selection import largest_remainder

AXES = ("genre", "placement", "framing", "length_band")
SLOT = "[[ELEMENT]]"


def plan_cells(vocabulary: dict[str, list[str]], shares: dict[str, dict[str, float]], rows: int) -> list[tuple]:
    """(cell values..., planned): exact whole numbers over all combinations, by largest remainder."""
    cells = list(itertools.product(*[vocabulary[a] for a in AXES]))
    weights = []
    for c in cells:
        w = 1.0
        for a, v in zip(AXES, c, strict=True):
            w *= shares.get(a, {}).get(v, 1 / len(vocabulary[a]))
        weights.append(w)
    return [(*c, n) for c, n in zip(cells, largest_remainder(weights, rows), strict=True)]


def carrier_plan(df: DataFrame, ctx: Context, vocabulary: dict, shares: dict, rows: int, templated_share: float = 0.0, templated_ceiling: float = 1.0, text_column: str = "text", plan_id: str = "plan") -> StepResult:
    """Give each of exactly `rows` rows its planned cell, form and slot text, and a new key.

    The plan is small (a line per cell); rows meet it by their seeded rank and the cells' running
    totals. carrier_id is the digest of (plan, old key).
    """
    if templated_share > templated_ceiling:
        raise Refused("params_invalid")
    for c in (*AXES, "form", "slot", "carrier_id"):
        if c in df.columns:
            raise Refused("output_column_exists", c)
    if df.count() != rows:
        raise Refused("plan_size_mismatch")
    cells = [c for c in plan_cells(vocabulary, shares, rows) if c[-1]]
    ends = list(itertools.accumulate(c[-1] for c in cells))
    spark = df.sparkSession
    plan = spark.createDataFrame([(*c[:-1], e - c[-1], e) for c, e in zip(cells, ends, strict=True)], ", ".join(f"{a} string" for a in AXES) + ", __lo long, __hi long")
    r = drawn_rank(df, [], ctx.seed, "__rank", ctx.rank_digits)
    d = r.join(F.broadcast(plan), (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))  # a line per cell of the vocabulary
    templated = round(templated_share * rows)
    d = d.withColumn("form", F.when(F.pmod(F.col("__rank") * 7919, F.lit(rows)) < templated, "templated").otherwise("free"))
    d = d.withColumn("slot", F.lit(SLOT)).withColumn("carrier_id", F.sha2(F.to_json(F.array(F.lit(plan_id), F.col(KEY))), 256))
    d = d.withColumn(text_column, F.concat_ws(" ", F.coalesce(F.col(text_column), F.lit("")), "slot")).drop("__rank", "__lo", "__hi")
    again = rekey(d, ctx.content)
    return StepResult(again.drop("__old_key", "__old_occ"), changes(df, again, "carrier_planned"))


def boundary(text: str, at: int, kind: str = "nearest") -> int:
    """The place nearest to `at` that parts lines, else sentences, else words; ties to the left."""
    import re

    for rx in (r"\n", r"(?<=[.!?])\s", r"\s"):
        spots = [m.end() for m in re.finditer(rx, text)]
        if spots:
            return min(spots, key=lambda s: (abs(s - at), s))
    return at if kind == "nearest" else len(text)


def insert_element(df: DataFrame, ctx: Context, element_column: str, mode: str = "slot", text_column: str = "text", slot_column: str = "slot", placement_column: str = "placement") -> StepResult:
    """Put each row's element into its text and note its span (element_start, element_end, in code points).

    slot: the slot token must stand exactly once. real_text: at the start, the end, or the boundary
    nearest to the middle.
    """
    require(df, element_column, text_column)
    for c in ("element_start", "element_end"):
        if c in df.columns:
            raise Refused("output_column_exists", c)
    text, el = as_text(df, text_column), as_text(df, element_column)
    if mode == "slot":
        require(df, slot_column)
        slot = F.col(slot_column)
        n = ((F.length(text) - F.length(F.replace(text, slot, F.lit("")))) / F.length(slot)).cast("int")
        out = drop(df.withColumn("__n", n), [Reason(F.length(text) == 0, "no_carrier_text", f"{text_column}_length", F.length(text)), Reason(F.col("__n") == 0, "slot_missing", slot_column, F.col("__n")), Reason(F.col("__n") > 1, "slot_repeated", slot_column, F.col("__n"))], ["__n"])
        o = out.output
        start = F.locate("\x00", F.replace(text, slot, F.lit("\x00"))) - 1
        done = o.withColumn("element_start", start.cast("int")).withColumn("element_end", (start + F.length(el)).cast("int")).withColumn(text_column, F.replace(text, slot, el))
    elif mode == "real_text":
        require(df, placement_column)

        @F.pandas_udf("struct<text:string,s:int,e:int>")
        def put(t: pd.Series, x: pd.Series, p: pd.Series) -> pd.DataFrame:
            rows = []
            for a, b, where in zip(t, x, p):
                at = 0 if where == "start" else len(a) if where == "end" else boundary(a, len(a) // 2)
                left, right = a[:at], a[at:]
                pre = "" if not left or left[-1].isspace() else " "
                post = "" if not right or right[0].isspace() else " "
                rows.append((left + pre + b + post + right, len(left) + len(pre), len(left) + len(pre) + len(b)))
            return pd.DataFrame(rows, columns=["text", "s", "e"])

        out = drop(df, [Reason(F.length(text) == 0, "no_carrier_text", f"{text_column}_length", F.length(text))])
        o = out.output.withColumn("__m", put(text, el, F.col(placement_column)))
        done = o.withColumn(text_column, F.col("__m.text")).withColumn("element_start", F.col("__m.s")).withColumn("element_end", F.col("__m.e")).drop("__m")
    else:
        raise Refused("params_invalid", mode)
    again = rekey(done, ctx.content)
    return StepResult(again.drop("__old_key", "__old_occ"), out.events.unionByName(changes(df, again, "element_inserted")))


def slot_siblings(df: DataFrame, ctx: Context, variants: dict[str, str], text_column: str = "text", label_column: str | None = None) -> StepResult:
    """Add a row per variant with only the element's span replaced; pair_id ties the family.
    variants: name -> text ('' removes the element)."""
    require(df, text_column, "element_start", "element_end")
    if label_column and label_column in df.columns:
        raise Refused("siblings_after_labels")
    base = df.withColumn("pair_id", F.sha2(F.concat_ws(":", KEY, OCC), 256)).withColumn("sibling_variant", F.lit("original"))
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("text")) for n, t in variants.items()]))
    t = F.col(text_column)
    new = base.select("*", v.alias("__v")).withColumn("sibling_variant", F.col("__v.name"))
    new = new.withColumn(text_column, F.concat(F.substring(t, F.lit(1), F.col("element_start")), F.col("__v.text"), F.substring(t, F.col("element_end") + 1, F.length(t))))
    new = new.withColumn("element_end", (F.col("element_start") + F.length("__v.text")).cast("int")).withColumn(PARENTS, F.array(KEY)).withColumn("__order", F.concat_ws(":", KEY, OCC, "__v.name"))
    return add_rows(base, new.drop("__v", KEY, OCC), ctx.content, "slot_sibling")


def carrier_check(df: DataFrame, ctx: Context, run_column: str = "generation_run", id_column: str = "carrier_id", cell_column: str = "cell") -> StepResult:
    """The check as a step: refused where check_carrier_ids() names an id, else the rows as they are."""
    bad = check_carrier_ids(df, run_column, id_column, cell_column).orderBy(id_column).first()
    if bad is not None:
        raise Refused("carrier_id_shared", str(bad[0]))
    return StepResult(df)


def check_carrier_ids(df: DataFrame, run_column: str = "generation_run", id_column: str = "carrier_id", cell_column: str = "cell") -> DataFrame:
    """Ids held by rows of several runs whose cells differ or are unknown; the check is met by none."""
    require(df, run_column, id_column, cell_column, code="carrier_columns_missing")
    g = df.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.countDistinct(run_column).alias("runs"), F.countDistinct(cell_column).alias("cells"), F.max(F.col(cell_column).isNull().cast("int")).alias("open"))
    return g.where((F.col("runs") > 1) & ((F.col("cells") > 1) | (F.col("open") == 1))).select(id_column, "runs", "cells")

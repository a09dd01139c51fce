"""Synthetic identifiers and their validation, as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sievework.functions import identifiers as ids
from sievework.operators.rows import KEY, OCC, Context, Refused, StepResult, require


def synth_identifier(df: DataFrame, ctx: Context, scheme: str, seed: int = 0, valid_share: float = 0.5, perturbations: tuple = ids.PERTURBATIONS, delimiters: tuple = ("none",), output_prefix: str = "") -> StepResult:
    """identifier, valid, perturbation and delimiter per row, drawn from (seed, key, occurrence).

    A value that a perturbation leaves valid by chance is perturbed again, and in the end marked valid.
    """
    if scheme not in ids.SCHEMES or not set(perturbations) <= set(ids.PERTURBATIONS) or not set(delimiters) <= set(ids.DELIMITERS):
        raise Refused("params_invalid")

    @F.pandas_udf("struct<identifier:string,valid:boolean,perturbation:string,delimiter:string>")
    def make(k: pd.Series, o: pd.Series) -> pd.DataFrame:
        rows = []
        for key, occ in zip(k, o):
            rng = ids.row_rng(seed, key, int(occ))
            good, style = rng.random() < valid_share, rng.choice(delimiters)
            v, how = ids.synthesise(scheme, rng), None
            if not good:
                base = v
                for _ in range(20):
                    how = rng.choice(perturbations)
                    v = ids.perturb(base, how, rng)
                    if not ids.validate(scheme, v).valid:
                        break
            rows.append((ids.delimit(v, style), ids.validate(scheme, v).valid, how, style))
        return pd.DataFrame(rows, columns=["identifier", "valid", "perturbation", "delimiter"])

    d = df.withColumn("__m", make(KEY, OCC))
    return StepResult(d.select(*df.columns, *[F.col("__m")[n].alias(f"{output_prefix}{n}") for n in ("identifier", "valid", "perturbation", "delimiter")]))


def checksum_validate(df: DataFrame, ctx: Context, column: str, scheme: str, mode: str = "value", output_prefix: str = "cv_") -> StepResult:
    """valid, reason, normalised, detail, start and end: of the cell, or of the first valid candidate
    in a text (mode scan; else of the first candidate)."""
    if scheme not in ids.SCHEMES or mode not in ("value", "scan"):
        raise Refused("params_invalid")
    require(df, column)

    @F.pandas_udf("struct<valid:boolean,reason:string,normalised:string,detail:string,start:int,`end`:int>")
    def check(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            if mode == "value":
                v = ids.validate(scheme, t or "")
                rows.append((*v, 0 if t else None, len(t) if t else None))
            else:
                found = ids.scan(scheme, t)
                best = next((x for x in found if x[2].valid), found[0] if found else None)
                rows.append((*best[2], best[0], best[1]) if best else (False, "no_candidate", None, None, None, None))
        return pd.DataFrame(rows, columns=["valid", "reason", "normalised", "detail", "start", "end"]).astype({"start": "Int32", "end": "Int32"})

    d = df.withColumn("__m", check(F.col(column).cast("string")))
    return StepResult(d.select(*df.columns, *[F.col("__m")[n].alias(f"{output_prefix}{n}") for n in ("valid", "reason", "normalised", "detail", "start", "end")]))


def luhn_valid(digits: Column) -> Column:
    """Built-in check for cells of digits."""
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def aba_valid(digits: Column) -> Column:
    """3-7-1 check of nine digits, without Python."""
    w = F.array(*[F.lit(x) for x in (3, 7, 1) * 3])
    total = F.aggregate(F.zip_with(F.split(digits, ""), w, lambda d, x: d.try_cast("int") * x), F.lit(0), lambda a, x: a + x)
    return F.coalesce(digits.rlike("^[0-9]{9}$") & (total % 10 == 0), F.lit(False))


#: The character sets of the length-and-charset check.
CHARSETS = {"digits": "0-9", "upper_alnum": "0-9A-Z"}


def length_charset(value: Column, lengths: list[int], charset: str) -> Column:
    """struct (valid, reason, normalised) of a check without a check digit: after spaces and hyphens go,
    every character is in the set and the length is one of lengths."""
    if charset not in CHARSETS or not lengths or not all(1 <= n <= 64 for n in lengths):
        raise Refused("params_invalid", charset)
    t = F.regexp_replace(F.coalesce(value, F.lit("")), "[ -]", "")
    reason = F.when(t == "", "no_characters").when(t.rlike(f"[^{CHARSETS[charset]}]"), "illegal_character").when(~F.length(t).isin(list(lengths)), "wrong_length").otherwise("ok")
    return F.struct((reason == "ok").alias("valid"), reason.alias("reason"), t.alias("normalised"))

"""Generated rows, judges, pairs, and minimal edits, over recorded runs given as side tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sievework.operators.rows import KEY, OCC, ORIGIN, PARENTS, SOURCE, SPLIT, Context, Reason, Refused, StepResult, drop, drawn_rank, rank_within, require, row_key


def _added(rows: DataFrame, code: str) -> DataFrame:
    none = F.lit(None)
    return rows.select(
        F.lit("added").alias("kind"), none.cast("string").alias("row_key"), none.cast("int").alias("occurrence"), F.col(KEY).alias("new_row_key"), F.col(OCC).alias("new_occurrence"), none.cast("string").alias("related_row_key"), F.col(PARENTS).alias("parent_keys"),
        F.col(SPLIT).alias("split"), F.lit(code).alias("reason_code"), F.lit(code).alias("reason"), none.cast("string").alias("statistic_name"), none.cast("double").alias("statistic_value"), none.cast("string").alias("statistic_text"), none.cast("string").alias("threshold"),
    )


def add_rows(df: DataFrame, new: DataFrame, content, code: str) -> StepResult:
    """df with new rows; their occurrences follow those of rows alike. new has the user columns, the
    split, the parents, and __order."""
    for c in df.columns:
        if c not in new.columns and c not in (KEY, OCC):
            new = new.withColumn(c, F.lit("generated") if c == ORIGIN else F.lit(None).cast(df.schema[c].dataType))
    new = new.withColumn(KEY, row_key(new, content))
    new = rank_within(new, [KEY], ["__order"], F.substring(F.col("__order").cast("string"), 1, 3), "__place")
    last = df.join(new.select(F.col(KEY).alias("__k")).distinct(), F.col(KEY) == F.col("__k"), "left_semi").groupBy(F.col(KEY).alias("__k")).agg((F.max(OCC) + 1).alias("__next"))
    new = new.join(last, F.col(KEY) == F.col("__k"), "left").withColumn(OCC, (F.col("__place") + F.coalesce("__next", F.lit(0))).cast("int")).select(*df.columns)
    return StepResult(df.unionByName(new), _added(new, code))


def generated_rows(df: DataFrame, ctx: Context, held_out: tuple = ("test",)) -> StepResult:
    """Committed records of a run join the table: origin generated, split and parent of their seed.

    ctx.inputs['records']: (seed_row_key, record_no, user columns...). A record whose seed is not in
    the table, or has a copy in a held-out split, is refused; of several other splits the first by name counts.
    """
    rec = ctx.inputs["records"]
    in_held_out = F.col(SPLIT).isin(*held_out)
    seeds = df.groupBy(KEY).agg(F.coalesce(F.min(F.when(in_held_out, F.col(SPLIT))), F.min(SPLIT)).alias("__split")).select(F.col(KEY).alias("seed_row_key"), "__split")
    j = rec.join(seeds, "seed_row_key", "left")
    bad = j.agg(F.count(F.when(F.col("__split").isNull(), 1)).alias("a"), F.count(F.when(F.col("__split").isin(*held_out), 1)).alias("b")).first()
    if bad["a"]:
        raise Refused("seed_row_unknown")
    if bad["b"]:
        raise Refused("generated_into_held_out")
    new = j.withColumn(SPLIT, F.col("__split")).withColumn(PARENTS, F.array("seed_row_key")).withColumn("__order", F.struct("seed_row_key", "record_no")).drop("seed_row_key", "__split", "record_no")
    new = new.withColumn("__order", F.concat_ws(":", F.col("__order")["seed_row_key"], F.lpad(F.col("__order")["record_no"].cast("string"), 12, "0")))
    return add_rows(df, new, ctx.content, "generated")


def judge_filter(df: DataFrame, ctx: Context, keep_outcomes: list[str] | None = None, min_score: float | None = None, replaced: DataFrame | None = None) -> StepResult:
    """Only generated rows are tested: without a verdict, with another outcome, or with too low a
    score they drop; so do those that a pair replaced. ctx.inputs['run']: (row_key, outcome, score)."""
    if not keep_outcomes and min_score is None:
        raise Refused("params_invalid")
    run = ctx.inputs["run"].select(F.col("row_key").alias("__k"), "outcome", "score")
    d = df.join(run, F.col(KEY) == F.col("__k"), "left")
    gen, reasons, extra = F.col(ORIGIN) == "generated", [], ["__k", "outcome", "score"]
    if replaced is not None:
        d = d.join(replaced.select(F.col("row_key").alias("__r")).distinct(), F.col(KEY) == F.col("__r"), "left")
        reasons.append(Reason(gen & F.col("__r").isNotNull(), "replaced_by_pair", "verdict"))
        extra.append("__r")
    reasons.append(Reason(gen & F.col("__k").isNull(), "judge_missing", "verdict"))
    if keep_outcomes:
        reasons.append(Reason(gen & ~F.coalesce(F.col("outcome").isin(keep_outcomes), F.lit(False)), "judge_rejected", "verdict", text=F.col("outcome")))
    if min_score is not None:
        reasons.append(Reason(gen & ~F.coalesce(F.col("score") >= min_score, F.lit(False)), "judge_rejected", "score", F.col("score"), threshold=f"< {min_score:g}"))
    return drop(d, reasons, extra)


def pair_filter(df: DataFrame, ctx: Context, chosen_verdict: str = "A", tie_verdicts: tuple = ("tie",)) -> StepResult:
    """Keep a pair only where the judge, asked in both orders, picks the declared side.
    ctx.inputs['run']: (row_key, verdict, swapped_verdict, both with A as the declared side)."""
    run = ctx.inputs["run"].select(F.col("row_key").alias("__k"), "verdict", "swapped_verdict")
    d = df.join(run, F.col(KEY) == F.col("__k"), "left")
    v, s, gen = F.col("verdict"), F.col("swapped_verdict"), F.col(ORIGIN) == "generated"
    return drop(d, [
        Reason(gen & v.isNull(), "pair_judge_missing", "verdict"), Reason(gen & s.isNotNull() & (v != s), "pair_position_inconsistent", "verdict", text=F.concat_ws("/", v, s)),
        Reason(gen & v.isin(*tie_verdicts), "pair_tie", "verdict", text=v), Reason(gen & (v != chosen_verdict), "pair_judge_disagrees", "verdict", text=v),
    ], ["__k", "verdict", "swapped_verdict"])


def best_and_worst(scored: DataFrame, min_margin: float) -> DataFrame:
    """(prompt, chosen, rejected, chosen_key, rejected_key, margin): the best and the worst response
    of each prompt by (score, key), where they lie far enough apart. scored: (prompt, response,
    row_key, score). Two grouped extremes: no prompt's responses are gathered."""
    g = scored.where("score is not null").groupBy("prompt").agg(F.max_by(F.struct("response", "row_key", "score"), F.struct("score", "row_key")).alias("hi"), F.min_by(F.struct("response", "row_key", "score"), F.struct("score", "row_key")).alias("lo"))
    m = F.col("hi.score") - F.col("lo.score")
    return g.where((F.col("hi.row_key") != F.col("lo.row_key")) & (m >= min_margin)).select("prompt", F.col("hi.response").alias("chosen"), F.col("lo.response").alias("rejected"), F.col("hi.row_key").alias("chosen_key"), F.col("lo.row_key").alias("rejected_key"), m.alias("margin"))


def pair_from_scores(df: DataFrame, ctx: Context, min_margin: float, prompt: str = "prompt", response: str = "completion") -> StepResult:
    """Adds a row (prompt, chosen, rejected) per prompt. ctx.inputs['run']: (row_key, score)."""
    require(df, prompt, response, code="target_columns_missing")
    s = df.join(ctx.inputs["run"].select(F.col("row_key").alias("__k"), "score"), F.col(KEY) == F.col("__k"))
    pairs = best_and_worst(s.select(F.col(prompt).alias("prompt"), F.col(response).alias("response"), F.col(KEY).alias("row_key"), "score"), min_margin)
    splits = df.groupBy(KEY).agg(F.min(SPLIT).alias("__s")).select(F.col(KEY).alias("chosen_key"), "__s")
    new = pairs.join(splits, "chosen_key").select(F.col("prompt").alias(prompt), "chosen", "rejected", F.col("__s").alias(SPLIT), F.array("chosen_key", "rejected_key").alias(PARENTS), F.col("chosen_key").alias("__order"))
    base = df
    for c in ("chosen", "rejected"):
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast("string"))
    return add_rows(base, new, ctx.content, "pair_from_scores")


def edit_size(a: str, b: str, unit: str) -> int:
    """Characters or words that a sequence matcher finds changed."""
    from difflib import SequenceMatcher
    from os.path import commonprefix

    x, y = (a, b) if unit == "chars" else (a.split(), b.split())
    n = len(commonprefix([x, y]))
    x, y = x[n:], y[n:]  # the matcher is quadratic, and edits are few
    n = len(commonprefix([x[::-1], y[::-1]]))
    x, y = x[: len(x) - n], y[: len(y) - n]
    if not x or not y:
        return max(len(x), len(y))
    return sum(max(i2 - i1, j2 - j1) for op, i1, i2, j1, j2 in SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if op != "equal")


def minimal_pair_scope(df: DataFrame, ctx: Context, text: str = "text", max_edit_chars: int | None = None, max_edit_words: int | None = None) -> StepResult:
    """Keep counterparts of a run with a small edit, and their seeds.
    ctx.inputs['records']: (row_key of the counterpart, seed_row_key)."""
    rec = ctx.inputs["records"].select(F.col("row_key").alias("__k"), F.col("seed_row_key").alias("__seed"))
    if rec.groupBy("__seed").count().where("count > 1").limit(1).count():
        raise Refused("several_counterparts")
    seeds = df.select(F.col(KEY).alias("__sk"), F.col(text).alias("__st")).dropDuplicates(["__sk"])
    d = df.join(rec, F.col(KEY) == F.col("__k"), "left").join(seeds, F.col("__seed") == F.col("__sk"), "left")

    def size(unit: str):
        @F.pandas_udf("int")
        def f(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([edit_size(x, y, unit) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="Int32")

        return f

    d = d.withColumn("__ec", size("chars")(F.col("__st"), F.col(text))).withColumn("__ew", size("words")(F.col("__st"), F.col(text)))
    live = d.where(F.col("__k").isNotNull() & F.col("__sk").isNotNull()).select(F.col("__seed").alias("__is_seed")).distinct()
    d = d.join(live, F.col(KEY) == F.col("__is_seed"), "left")
    mate = F.col("__k").isNotNull()
    reasons = [
        Reason(~mate & F.col("__is_seed").isNull(), "not_in_run", "pair_membership"), Reason(mate & F.col("__sk").isNull(), "seed_missing", "pair_membership", related=F.col("__seed")), Reason(mate & (F.col("__ec") == 0), "no_edit", "edit_chars", F.col("__ec")),
    ]
    if max_edit_chars:
        reasons.append(Reason(mate & (F.col("__ec") > max_edit_chars), "edit_too_large", "edit_chars", F.col("__ec"), threshold=f"> {max_edit_chars}"))
    if max_edit_words:
        reasons.append(Reason(mate & (F.col("__ew") > max_edit_words), "edit_too_large", "edit_words", F.col("__ew"), threshold=f"> {max_edit_words}"))
    return drop(d, reasons, ["__k", "__seed", "__sk", "__st", "__ec", "__ew", "__is_seed"])


def minimal_pair_join(df: DataFrame, ctx: Context, flip_from: str, flip_to: str, label_column: str = "label") -> StepResult:
    """Keep counterparts that the judge says flipped, labelled with the flip and where they came from.
    ctx.inputs: 'records' (row_key, seed_row_key, model), 'judge' (row_key, verdict, provisional, model), 'seed_labels' (row_key, label)."""
    if flip_from == flip_to:
        raise Refused("flip_invalid")
    rec = ctx.inputs["records"].select(F.col("row_key").alias("__k"), F.col("seed_row_key").alias("pair_seed_key"), F.col("model").alias("pair_generator"))
    jud = ctx.inputs["judge"].select(F.col("row_key").alias("__j"), F.col("verdict").alias("pair_verdict"), F.col("provisional").alias("__prov"), F.col("model").alias("pair_judge"))
    lab = ctx.inputs["seed_labels"].select(F.col("row_key").alias("__s"), F.col("label").alias("pair_seed_label"))
    d = df.join(rec, F.col(KEY) == F.col("__k"), "left").join(jud, F.col(KEY) == F.col("__j"), "left").join(lab, F.col("pair_seed_key") == F.col("__s"), "left")
    if d.where(F.col("pair_generator") == F.col("pair_judge")).limit(1).count():
        raise Refused("judge_is_generator")
    d = d.withColumn(label_column, F.lit(flip_to))
    return drop(d, [
        Reason(F.col("__k").isNull(), "not_in_run", "pair_membership"), Reason(F.col("__j").isNull(), "judge_missing", "verdict"), Reason(F.col("__prov"), "judge_provisional", "verdict", text=F.col("pair_verdict")),
        Reason(F.col("pair_verdict") != flip_to, "flip_not_verified", "verdict", text=F.col("pair_verdict")), Reason(~F.col("pair_seed_label").eqNullSafe(flip_from), "seed_not_flip_from", "verdict", text=F.col("pair_seed_label")),
    ], ["__k", "__j", "__prov", "__s"])


def hard_negative_miner(df: DataFrame, ctx: Context, mode: str, threshold: float, band_below: float | None = None, band_above: float | None = None, reference_column: str | None = None, positive_values: tuple = ("positive",), cap: int | None = None) -> StepResult:
    """Keep rows near the threshold, wrong against a reference, or both; at most cap, the closest first.
    ctx.inputs['probe']: (row_key, p)."""
    if mode in ("near", "both") and band_below is None and band_above is None:
        raise Refused("band_required")
    if mode in ("wrong", "both") and reference_column is None:
        raise Refused("reference_required")
    probe = ctx.inputs["probe"].select(F.col("row_key").alias("__k"), F.col("p").alias("__p"))
    d = df.join(probe, F.col(KEY) == F.col("__k"), "left").withColumn("__d", F.round(F.col("__p") - threshold, 9))
    x, reasons = F.col("__d"), [Reason(F.col("__p").isNull(), "not_scored", "distance")]
    if mode in ("near", "both"):
        reasons.append(Reason((x < -(band_below or 0)) | (x > (band_above or 0)), "outside_band", "distance", x, threshold=f"[-{band_below or 0:g}, {band_above or 0:g}]"))
    if mode in ("wrong", "both"):
        ref = F.col(reference_column).cast("string")
        reasons.append(Reason(ref.isNull(), "no_reference", "distance", x))
        reasons.append(Reason((F.col("__p") >= threshold) == ref.isin(*positive_values), "correct", "distance", x))
    first = drop(d, reasons, [])
    if cap is None:
        return StepResult(first.output.drop("__k", "__p", "__d"), first.events)
    near = first.output.withColumn("__a", F.abs("__d"))
    r = rank_within(near, [], ["__a", KEY, OCC], F.floor(F.col("__a") * 1024).cast("long"), "__rank")
    second = drop(r, [Reason(F.col("__rank") >= cap, "over_cap", "distance", F.col("__d"), threshold=f"cap {cap}")], ["__k", "__p", "__d", "__a", "__rank"])
    return StepResult(second.output, first.events.unionByName(second.events))


def chat_generate(df: DataFrame, client, prompt: str, output: str = "completion", batch: int = 32) -> DataFrame:
    """Completions from a client made per task by `client()` and called with lists of prompts.

    The engine brings no model; this is where one plugs in.
    """
    require(df, prompt)

    @F.pandas_udf("string")
    def ask(s: pd.Series) -> pd.Series:
        call, out = client(), []
        for i in range(0, len(s), batch):
            out += list(call(s.iloc[i : i + batch].tolist()))
        return pd.Series(out, dtype=object)

    return df.withColumn(output, ask(F.col(prompt)))

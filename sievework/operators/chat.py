"""Chat normalisation, chat JSON, and the row contracts of training formats."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sievework.operators.rows import Context, Reason, Refused, StepResult, changes, drop, rekey, require

# The role names that map, and the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "user": "user", "assistant": "assistant", "system": "system"}
CHAT = "array<struct<role:string,content:string>>"


def normaliser(df: DataFrame, ctx: Context, chat_columns: tuple = ("messages",), rename: tuple = ()) -> StepResult:
    """Chats in role/content or from/value form become canonical; a row that cannot be mapped drops.

    rename: 'old:new' pairs of metadata columns. Contents stay verbatim; changed rows get new keys.
    """
    d = df
    reasons = []
    for c in chat_columns:
        require(df, c)
        fields = [f.name for f in df.schema[c].dataType.elementType.fields]
        pick = lambda m, names: F.coalesce(*[m[n] for n in names if n in fields], F.lit(None).cast("string"))  # noqa: E731,B023
        table = F.create_map(*[F.lit(x) for p in ROLE_NAMES.items() for x in p])
        made = F.transform(F.col(c), lambda m: F.struct(F.element_at(table, F.lower(pick(m, ("role", "from")))).alias("role"), pick(m, ("content", "value")).alias("content")))
        d = d.withColumn(c, made)
        bad = F.col(c).isNull() | F.exists(c, lambda m: m["role"].isNull() | m["content"].isNull())
        reasons.append(Reason(bad, "unmappable", "field", text=F.lit(c)))
    for pair in rename:
        old, _, new = pair.partition(":")
        if not new or old in ctx.content or new in d.columns:
            raise Refused("params_invalid", pair)
        require(d, old)
        d = d.withColumnRenamed(old, new)
    out = drop(d, reasons)
    again = rekey(out.output, ctx.content)
    events = out.events.unionByName(changes(df, again, "normalised"))
    return StepResult(again.drop("__old_key", "__old_occ"), events)


def parse_chat(text: str | None, string_rows: str = "drop") -> tuple[list | None, str | None]:
    """(messages, reason): a list of {role, content} objects and nothing else; never guesses."""
    try:
        value = json.loads(text) if text is not None else None
    except ValueError:
        return None, "chat_json_unparseable"
    if isinstance(value, str) and string_rows == "user_turn":
        return [{"role": "user", "content": value}], None
    if not isinstance(value, list) or not value:
        return None, "chat_json_not_a_chat"
    out = []
    for m in value:
        if not isinstance(m, dict) or set(m) not in ({"role", "content"}, {"from", "value"}) or not all(isinstance(v, str) for v in m.values()):
            return None, "chat_json_not_a_chat"
        role = (ROLE_NAMES | {"tool": "tool"}).get((m.get("role") or m.get("from") or "").lower())
        if role is None:
            return None, "chat_json_not_a_chat"
        out.append({"role": role, "content": m.get("content", m.get("value"))})
    return out, None


def chat_json_parser(df: DataFrame, ctx: Context, columns: list[str], json_string_rows: str = "drop") -> StepResult:
    """JSON text columns become chats in place; rows that are no chat drop."""
    if json_string_rows not in ("drop", "user_turn"):
        raise Refused("params_invalid")
    require(df, *columns)

    @F.pandas_udf(f"struct<chat:{CHAT},why:string>")
    def parse(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_chat(t, json_string_rows) for t in s], columns=["chat", "why"])

    d, reasons = df, []
    for c in columns:
        d = d.withColumn(f"__{c}", parse(F.col(c))).withColumn(c, F.col(f"__{c}.chat")).withColumn(f"__{c}", F.col(f"__{c}.why"))
        for code in ("chat_json_unparseable", "chat_json_not_a_chat"):
            reasons.append(Reason(F.col(f"__{c}") == code, code, "field", text=F.lit(c)))
    out = drop(d, reasons, [f"__{c}" for c in columns])
    again = rekey(out.output, ctx.content)
    return StepResult(again.drop("__old_key", "__old_occ"), out.events.unionByName(changes(df, again, "parsed_json_chat")))


def contract(df: DataFrame, target_type: str) -> list[tuple[str, Column]]:
    """(rule, holds) of a training format, in the order in which failures are named."""
    text = lambda c: F.coalesce(F.length(F.trim(F.col(c).cast("string"))) > 0, F.lit(False)) if c in df.columns and not isinstance(df.schema[c].dataType, T.ArrayType) else F.lit(False)
    have = lambda *cs: [(f"has_{c}", F.lit(c in df.columns)) for c in cs]
    if target_type == "sft" and "messages" in df.columns:
        m = F.col("messages")
        ok = lambda t: F.coalesce(t, F.lit(False))
        return [
            ("messages_not_empty", ok(F.size(m) > 0)), ("roles_known", ok(F.forall(m, lambda x: x["role"].isin("system", "user", "assistant", "tool")))),
            ("contents_not_empty", ok(F.forall(m, lambda x: F.length(F.trim(x["content"])) > 0))), ("system_only_first", ok(~F.exists(F.slice(m, F.lit(2), F.greatest(F.size(m), F.lit(1))), lambda x: x["role"] == "system"))),
            ("ends_with_assistant", ok(F.element_at(m, -1)["role"] == "assistant")),
        ]
    if target_type == "sft":
        return [*have("prompt", "completion"), ("prompt_text", text("prompt")), ("completion_text", text("completion"))] if "prompt" in df.columns else [*have("text"), ("text_not_empty", text("text"))]
    if target_type == "dpo":
        return [*have("prompt", "chosen", "rejected"), ("chosen_text", text("chosen")), ("rejected_text", text("rejected")), ("chosen_differs", F.coalesce(F.col("chosen").cast("string") != F.col("rejected").cast("string"), F.lit(False)) if {"chosen", "rejected"} <= set(df.columns) else F.lit(False))]
    if target_type == "kto":
        return [*have("prompt", "completion", "label"), ("completion_text", text("completion")), ("label_boolean", F.col("label").isNotNull() if "label" in df.columns and isinstance(df.schema["label"].dataType, T.BooleanType) else F.lit(False))]
    if target_type == "grpo_prompt":
        return [*have("prompt"), ("prompt_text", text("prompt"))]
    if target_type == "prm":
        same = F.coalesce(F.size("completions") == F.size("labels"), F.lit(False)) if {"completions", "labels"} <= set(df.columns) else F.lit(False)
        return [*have("prompt", "completions", "labels"), ("prompt_text", text("prompt")), ("lengths_equal", same)]
    if target_type == "detector":
        return [*have("text", "label"), ("text_not_empty", text("text")), ("label_set", F.col("label").isNotNull() if "label" in df.columns else F.lit(False))]
    raise Refused("trl_invalid", target_type)


def trl_validate(df: DataFrame, ctx: Context, target_type: str) -> StepResult:
    """Drop rows that break the format's contract; the first failing rule is named."""
    return drop(df, [Reason(~ok, "trl_invalid", "rule", text=F.lit(rule)) for rule, ok in contract(df, target_type)])


def trl_check(df: DataFrame, target_type: str) -> DataFrame:
    """Rows that fail each rule, each row under its first."""
    first = F.coalesce(*[F.when(~ok, F.lit(rule)) for rule, ok in contract(df, target_type)], F.lit("ok"))
    return df.groupBy(first.alias("rule")).agg(F.count("*").alias("rows"))


def detect(df: DataFrame) -> str:
    """The one training format that the columns fit, else 'undetected'."""
    c = set(df.columns)
    chat = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)}
    fits = [
        name for name, test in (
            ("dpo", {"chosen", "rejected"} <= c), ("prm", {"prompt", "completions", "labels"} <= c), ("kto", {"prompt", "completion", "label"} <= c), ("sft", bool(chat & {"messages", "conversations"}) or ({"prompt", "completion"} <= c and "label" not in c)),
            ("grpo_prompt", "prompt" in c and not c & {"completion", "completions", "chosen", "rejected"}), ("detector", {"text", "label"} <= c),
        ) if test
    ]
    return fits[0] if len(fits) == 1 else "undetected"


# The column sets of each format; the first whose columns all stand is exported.
EXPORT_VARIANTS = {
    "sft": (("messages",), ("text",), ("prompt", "completion")), "dpo": (("prompt", "chosen", "rejected"),), "kto": (("prompt", "completion", "label"),), "grpo_prompt": (("prompt",),), "prm": (("prompt", "completions", "labels"),),
    "detector": (("text", "label"),), "prompt_set": (("prompt",),), "retention_set": (("prompt",),), "corpus": (("text",), ("messages",)), "preference_pairs": (("prompt", "chosen", "rejected"),),
    "test_set": (("prompt", "reference", "match"), ("prompt", "grader_config_sha256")),
}

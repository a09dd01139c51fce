"""Labelers: thresholds, rule language, pattern spans, proximity, rule sets, truth tables."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sievework.operators.rows import KEY, OCC, ORIGIN, Context, Reason, Refused, StepResult, as_text, drop, require
from sievework.plans.staging import discard, materialise


def threshold_labeler(df: DataFrame, ctx: Context, threshold_positive: float, threshold_negative: float, drop_excluded: bool = False) -> StepResult:
    """positive at or over one threshold, negative at or under the other, else excluded.

    ctx.inputs['run']: (row_key, p). A row without a probability gets a null label and stays.
    """
    if threshold_negative >= threshold_positive:
        raise Refused("thresholds_invalid")
    run = ctx.inputs["run"].select(F.col("row_key").alias("__k"), F.col("p").alias("probability"))
    d = df.join(run, F.col(KEY) == F.col("__k"), "left").drop("__k")
    p = F.col("probability")
    d = d.withColumn("label", F.when(p >= threshold_positive, "positive").when(p <= threshold_negative, "negative").when(p.isNotNull(), "excluded"))
    return drop(d, [Reason((F.col("label") == "excluded") & F.lit(drop_excluded), "excluded_by_band", "P", p, threshold=f"({threshold_negative:g}, {threshold_positive:g})")])


def top_label(scores: dict[str, Column], min_top: float) -> Column:
    """The label with the largest score if that is at least min_top, else 'excluded'; ties go to the first
    declared; null where no label has a score."""
    best = F.greatest(*scores.values())
    chosen = F.coalesce(*[F.when(c == best, F.lit(n)) for n, c in scores.items()])
    return F.when(best >= min_top, chosen).when(best.isNotNull(), "excluded")


# The rule language: "value if cond and cond", conditions over columns.
_TOKEN = re.compile(r"\s*(?:(?P<s>'[^']*'|\"[^\"]*\")|(?P<n>-?\d+(?:\.\d+)?)|(?P<o>==|!=|<=|>=|<|>)|(?P<p>[\[\],])|(?P<w>@?[A-Za-z_][\w.]*))")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise Refused("rule_syntax", text[at:])
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def _literal(token: tuple[str, str]):
    kind, text = token
    if kind == "s":
        return text[1:-1]
    if kind == "n":
        return float(text) if "." in text else int(text)
    return {"true": True, "false": False}.get(text, text)


def _condition(df: DataFrame, t: list[tuple[str, str]]) -> Column:
    """One condition. A null cell is unlike every literal (!=, not in: true) and in no order (<: false)."""
    column = t[0][1]
    require(df, column)
    c, rest = F.col(column), t[1:]
    op = [x[1] for x in rest]
    if op[:3] == ["is", "not", "null"]:
        return c.isNotNull()
    if op[:2] == ["is", "null"]:
        return c.isNull()
    negate = op[:2] == ["not", "in"]
    if negate or op[:1] == ["in"]:
        items = [_literal(x) for x in rest[2 if negate else 1 :] if x[0] != "p"]
        hit = F.coalesce(c.cast("string").isin([_text(x) for x in items]), F.lit(False))
        return ~hit if negate else hit
    if not rest or rest[0][0] != "o" or len(rest) != 2:
        raise Refused("rule_syntax", column)
    v = _literal(rest[1])
    if rest[0][1] in ("==", "!="):
        hit = F.coalesce((c.cast("string") == _text(v)) if not isinstance(v, (int, float)) or isinstance(v, bool) else (c.cast("double") == float(v)), F.lit(False))
        return hit if rest[0][1] == "==" else ~hit
    left = c.cast("double") if isinstance(v, (int, float)) else c.cast("string")
    return F.coalesce({"<": left < v, "<=": left <= v, ">": left > v, ">=": left >= v}[rest[0][1]], F.lit(False))


def _text(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def rule_label(df: DataFrame, ctx: Context, rules: Sequence[str], output_column: str = "label", default: str | None = None) -> StepResult:
    """A column by the first rule whose conditions all hold, else default; @column copies a cell.

    A rule's value is parsed and written by its text: true as 'True', null as 'None', 01 as '1'.
    """
    named = {"true": "True", "false": "False", "null": "None"}
    return _rule_label(df, rules, output_column, default, lambda tok: named.get(tok[1].lower(), str(_literal(tok))) if tok[0] == "w" else str(_literal(tok)))


def rule_label_v2(df: DataFrame, ctx: Context, rules: Sequence[str], output_column: str = "label", default: str | None = None) -> StepResult:
    """rule_label with a rule's value as it is written: true is 'true', 01 is '01', quotes go, null is null."""
    return _rule_label(df, rules, output_column, default, lambda tok: tok[1][1:-1] if tok[0] == "s" else None if tok[1].lower() == "null" else tok[1])


def _rule_label(df: DataFrame, rules: Sequence[str], output_column: str, default: str | None, literal) -> StepResult:
    if output_column in df.columns:
        raise Refused("output_column_exists", output_column)
    value = lambda tok: F.col(tok[1][1:]).cast("string") if tok[0] == "w" and tok[1].startswith("@") else F.lit(literal(tok)).cast("string")
    out = F.lit(default).cast("string")
    for rule in reversed(rules):
        t = _tokens(rule)
        if len(t) < 3 or t[1] != ("w", "if"):
            raise Refused("rule_syntax", rule)
        parts, one = [], []
        for tok in t[2:]:
            if tok == ("w", "and"):
                parts.append(one)
                one = []
            else:
                one.append(tok)
        parts.append(one)
        test = F.lit(True)
        for p in parts:
            test = test & _condition(df, p)
        out = F.when(test, value(t[0])).otherwise(out)
    return StepResult(df.withColumn(output_column, out))


# The pattern dialect: what linear-time engines know, ASCII classes, $ only as the very end.
_FOREIGN = re.compile(r"\(\?[=!<>#(]|\(\?P=|\\[1-9]|\\[GXRKZ]|[*+?}]\+")
_FULLWIDTH = {i: i - 0xFEE0 for i in range(0xFF01, 0xFF5F)}


def compile_pattern(pattern: str, ignore_case: bool = False) -> re.Pattern:
    if _FOREIGN.search(re.sub(r"\\\\", "", pattern)):
        raise Refused("pattern_not_supported", pattern)
    try:
        return re.compile(re.sub(r"(?<!\\)\$", r"\\Z", pattern).replace("\\z", "\\Z"), re.ASCII | (re.IGNORECASE if ignore_case else 0))
    except re.error as e:
        raise Refused("pattern_invalid", str(e)) from None


def fold_fullwidth(text: Column) -> Column:
    return F.translate(text, "".join(map(chr, _FULLWIDTH)), "".join(map(chr, _FULLWIDTH.values())))


_SPAN = "struct<matched:boolean,count:int,first:string,start:int,`end`:int,spans:string>"


def regex_match(df: DataFrame, ctx: Context, column: str, pattern: str, ignore_case: bool = False, max_spans: int = 100, output_prefix: str = "rx_", fold_fullwidth_ascii: bool = False) -> StepResult:
    """matched, count, first, start, end and spans (JSON) of a pattern, in code points."""
    compile_pattern(pattern, ignore_case)
    text = as_text(df, column)

    @F.pandas_udf(_SPAN)
    def find(s: pd.Series) -> pd.DataFrame:
        rx = compile_pattern(pattern, ignore_case)
        rows = []
        for t in s:
            spans = [m.span() for m in rx.finditer(t)]
            rows.append((bool(spans), len(spans), t[slice(*spans[0])] if spans else None, spans[0][0] if spans else None, spans[0][1] if spans else None, json.dumps([*map(list, spans[:max_spans])], separators=(",", ":"))))
        return pd.DataFrame(rows, columns=["matched", "count", "first", "start", "end", "spans"]).astype({"start": "Int32", "end": "Int32"})

    d = df.withColumn("__m", find(fold_fullwidth(text) if fold_fullwidth_ascii else text))
    return StepResult(d.select(*df.columns, *[F.col("__m")[n].alias(f"{output_prefix}{n}") for n in ("matched", "count", "first", "start", "end", "spans")]))


def regex_match_v2(df: DataFrame, ctx: Context, column: str, pattern: str, fold_fullwidth_ascii: bool, ignore_case: bool = False, max_spans: int = 100, output_prefix: str = "rx_") -> StepResult:
    """regex_match with folding asked for in so many words: spans are found in the folded view, `first` is the
    text as it stands, and a null cell holds no match, not even an empty one."""
    r = regex_match(df, ctx, column, pattern, ignore_case, max_spans, "__rx_", fold_fullwidth_ascii)
    gone, own = F.col(column).isNull(), {}
    own["matched"] = F.col("__rx_matched") & ~gone
    own["count"] = F.when(gone, 0).otherwise(F.col("__rx_count"))
    own["first"] = F.when(~gone, F.substring(as_text(df, column), F.col("__rx_start") + 1, F.col("__rx_end") - F.col("__rx_start")))
    own |= {n: F.when(~gone, F.col(f"__rx_{n}")) for n in ("start", "end")}
    own["spans"] = F.when(gone, "[]").otherwise(F.col("__rx_spans"))
    return StepResult(r.output.select(*df.columns, *[own[n].alias(f"{output_prefix}{n}") for n in ("matched", "count", "first", "start", "end", "spans")]))


def phrase_proximity(df: DataFrame, ctx: Context, column: str, phrases: Sequence[str], anchor_start_column: str, anchor_end_column: str, max_distance_bytes: int = 100, case_sensitive: bool = False, output_prefix: str = "pp_") -> StepResult:
    """The phrase nearest to the anchor span and the gap between them in UTF-8 bytes; overlap is 0.

    Ties go to the earlier declared phrase, then to the one on the left.
    """
    require(df, column, anchor_start_column, anchor_end_column)

    @F.pandas_udf("struct<near:boolean,phrase:string,distance:int,side:string>")
    def nearest(t: pd.Series, s: pd.Series, e: pd.Series) -> pd.DataFrame:
        rows = []
        for text, a, b in zip(t, s, e):
            best = None
            if text is not None and not pd.isna(a) and not pd.isna(b):
                where = text if case_sensitive else text.lower()
                a, b = int(a), int(b)
                for i, p in enumerate(phrases):
                    q = p if case_sensitive else p.lower()
                    at = where.find(q)
                    while at >= 0:
                        end = at + len(q)
                        gap, side = (len(text[end:a].encode()), 0) if end <= a else (len(text[b:at].encode()), 1) if at >= b else (0, 0)
                        if gap <= max_distance_bytes and (best is None or (gap, i, side) < best[:3]):
                            best = (gap, i, side)
                        at = where.find(q, at + 1)
            rows.append((best is not None, phrases[best[1]] if best else None, best[0] if best else None, ("left", "right")[best[2]] if best else None))
        return pd.DataFrame(rows, columns=["near", "phrase", "distance", "side"]).astype({"distance": "Int32"})

    d = df.withColumn("__m", nearest(F.col(column), F.col(anchor_start_column), F.col(anchor_end_column)))
    return StepResult(d.select(*df.columns, *[F.col("__m")[n].alias(f"{output_prefix}{n}") for n in ("near", "phrase", "distance", "side")]))


class RuleSet:
    """A rule-set document, compiled.

    signals: name -> {kind: pattern|proximity|validator|lexical_weights, ...}; vetoes: [{signal,
    by: [names]}]; expression: {signal|all|any|not|within_n}; outputs: name -> {of, take}.
    """

    def __init__(self, document: dict):
        self.doc = document
        self.rx = {}
        for name, s in document["signals"].items():
            if s["kind"] in ("pattern", "proximity"):
                self.rx[name] = compile_pattern(s["pattern"], s.get("ignore_case", False))
            elif s["kind"] == "validator":
                self.rx[name] = compile_pattern(s.get("candidates", r"[0-9][0-9 -]{6,40}[0-9]"))
            elif s["kind"] == "lexical_weights":
                self.rx[name] = [(re.compile(r"(?<!\w)" + re.escape(w) + r"(?!\w)", re.IGNORECASE), x) for w, x in s["weights"].items()]
            else:
                raise Refused("rule_signal_error", s["kind"])

    def spans(self, name: str, text: str) -> list[tuple[int, int]]:
        from sievework.functions.identifiers import validate

        s, rx = self.doc["signals"][name], self.rx[name]
        if s["kind"] == "lexical_weights":
            hits = [(w, [m.span() for m in r.finditer(text)]) for r, w in rx]
            total = sum(w * (len(h) if s.get("count") == "occurrences" else 1) for w, h in hits if h)
            return sorted(x for _, h in hits for x in h) if total >= s["cut"] else []
        found = [m.span() for m in rx.finditer(text)]
        if s["kind"] == "validator":
            return [x for x in found if validate(s["scheme"], text[slice(*x)]).valid]
        if s["kind"] == "proximity":
            size = (lambda p: len(p.encode())) if s.get("unit") == "utf8_bytes" else len
            low, kept = text.lower(), []
            for a, b in found:
                for p in s["phrases"]:
                    at = low.find(p.lower())
                    hit = False
                    while at >= 0 and not hit:
                        end = at + len(p)
                        before, after = end <= a, at >= b
                        gap = size(text[end:a]) if before else size(text[b:at]) if after else 0
                        hit = gap <= s["max_distance"] and (s.get("side", "either") == "either" or (s["side"] == "before" and not after) or (s["side"] == "after" and not before))
                        at = low.find(p.lower(), at + 1)
                    if hit:
                        kept.append((a, b))
                        break
            return kept
        return found

    def evaluate(self, text: str) -> dict:
        got = {n: self.spans(n, text) for n in self.doc["signals"]}
        vetoed = False
        for v in self.doc.get("vetoes", []):
            bars = [x for n in v["by"] for x in got[n]]
            keep = [x for x in got[v["signal"]] if not any(x[0] < y[1] and y[0] < x[1] for y in bars)]
            vetoed |= len(keep) < len(got[v["signal"]])
            got[v["signal"]] = keep

        def holds(e: dict) -> bool:
            (op, arg), = e.items()
            if op == "signal":
                return bool(got[arg])
            if op == "all":
                return all(map(holds, arg))
            if op == "any":
                return any(map(holds, arg))
            if op == "not":
                return not holds(arg)
            if op == "within_n":
                return any(max(x[0], y[0]) - min(x[1], y[1]) <= arg["n"] for x in got[arg["a"]] for y in got[arg["b"]])
            raise Refused("rule_signal_error", op)

        out = {"vetoed": vetoed}
        for name, o in self.doc["outputs"].items():
            spans = got[o["of"]] if "of" in o else []
            out[name] = {"fired": lambda: holds(o["expression"]) if "expression" in o else bool(spans), "count": lambda: len(spans), "first": lambda: text[slice(*spans[0])] if spans else None, "spans": lambda: [*map(list, spans)]}[o["take"]]()
        return out


def rule_set(df: DataFrame, ctx: Context, document: dict, text_column: str, output_prefix: str = "rs_") -> StepResult:
    """Outputs of a rule set per row, each under the prefix, and whether a veto removed anything."""
    RuleSet(document)
    kinds = {"fired": "boolean", "count": "int", "first": "string", "spans": "string"}
    names = {n: kinds[o["take"]] for n, o in document["outputs"].items()} | {"vetoed": "boolean"}

    @F.pandas_udf("struct<" + ",".join(f"`{n}`:{t}" for n, t in names.items()) + ">")
    def run(s: pd.Series) -> pd.DataFrame:
        rules = RuleSet(document)
        rows = [rules.evaluate(t) for t in s]
        return pd.DataFrame([[json.dumps(r[n], separators=(",", ":")) if isinstance(r[n], list) else r[n] for n in names] for r in rows], columns=list(names))

    d = df.withColumn("__m", run(as_text(df, text_column)))
    return StepResult(d.select(*df.columns, *[F.col("__m")[n].alias(f"{output_prefix}{n}") for n in names]))


#: The words that stand for digits.
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def _mapped(value: Column, mapping: dict[str, str]) -> Column:
    """From left to right the longest key that stands at a place becomes its value; other characters stay."""
    keys = sorted((k for k in mapping if k), key=lambda k: (-len(k), k))
    if not keys:
        return value
    table = F.create_map(*[F.lit(x) for k in keys for x in (k, mapping[k])])
    tokens = F.regexp_extract_all(value, F.lit("(?s)" + "|".join(rf"\Q{k}\E" for k in keys) + "|."), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t)), "")


def render(kind: str, value: Column, mapping: dict[str, str] | None = None) -> Column:
    """Another spelling of a value: spaced, split_lines, spelled_out_digits (each character a token), or a mapping."""
    if kind == "spaced":
        return F.array_join(F.split(value, ""), " ")
    if kind == "split_lines":
        return F.array_join(F.split(value, ""), "\n")
    if kind == "spelled_out_digits":
        table = F.create_map(*[F.lit(x) for d, w in enumerate(DIGIT_WORDS) for x in (str(d), w)])
        return F.array_join(F.transform(F.split(value, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), " ")
    if kind == "mapping" and mapping:
        return _mapped(value, mapping)
    raise Refused("rendering_not_runnable", kind)


def normalise_rendering(kind: str, value: Column, mapping: dict[str, str] | None = None) -> Column:
    """A rendering's inverse: digits_only, strip_delimiters, words_to_digits (null where tokens are not parted
    by one space each), or mapping_inverse of the mapping it was rendered by, whose values are distinct."""
    if kind == "digits_only":
        return F.regexp_replace(value, "[^0-9]", "")
    if kind == "strip_delimiters":
        return F.regexp_replace(value, r"[ \n.-]", "")
    if kind == "words_to_digits":
        token = f"(?:(?:{'|'.join(DIGIT_WORDS)})(?= |\\z)|.)"
        table = F.create_map(*[F.lit(x) for d, w in enumerate(DIGIT_WORDS) for x in (w, str(d))])
        found = F.regexp_extract_all(value, F.lit(f"(?s)({token})(?: |\\z)"), F.lit(1))
        text = F.array_join(F.transform(found, lambda t: F.coalesce(F.try_element_at(table, t), t)), "")
        return F.when(value.rlike(f"(?s)\\A(?:{token}(?: |\\z))*\\z"), text)
    if kind == "mapping_inverse" and mapping:
        if len(set(mapping.values())) != len(mapping):
            raise Refused("mapping_not_invertible")
        return _mapped(value, {v: k for k, v in mapping.items()})
    raise Refused("rendering_not_runnable", kind)


def truth_table(columns: Sequence[str], table: Sequence[dict], default: str | None = None) -> Column:
    """The 'label' of the first line whose cells all match; '*' or an absent cell matches anything.

    A line that an earlier one shadows wholly is refused, as it can never be first.
    """
    seen: list[dict] = []
    for line in table:
        want = {c: line[c] for c in columns if line.get(c, "*") != "*"}
        if any(all(want.get(c) == v for c, v in s.items()) for s in seen):
            raise Refused("shadowed_line", json.dumps(line))
        seen.append(want)
    out = F.lit(default).cast("string")
    for line, want in reversed([*zip(table, seen, strict=True)]):
        test = F.lit(True)
        for c, v in want.items():
            test = test & F.col(c).cast("string").eqNullSafe(F.lit(v))
        out = F.when(test, F.lit(line["label"])).otherwise(out)
    return out


def derive_labels(df: DataFrame, ctx: Context, label_column: str, columns: Sequence[str], table: Sequence[dict], fired_columns: Sequence[str] = (), decoy_column: str | None = None, output_prefix: str = "rs_") -> StepResult:
    """Labels by a truth table; a decoy row on which any rule fired by accident drops."""
    require(df, *columns, *fired_columns)
    if label_column in df.columns:
        raise Refused("output_column_exists", label_column)
    d = df.withColumn(label_column, truth_table(columns, table))
    if not decoy_column:
        return StepResult(d)
    first = F.coalesce(*[F.when(F.col(c), F.lit(c)) for c in fired_columns])
    return drop(d, [Reason(F.coalesce(F.col(decoy_column), F.lit(False)) & first.isNotNull(), "decoy_accidental_match", "output", text=first)])


def overlaps(spans: Column, other: Column) -> Column:
    """Whether any half-open span of one array (struct start, end) meets one of the other."""
    return F.exists(spans, lambda s: F.exists(other, lambda e: (s["start"] < e["end"]) & (e["start"] < s["end"])))


def calibration_labels(df: DataFrame, ctx: Context, output_column: str, excluded: DataFrame | None = None, group_columns: Sequence[str] = ()) -> StepResult:
    """Human labels by row key; rows without one, or that share a key or a group value with the
    excluded rows, drop. ctx.inputs['calibration']: (row_key, label)."""
    lab = ctx.inputs["calibration"].select(F.col("row_key").alias("__k"), F.col("label").alias(output_column))
    d = df.join(lab, F.col(KEY) == F.col("__k"), "left")
    reasons, extra = [Reason(F.col("__k").isNull(), "not_in_calibration_set", "calibration_set")], ["__k"]
    if excluded is not None:
        d = d.join(excluded.select(F.col(KEY).alias("__x")).distinct(), F.col(KEY) == F.col("__x"), "left")
        reasons.append(Reason(F.col("__x").isNotNull(), "shares_row_with_excluded_split", KEY))
        extra.append("__x")
        for i, g in enumerate(group_columns):
            if g not in excluded.columns:
                raise Refused("exclude_version_no_group_columns", g)
            d = d.join(excluded.where(F.col(g).isNotNull()).select(F.col(g).alias(f"__g{i}")).distinct(), F.col(g) == F.col(f"__g{i}"), "left")
            reasons.append(Reason(F.col(f"__g{i}").isNotNull(), "shares_group_with_excluded_split", g))
            extra.append(f"__g{i}")
    return drop(d, reasons, extra)


#: Bits of the filter of grams that may be chosen; grams that a task counts before it passes them on.
_PLACES, _COUNTED = 1 << 26, 1 << 19


def _gram_places(tokens: list[str], known: dict[str, int]) -> list[np.ndarray]:
    """Bit of every 1-, 2- and 3-gram in the filter, by length. known: hashes of tokens seen."""
    import xxhash

    if len(known) > _COUNTED:
        known.clear()
    for t in tokens:
        if t not in known:
            known[t] = xxhash.xxh64_intdigest(t)
    h = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    mix = lambda x: (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    two = mix(h[:-1]) + h[1:]
    three = mix(two[:-1]) + h[2:]
    return [(mix(x) >> np.uint64(38)).astype(np.int64) for x in (h, two, three)]


def _gram_counts(d: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """(gram, n, y) of rows (t: tokens joined by spaces, y): rows and positive rows with the gram. Tasks
    count first. bits: only grams whose bit is set, which saves the others their way."""

    def count(batches):
        every, good, known = Counter(), Counter(), {}

        def table():
            grams = list(every)
            return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(every.values(), pa.int64()), pa.array([good[g] for g in grams], pa.int64())], names=["gram", "n", "y"])

        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = t.split()
                if bits is None:
                    grams = {*w, *map(" ".join, zip(w, w[1:])), *map(" ".join, zip(w, w[1:], w[2:]))}
                else:
                    grams = set()
                    for n, at in enumerate(_gram_places(w, known), 1):
                        hit = np.flatnonzero(bits[at >> 3] >> (at & 7) & 1).tolist()
                        grams.update([w[i] for i in hit] if n == 1 else [" ".join(w[i : i + n]) for i in hit])
                every.update(grams)
                if y:
                    good.update(grams)
                if len(every) > _COUNTED:
                    yield table()
                    every.clear(), good.clear()
        if every:
            yield table()

    return d.select("t", "y").mapInArrow(count, "gram string, n long, y long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))


def _gram_filter(grams: DataFrame) -> np.ndarray:
    """The filter with the bits of these grams: of one size, whatever their number."""

    def place(batches):
        known = {}
        for b in batches:
            tokens = [g.split() for g in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(_gram_places(w, known)[len(w) - 1][0]) + 1 for w in tokens], pa.int64())], names=["at"])

    bits = np.zeros(_PLACES // 8, dtype=np.uint8)
    placed = grams.select("gram").mapInArrow(place, "at long").groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    for r in placed.toLocalIterator():
        part = np.frombuffer(r["bits"], dtype=np.uint8)
        bits[(r["b"] - 1) * len(part) : r["b"] * len(part)] = part
    return bits


def learn_phrases(df: DataFrame, text_column: str, label_column: str, positive: str, rounds: int = 10, min_support: int = 5, min_precision: float = 0.9, held_out_mod: int = 5) -> DataFrame:
    """Sequential cover: the 1-3-gram of the best precision (then support) each round, until none is
    good enough; rows it covers leave. Precision is measured again on held-out rows (a hash of the
    key). One row per literal.

    Counts only fall as rows leave, so a gram can be chosen in any round only if enough positive rows
    have it at first: the others are not counted in the rest of the rows. Each round takes the counts
    of the rows that leave from the table of counts; grams of rows are never written down."""
    tokens = F.regexp_extract_all(F.lower(as_text(df, text_column)), F.lit("[0-9A-Za-z_]+"), F.lit(0))
    d = df.where(F.col(label_column).isNotNull()).select((F.col(label_column).cast("string") == positive).cast("int").alias("y"), F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).alias("t"), (F.pmod(F.xxhash64(KEY), F.lit(held_out_mod)) == 0).alias("held"))
    d = materialise(d, "tokens")
    has = lambda gram: F.contains("t", F.concat(F.lit(" "), gram, F.lit(" ")))
    left, found = d.where("not held"), []
    need, bits = math.ceil(min_support * min_precision - 1e-9), None
    if need > 0:
        bits = _gram_filter(_gram_counts(left.where("y = 1")).where(F.col("n") >= need))
    counts = materialise(_gram_counts(left, bits).where(F.col("y") >= need), "counts") if rounds > 0 else None
    while len(found) < rounds:
        best = counts.withColumn("precision", F.col("y") / F.col("n")).where((F.col("n") >= max(1, min_support)) & (F.col("precision") >= min_precision)).orderBy(F.desc("precision"), F.desc("n"), "gram").first()
        if best is None:
            break
        found.append((best["gram"], best["n"], best["precision"]))
        if len(found) < rounds:
            gone, left = left.where(has(F.lit(best["gram"]))), left.where(~has(F.lit(best["gram"])))
            fewer = _gram_counts(gone, bits).withColumnsRenamed({"n": "gone_n", "y": "gone_y"})
            rest = counts.join(fewer, "gram", "left").select("gram", (F.col("n") - F.coalesce("gone_n", F.lit(0))).alias("n"), (F.col("y") - F.coalesce("gone_y", F.lit(0))).alias("y"))
            last, counts = counts, materialise(rest.where((F.col("n") >= max(1, min_support)) & (F.col("y") >= need)), "counts")
            discard(last)
    lits = df.sparkSession.createDataFrame(found, "gram string, support long, precision double")
    hits = F.filter(F.array(*[F.lit(g) for g, _, _ in found]).cast("array<string>"), has)
    test = d.where("held").select("y", F.explode(hits).alias("gram")).groupBy("gram").agg(F.count("*").alias("held_support"), F.avg("y").alias("held_precision"))
    return lits.join(test, "gram", "left")

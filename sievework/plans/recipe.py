"""Recipes: registered operators, checked parameters, and the runner that accounts for every row."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from sievework.operators import audits, behaviour, chat, filters, generation, identifier_ops, labels, reports, selection
from sievework.operators.components import connected_components
from sievework.operators.rows import EVENT_SCHEMA, KEY, OCC, ORIGIN, SPLIT, Context, Refused, StepResult, conservation, content_text, word_count
from sievework.plans.staging import materialise, stage_path
from sievework.sources.writers import canonical_json


@dataclass
class Operator:
    name: str
    version: str
    kind: str
    run: Callable[..., StepResult]
    #: Parameter -> ('min', x), ('choices', {...}) and the like, beside the signature.
    bounds: dict = field(default_factory=dict)


REGISTRY: dict[str, Operator] = {}
#: What a kind may do to rows.
EFFECTS = {
    "filter": {"dropped"}, "deduplicator": {"dropped"}, "selector": {"dropped", "split_assigned"}, "mapper": {"dropped", "changed"}, "labeler": {"dropped"}, "generator": {"added"},
    "report": set(), "check": set(),
}


def register(name: str, version: str, kind: str, run: Callable, **bounds) -> None:
    ref = f"{name}@{version}"
    if ref in REGISTRY:
        raise Refused("duplicate", ref)
    REGISTRY[ref] = Operator(name, version, kind, run, bounds)


def load_plugins(group: str = "sievework.operators", allowed: tuple[str, ...] = ()) -> dict[str, str]:
    """Register operators that installed distributions offer as entry points: 'name@version' -> state.

    Only distributions named in allowed are loaded. An entry point gives (name, version, kind, run). A
    state is 'registered', 'not allowed', 'duplicate', or 'failed: ' and why.
    """
    from importlib.metadata import entry_points

    states = {}
    for point in entry_points(group=group):
        if point.dist is None or point.dist.name not in allowed:
            states[point.name] = "not allowed"
            continue
        try:
            row = point.load()
            register(*row)
            states[f"{row[0]}@{row[1]}"] = "registered"
        except Refused as e:
            states[point.name] = e.code
        except Exception as e:  # a plugin is its author's code
            states[point.name] = f"failed: {type(e).__name__}: {e}"
    return states


def registry_states(refs: list[str]) -> dict[str, str]:
    """'registered' or 'not registered' of each 'name@version'; another version of the name is named."""
    names = {ref.split("@")[0]: ref for ref in REGISTRY}
    return {r: "registered" if r in REGISTRY else f"not registered; there is {names[r.split('@')[0]]}" if r.split("@")[0] in names else "not registered" for r in refs}


def check_params(op: Operator, params: dict) -> None:
    """Names against the signature, values against the bounds."""
    known = [*inspect.signature(op.run).parameters.values()][2:]
    extra = set(params) - {p.name for p in known}
    missing = {p.name for p in known if p.default is inspect.Parameter.empty} - set(params)
    if extra or missing:
        raise Refused("params_invalid", f"{op.name}: unknown {sorted(extra)}, missing {sorted(missing)}")
    for k, (low, high) in op.bounds.items():
        v = params.get(k)
        if v is not None and not (low is None or v >= low) or v is not None and not (high is None or v <= high):
            raise Refused("params_invalid", f"{op.name}: {k}={v}")


def _exact(df, ctx, collapse_whitespace: bool = False):
    return selection.dedup_exact(df, ctx, collapse_whitespace)


def _cluster_balancer(df, ctx, k: int = 50, cap: int | None = None, cap_share: float | None = None, applies_to: str = "all"):
    return selection.cap_clusters(df, ctx, reports.text_clusters(df, list(ctx.content), k, ctx.seed), cap, cap_share, applies_to)


def _stat(name: str, low_name: str, high_name: str) -> Callable:
    def run(df, ctx, text_key: str = "text", rep_len: int = 10, **band):
        return filters.statistic_filter(df, ctx, name, text_key, band.get(low_name, 0.0), band.get(high_name, float("inf")), rep_len)

    ps = [inspect.Parameter(n, inspect.Parameter.POSITIONAL_OR_KEYWORD) for n in ("df", "ctx")] + [inspect.Parameter(n, inspect.Parameter.KEYWORD_ONLY, default=d) for n, d in (("text_key", "text"), ("rep_len", 10), (low_name, 0.0), (high_name, float("inf")))]
    run.__signature__ = inspect.Signature(ps)
    return run


def _split(df, ctx, split_names=("train", "test"), split_fractions=(0.9, 0.1), held_out=("test",), stratify_by=(), group_column: str | None = None, mode: str = "reassign"):
    return selection.split(df, ctx, split_names, split_fractions, stratify_by, (group_column,) if group_column else (), held_out=held_out, mode=mode)


def _sample(df, ctx, mode="count", count=None, fraction=None, seed=None, strata=None, per_stratum=None, always_keep_column=None, instructed_column=None, instructed_values=None, instructed_rate=0.0, instructed_min=0):
    if mode == "stratified":
        if not strata or not per_stratum:
            raise Refused("params_invalid")
        return selection.sample_stratified(df, ctx, strata, per_stratum, always_keep_column, instructed_column, instructed_values, instructed_rate, instructed_min, seed)
    return selection.sample(df, ctx, mode, count, fraction, seed)


def _move(df, ctx, move_where: list, move_to: str, move_fraction: float, move_from=("train",), group_columns=()):
    test = F.lit(True)
    for x in move_where:
        test = test & filters.OPS[x["op"]](F.col(x["column"]), x.get("value"))
    return selection.move(df, ctx, test, move_to, move_fraction, move_from, group_columns)


def near_pairs(df: DataFrame, content, threshold: float = 0.8) -> DataFrame:
    """(a, b, estimate) of near-duplicate keys; copies of a key are signed once."""
    one = df.groupBy(KEY).agg(F.min(content_text(df, content)).alias("__t"))
    return materialise(selection.minhash_pairs(selection.minhash_signatures(one, F.col("__t"), "word", 5, 128).select(KEY, "__sig"), KEY, threshold, 128), "near")


# Reports: rows pass as they are; the tables stand beside them.
def _profile(df, ctx, near: bool = True, clusters: int | None = None):
    text = content_text(df, ctx.content)
    d = df.withColumn("__length", F.length(text)).withColumn("__words", word_count(text))
    tables = {
        "rows": reports.version_profile(df, list(ctx.content)), "columns": reports.column_profile(df, [c for c in df.columns if not c.startswith("_dw_") and not isinstance(df.schema[c].dataType, (ArrayType, MapType, StructType))]),
        "length": reports.histogram(d, "__length", 20), "words": reports.histogram(d, "__words", 20),
    }
    missing = []
    chats = [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType)]
    if chats:
        tables |= {"turns": reports.histogram(df.withColumn("__turns", F.size(chats[0])), "__turns", 20), "roles": reports.turns_by_role(df, chats[0])}
    else:
        missing.append(("turns", "no chat column"))
    if near:
        comps = connected_components(near_pairs(df, ctx.content), "a", "b").groupBy("root").agg(F.count("*").alias("size"))
        tables["near_duplicates"] = comps.agg(F.count("*").alias("groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("keys"), F.max("size").alias("largest"))
    else:
        missing.append(("near_duplicates", "not asked"))
    if clusters:
        tables["clusters"] = reports.cluster_sizes(reports.text_clusters(df, list(ctx.content), clusters, ctx.seed))
    else:
        missing.append(("clusters", "not asked"))
    tables["not_computed"] = df.sparkSession.createDataFrame(missing, "what string, reason string")
    return StepResult(df, None, tables)


def _audit(df, ctx, columns: list, label_column: str = "label", folds: int = 5, control_runs: int = 5, tolerance_pp: float = 2.0):
    return StepResult(df, None, {"columns": reports.shortcut_audit(df, columns, label_column, folds, control_runs, tolerance_pp, ctx.seed)})


def _leakage(df, ctx, group_column: str | None = None, near: bool = True, threshold: float = 0.8):
    pairs = near_pairs(df, ctx.content, threshold) if near else None
    return StepResult(df, None, {"crossings": reports.leakage(df, list(ctx.content), group_column, pairs), "pairs": audits.leakage_pairs(df, ctx.content, group_column, pairs)})


def _contamination(df, ctx, n: int = 13):
    return StepResult(df, None, {"rows": reports.contamination(df, list(ctx.content), ctx.inputs["benchmark"], n).where("hits > 0")})


def _cluster(df, ctx, k: int = 50):
    c = materialise(reports.text_clusters(df, list(ctx.content), k, ctx.seed), "clusters")
    return StepResult(df, None, {"assignments": c, "sizes": reports.cluster_sizes(c), "coverage": audits.cluster_coverage(c, k)})


def _cluster_embedding(df, ctx, k: int = 50):
    c = materialise(reports.vector_clusters(ctx.inputs["vectors"], k, ctx.seed), "clusters")
    return StepResult(df, None, {"assignments": c, "sizes": reports.cluster_sizes(c), "coverage": audits.cluster_coverage(c, k)})


for _row in (
    ("profile", "1.0.0", "report", _profile), ("shortcut_audit", "1.0.0", "report", _audit), ("leakage_check", "1.0.0", "report", _leakage), ("contamination_check", "1.0.0", "report", _contamination),
    ("cluster", "1.0.0", "report", _cluster), ("cluster_embedding", "1.0.0", "report", _cluster_embedding), ("check_carrier_ids", "1.0.0", "check", behaviour.carrier_check), ("split", "1.3.0", "selector", audits.split_marked),
    ("length_band", "1.0.0", "filter", filters.length_band), ("turn_count_band", "1.0.0", "filter", filters.turn_count_band), ("empty_content", "1.0.0", "filter", filters.empty_content),
    ("metadata_value_filter", "1.0.0", "filter", filters.metadata_value_filter), ("screen_filter", "1.0.0", "filter", filters.screen_filter), ("feature_filter", "1", "filter", filters.feature_filter),
    ("drop_leakage_pairs", "1.0.0", "filter", filters.drop_leakage_pairs), ("decontaminate", "1.0.0", "filter", reports.decontaminate), ("trl_validate", "1.0.0", "filter", chat.trl_validate),
    ("drop_columns", "1", "mapper", filters.drop_columns), ("dedup_exact", "1.0.0", "deduplicator", _exact), ("document_deduplicator", "1", "deduplicator", selection.document_deduplicator),
    ("dedup_minhash", "1.0.0", "deduplicator", selection.dedup_minhash), ("dedup_embedding", "1.0.0", "deduplicator", selection.dedup_embedding), ("sample", "1.0.0", "selector", selection.sample),
    ("sample", "1.1.0", "selector", _sample), ("label_balancer", "1.0.0", "selector", selection.label_balancer), ("cell_balancer", "1.0.0", "selector", selection.cell_balancer),
    ("cluster_balancer", "1.1.0", "selector", _cluster_balancer), ("split", "1.0.0", "selector", _split), ("split", "1.1.0", "selector", selection.split), ("split", "1.2.0", "selector", _move),
    ("normaliser", "1.0.0", "mapper", chat.normaliser), ("chat_json_parser", "1.0.0", "mapper", chat.chat_json_parser), ("threshold_labeler", "1", "labeler", labels.threshold_labeler),
    ("rule_label", "1", "labeler", labels.rule_label), ("rule_label", "2", "labeler", labels.rule_label_v2), ("regex_match", "1", "labeler", labels.regex_match), ("regex_match", "2", "labeler", labels.regex_match_v2),
    ("phrase_proximity", "1", "labeler", labels.phrase_proximity), ("rule_set", "1", "labeler", labels.rule_set), ("derive_labels", "1.0.0", "labeler", labels.derive_labels),
    ("calibration_labels", "1.0.0", "labeler", labels.calibration_labels), ("synth_identifier", "1", "labeler", identifier_ops.synth_identifier), ("synth_identifier", "1.1.0", "labeler", identifier_ops.synth_identifier),
    ("checksum_validate", "1", "labeler", identifier_ops.checksum_validate), ("generated_rows", "1", "generator", generation.generated_rows), ("judge_filter", "1", "selector", generation.judge_filter),
    ("pair_filter", "1", "selector", generation.pair_filter), ("pair_from_scores", "1", "generator", generation.pair_from_scores), ("minimal_pair_scope", "1", "selector", generation.minimal_pair_scope),
    ("minimal_pair_join", "1", "labeler", generation.minimal_pair_join), ("hard_negative_miner", "1", "selector", generation.hard_negative_miner), ("carrier_plan", "1.1.0", "mapper", behaviour.carrier_plan),
    ("insert_element", "1.0.0", "mapper", behaviour.insert_element), ("slot_siblings", "1.1.0", "generator", behaviour.slot_siblings),
):
    register(*_row)
register("ngram_repetition", "1.0.0", "filter", filters.ngram_repetition, n=(1, 10), max_ratio=(0, 1))
for _n, (_s, _l, _h) in filters.STATISTIC_FILTERS.items():
    register(_n, "1", "filter", _stat(_n, _l, _h))


def step_seed(seed: int, step: int, operator: str) -> int:
    return int.from_bytes(hashlib.sha256(canonical_json({"seed": seed, "step": step, "operator": operator})).digest()[:4], "big")


def recipe_hash(steps: list[dict]) -> str:
    return hashlib.sha256(canonical_json({"steps": steps})).hexdigest()


@dataclass
class VersionResult:
    output: DataFrame
    events: DataFrame
    steps: list[dict]
    recipe: str
    #: "step:operator@version" -> the tables of a report.
    reports: dict = field(default_factory=dict)


def run_recipe(spark: SparkSession, rows: DataFrame, steps: list[dict], content: tuple = ("text",), seed: int = 0, inputs: dict | None = None, verify: bool = True, reuse: dict | None = None) -> VersionResult:
    """Run steps [{operator, version, params}] in order.

    Each step's output is written once in the shared folder and read by the next, and by its own
    accounting: verify compares pairs (key, occurrence) of input, output and events, and refuses a
    step that loses rows without an event or invents them, or has an effect its kind may not have.
    reuse: digest -> paths of earlier steps; a step with the same digest is not run again.
    """
    digest = recipe_hash(steps)
    at, log, events, tables = rows, [], [], {}
    chain = hashlib.sha256(b"rows")
    for i, s in enumerate(steps):
        ref = f"{s['operator']}@{s['version']}"
        if ref not in REGISTRY:
            raise Refused("operator_not_registered", ref)
        op, params = REGISTRY[ref], s.get("params", {})
        check_params(op, params)
        chain.update(canonical_json({"ref": ref, "params": params, "seed": seed, "content": list(content)}))
        key = chain.hexdigest()
        if reuse is not None and key in reuse:
            out, ev = (spark.read.parquet(p) for p in reuse[key])
        else:
            ctx = Context(content, step_seed(seed, i, ref), inputs or {})
            r = op.run(at, ctx, **params)
            if op.kind in ("report", "check"):  # rows pass as they are
                if r.output.columns != at.columns or r.events is not None:
                    raise Refused("effect_not_allowed", ref)
                tables[f"{i}:{ref}"] = {k: materialise(t, "report") for k, t in r.report.items()}
                log.append({"step": i, "operator": ref, "digest": key})
                continue
            e = r.events if r.events is not None else spark.createDataFrame([], EVENT_SCHEMA)
            paths = (stage_path(spark, f"step{i}"), stage_path(spark, f"events{i}"))
            r.output.write.parquet(paths[0])
            e.write.parquet(paths[1])
            out, ev = (spark.read.parquet(p) for p in paths)
            if verify:
                kinds = {x[0] for x in ev.select("kind").distinct().collect()}  # at most four
                if kinds - EFFECTS[op.kind]:
                    raise Refused("effect_not_allowed", f"{ref}: {sorted(kinds - EFFECTS[op.kind])}")
                wrong = {k: n for k, n in conservation(at, StepResult(out, ev)).items() if n}
                if wrong:
                    raise Refused("conservation", f"{ref}: {wrong}")
            if reuse is not None:
                reuse[key] = paths
        events.append(ev.withColumn("step", F.lit(i)).withColumn("operator", F.lit(ref)))
        log.append({"step": i, "operator": ref, "digest": key})
        at = out
    every = events[0] if events else spark.createDataFrame([], EVENT_SCHEMA).withColumn("step", F.lit(0)).withColumn("operator", F.lit(""))
    for e in events[1:]:
        every = every.unionByName(e)
    return VersionResult(at, every, log, digest, tables)

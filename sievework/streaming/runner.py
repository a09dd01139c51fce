"""Row-scope recipes over a stream: each micro-batch goes through the same operators.

Filters and mappers without state treat a row the same in any batch. Operators that look at the
whole table are batch only and are refused here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sievework.operators.rows import Context, Refused
from sievework.plans.recipe import REGISTRY, check_params

ROW_SCOPE = {
    "length_band", "turn_count_band", "empty_content", "ngram_repetition", "metadata_value_filter", "screen_filter", "trl_validate", "rule_label", "regex_match", "phrase_proximity", "rule_set",
    "text_length_filter", "words_num_filter", "alphanumeric_filter", "special_characters_filter", "character_repetition_filter", "synth_identifier", "checksum_validate", "drop_columns",
}


def transform(df: DataFrame, steps: list[dict], content: tuple = ("text",)) -> DataFrame:
    """The steps' output over a batch or streaming frame of assembled rows."""
    for s in steps:
        op = REGISTRY[f"{s['operator']}@{s['version']}"]
        if op.name not in ROW_SCOPE:
            raise Refused("dataset_scope_in_stream", op.name)
        check_params(op, s.get("params", {}))
        df = op.run(df, Context(content), **s.get("params", {})).output
    return df


def run_stream(stream: DataFrame, steps: list[dict], output: str, checkpoint: str, content: tuple = ("text",), available_now: bool = True):
    """Append the surviving rows of a stream to Parquet; events of each batch go beside them."""

    def batch(df: DataFrame, number: int) -> None:
        at = df.persist()
        try:
            for i, s in enumerate(steps):
                op = REGISTRY[f"{s['operator']}@{s['version']}"]
                if op.name not in ROW_SCOPE:
                    raise Refused("dataset_scope_in_stream", op.name)
                r = op.run(at, Context(content), **s.get("params", {}))
                if r.events is not None:
                    r.events.write.mode("overwrite").parquet(f"{output}/events/batch={number}/step={i}")
                at = r.output
            at.write.mode("overwrite").parquet(f"{output}/rows/batch={number}")
        finally:
            df.unpersist()

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()

"""Sinks: versions, exports, events, manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievework.operators.chat import EXPORT_VARIANTS
from sievework.operators.rows import KEY, OCC, ORIGIN, SPLIT, Refused


def canonical_json(value) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def write_version(df: DataFrame, path: str, held_out_empty: list[str] | None = None, rows_per_group: int = 100_000) -> None:
    """A zstd Parquet directory per split; a split declared empty gets a file with the schema only."""
    df.write.option("compression", "zstd").option("parquet.block.row.count.limit", rows_per_group).partitionBy(SPLIT).parquet(path)
    for s in held_out_empty or []:
        df.limit(0).drop(SPLIT).coalesce(1).write.parquet(f"{path}/{SPLIT}={s}")


def write_download(df: DataFrame, split: str, columns: list[str], path: str, kind: str = "jsonl") -> None:
    d = df.where(F.col(SPLIT) == split).select(KEY, *columns)
    if kind == "jsonl":
        d.write.option("ignoreNullFields", "false").json(path)
    elif kind == "parquet":
        d.write.parquet(path)
    else:
        raise Refused("params_invalid", kind)


def write_export(df: DataFrame, target_type: str, path: str) -> dict:
    """Exactly the columns of one of the format's shapes per split, the row keys beside them, and a manifest."""
    columns = next(([*v] for v in EXPORT_VARIANTS.get(target_type, ()) if set(v) <= set(df.columns)), None)
    if columns is None:
        raise Refused("target_columns_missing", target_type)
    df.select(SPLIT, *columns).write.partitionBy(SPLIT).parquet(f"{path}/data")
    df.select(SPLIT, KEY, OCC).write.partitionBy(SPLIT).parquet(f"{path}/row_keys")
    counts = {r[SPLIT]: r["count"] for r in df.groupBy(SPLIT).count().collect()}  # one row a split
    return manifest({"target_type": target_type, "columns": columns, "rows": counts})


def publish_projection(df: DataFrame, effective: DataFrame | None = None, label: str = "label") -> DataFrame:
    """User columns and key, occurrence, origin; overridden labels replace, flagged rows go, others pass.
    effective: (row_key, state, effective_label) of effective_labels()."""
    user = [c for c in df.columns if not c.startswith("_dw_")]
    if effective is None:
        return df.select(*user, KEY, OCC, ORIGIN)
    d = df.join(effective.select(F.col("row_key").alias("__k"), "state", "effective_label"), F.col(KEY) == F.col("__k"), "left")
    d = d.where(F.coalesce(F.col("state") != "flagged_unresolved", F.lit(True)))
    return d.withColumn(label, F.when(F.col("state") == "overridden", F.col("effective_label")).otherwise(F.col(label))).select(*user, KEY, OCC, ORIGIN)


def append_events(events: DataFrame, path: str, step: int) -> None:
    """A directory a step below path; a step that is written again replaces its own events."""
    events.write.mode("overwrite").parquet(f"{path}/step={step}")


def manifest(body: dict) -> dict:
    return body | {"sha256": hashlib.sha256(canonical_json(body)).hexdigest()}


def write_manifest(spark: SparkSession, body: dict, path: str) -> dict:
    m = manifest(body)
    spark.createDataFrame([(canonical_json(m).decode(),)], "value string").coalesce(1).write.text(path)
    return m

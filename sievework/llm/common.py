"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

CRC_OF_ID = "crc32(cast(cast({c} as string) as binary))"


#: Rows and bytes of an Arrow batch: whole texts of any length travel in them, twice as each task overlaps two.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Bound this session's Arrow batches by rows and bytes, so that executors stay within their memory.

    A value that the session has been given, other than Spark's own, stays.
    """
    given = spark.sparkContext.getConf()
    for key, value in BATCHES.items():
        if not given.contains(key):
            spark.conf.set(key, value)


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Give freed memory back to the system when a task ends: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_bucket(column: str, modulus: int):
    """crc32(id as text) mod modulus, as a Column; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def map_texts(
    df: DataFrame, make: Callable[[], Callable[[list, list], list]], id_col: str, text_col: str, schema: str, names: list[str], types: list[pa.DataType],
) -> DataFrame:
    """One output row per input row, from a function of (ids, texts) built once per task.

    Only the two columns reach Python; a null text arrives as ''. The function returns the columns
    after the id, each a list or an Arrow array. Output keeps the order within a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            if b.num_rows:
                texts = [t or "" for t in b.column(1).to_pylist()]
                out = fn(b.column(0).to_pylist(), texts)
                arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=t) for c, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=names)
        release()

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)

"""Lineage cuts through the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only where the session names none and runs in this process (tests, a notebook in local mode) a
    folder of our own is made; it goes when the process ends. A cluster has to name one: RuntimeError.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = path = tempfile.mkdtemp(prefix="sievework-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return _LOCAL_DIRS[app]


def stage_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/sievework/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage as checkpoint() does, but stays columnar, compressed and prunable. The files
    outlive any executor, so a lost one costs no recomputation.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialise() gave, once nothing will read it again."""
    path = getattr(df, "staged_at", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)

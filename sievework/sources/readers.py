"""Sources: Parquet, CSV and JSON Lines, checked as they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievework.operators.rows import KEY, OCC, Refused, assemble

FORMATS = {"parquet": "parquet", "jsonl": "jsonl", "ndjson": "jsonl", "csv": "csv", "tsv": "csv"}


def _head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first n bytes of a file, by the session's file systems; no more of it is read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    size = min(n, files.getFileStatus(where).getLen())
    stream = files.open(where)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def sniff(spark: SparkSession, path: str) -> str:
    """parquet, jsonl or csv by the first bytes; the name's ending must agree."""
    raw = _head(spark, path, 64)
    kind = "parquet" if raw[:4] == b"PAR1" else "jsonl" if raw.lstrip()[:1] == b"{" else "csv"
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in FORMATS and FORMATS[ending] != kind:
        raise Refused("upload_format_mismatch", f"{ending} holds {kind}")
    return kind


def read_parquet(spark: SparkSession, *paths: str, by_name: bool = False) -> DataFrame:
    return spark.read.option("mergeSchema", str(by_name).lower()).parquet(*paths)


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', header: bool = True, encoding: str = "UTF-8", infer: bool = False) -> DataFrame:
    """Text columns, or inferred ones. An empty field is an empty string, not null; a row with another
    number of fields is refused with its content."""
    reader = spark.read.option("sep", delimiter).option("quote", quote).option("escape", quote).option("header", str(header).lower()).option("encoding", encoding).option("multiLine", "true")
    reader = reader.option("nullValue", "\x00").option("emptyValue", "")
    names = reader.option("inferSchema", str(infer).lower()).csv(path).schema
    bad = "_corrupt_record"
    checked = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).schema(names.add(bad, "string")).csv(path)
    first = checked.where(F.col(bad).isNotNull()).limit(1).collect()  # with its fields: the parser wants one of them
    if first:
        raise Refused("upload_malformed", first[0][bad][:200])
    return checked.drop(bad).fillna("")  # text columns: the format has no null


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Every line that is not blank is one object; else the line is named."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    odd = lines.where(~F.trim("value").startswith("{") | F.try_parse_json("value").isNull()).limit(1).collect()
    if odd:
        raise Refused("upload_malformed", odd[0][0][:200])
    return spark.read.json(path)


def read_hub_directory(spark: SparkSession, path: str, splits: list[str], max_rows: int | None = None, order: str | None = None) -> list[tuple[str, DataFrame]]:
    """Splits of a local copy of a published dataset, without its reserved columns; the first max_rows by order."""
    out = []
    for s in splits:
        df = spark.read.parquet(f"{path}/{s}")
        df = df.drop(*[c for c in df.columns if c.startswith("_dw_")])
        if max_rows is not None:
            df = df.orderBy(order or df.columns[0]).limit(max_rows)
        out.append((s, df))
    return out


def index_source(spark: SparkSession, rows: int, start: int = 0, column: str = "index") -> DataFrame:
    return spark.range(start, start + rows).withColumnRenamed("id", column)


def preview(df: DataFrame, content: list[str], order: str, rows: int = 100, seed: int = 0) -> DataFrame:
    """A seeded sample of a source, assembled as a build would."""
    a = assemble([("preview", "train", df)], content, order)
    return a.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), KEY, F.col(OCC).cast("string")), 256)).limit(rows)

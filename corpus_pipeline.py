"""The corpus pipeline: five stages over the documents table, each a call of one operator.

run() writes each stage's result as Parquet in the shared folder and reads it again as the next
one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievework.llm import line_dedup, mixture, quality, simhash_wide
from sievework.llm.common import documents, small_batches
from sievework.llm.lattice import sample_segmentations
from sievework.plans.staging import materialise

#: Segmentations drawn of each document.
SAMPLES = 2


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; rows that share an id go by their best score."""
    small_batches(spark)
    scored = quality.score_quality(docs, quality.training_marks(spark, sf_dir))
    rejected = scored.groupBy("id").agg(F.max("score").alias("score")).where(F.col("score") < quality.THRESHOLD)
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["id"]), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    return simhash_wide.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines and pieces of lines go from the texts; n_chars follows."""
    small_batches(spark)
    cut = line_dedup.dedup_units(docs).withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: taken words over its size, rounded; 0 drops it.

    Documents without words have no part in a mixture of words and go. Rows alike in id and text are
    taken alike, by their mean.
    """
    small_batches(spark)
    taken = mixture.mix(docs).where("size > 0").groupBy("doc_id", "th").agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("copies")).where("copies > 0")
    t = taken.select(F.col("doc_id").alias("__sievework_id"), F.col("th").alias("__sievework_th"), F.col("copies").alias("__sievework_copies"))
    same = docs["doc_id"].eqNullSafe(t["__sievework_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == t["__sievework_th"])
    each = F.explode(F.sequence(F.lit(1), t["__sievework_copies"])).alias("__sievework_copy")
    return docs.join(t, same).select(*[docs[c] for c in docs.columns], each).drop("__sievework_copy")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document's text, with their ids."""
    small_batches(spark)
    import public_tokenizers

    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), SAMPLES, with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL expresses neither the fit nor the sampling; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)

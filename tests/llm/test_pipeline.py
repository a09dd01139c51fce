"""The pipeline's stages, each held against what it decides."""

from pyspark.sql import functions as F

import corpus_pipeline as p
from sievework.llm import line_dedup, mixture, quality, simhash_wide
from sievework.plans.staging import materialise
from tests.llm.test_operators import brute_dedup


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    a = materialise(p.quality_classifier(spark, docs, sf_dir))
    scores = {r["id"]: r["score"] for r in quality.score_quality(docs, quality.training_marks(spark, sf_dir)).collect()}
    assert {r["doc_id"] for r in a.collect()} == {i for i, s in scores.items() if s >= quality.THRESHOLD}
    b = materialise(p.near_dedup(spark, a, sf_dir))
    groups = {r["id"]: r["group"] for r in simhash_wide.near_groups(a).collect()}
    assert sorted(r["doc_id"] for r in b.collect()) == sorted(set(groups.values()))
    c = materialise(p.substring_dedup(spark, b, sf_dir))
    assert c.count() == b.count()
    before = {r["doc_id"]: r["text"] for r in b.collect()}
    gone = brute_dedup([*before.items()], line_dedup.MIN_WORDS)
    kept = {r["doc_id"]: r["text"] for r in c.collect()}
    assert all((kept[i] == t) == (i not in gone) for i, t in before.items()) and all(r["n_chars"] == len(r["text"]) for r in c.collect())
    d = materialise(p.mix_sources(spark, c, sf_dir))
    want = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixture.mix(c).where("size > 0").collect()}
    got = {r["doc_id"]: r["count"] for r in d.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
    e = p.encode_pieces(spark, d, sf_dir).toPandas()
    assert e.exact.all() and set(e.doc_id) == set(got)
    assert a.columns == b.columns == c.columns == d.columns == columns


def test_stages_take_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_take_odd_documents(spark, sf_dir):
    """Nulls, empty and long texts, repeated ids and rows, and columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    line = "a line of eight words or more that repeats itself"
    rows = [(1, f"first text\n{line}"), (1, f"another text of the same id\n{line}"), (2, None), (3, ""), (None, "a text without an id, but with words in it"), (4, long), (4, long), (5, long + " end"), (6, " \t\n"), (7, f"{line}\nlast")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a")).withColumn("n_chars", F.length("text").cast("long"))
    for c in ("id", "th", "copies", "t_id", "score", "group", "cid", "size", "key", "removed", "passage_words", "hi", "lo", "root", "taken"):
        d = d.withColumn(c, F.lit("x"))
    counts = {}
    for name, stage in p.STAGES:
        out = materialise(stage(spark, d, sf_dir))
        counts[name] = out.count()
        if name != p.STAGES[-1][0] and name != "substring dedup":
            assert out.columns == d.columns
            assert {r["text"] for r in out.select("text").collect()} <= {t for _, t in rows}
    near = materialise(p.near_dedup(spark, d, sf_dir))
    assert sorted(str(r["doc_id"]) for r in near.collect()) == ["1", "1", "2", "4", "7", "None"]
    cut = materialise(p.substring_dedup(spark, d.drop("removed", "passage_words"), sf_dir))
    assert cut.count() == len(rows) and sum(line in (r["text"] or "") for r in cut.collect()) == 2  # both of id 1 keep it
    mixed = materialise(p.mix_sources(spark, d, sf_dir))
    assert all((r["text"] or "").split() for r in mixed.collect())
    again = materialise(p.mix_sources(spark, d.repartition(3), sf_dir))
    key = lambda x: sorted((str(r["doc_id"]), r["text"]) for r in x.collect())
    assert key(mixed) == key(again)
    texts = p.encode_pieces(spark, d, sf_dir).collect()
    assert all(r["exact"] for r in texts) and {r["doc_id"] for r in texts} == {i for i, _ in rows}

"""Each query against the same question in SQL, and those without SQL for what must hold."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sievework.operators import reports
from sievework.plans import more_queries, queries as core  # noqa: F401
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_sql_gives_the_same_rows(spark, sf_dir, duck, name):
    assert same_rows(core.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(core.SQL[name]).df())


def test_entry_lists_the_core_queries():
    import __spark_entry__

    assert set(core.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_split_components_are_disjoint(spark, sf_dir):
    assert {r["column_name"]: r["shared"] for r in core.split_components(spark, sf_dir).collect()} == {"text": 0, "bucket": 0}


def test_directed_rows_are_held_out(spark, sf_dir):
    assert {r["split"] for r in core.split_directed(spark, sf_dir).where("directed").collect()} == {"test"}


def test_identifiers_validate_as_made(spark, sf_dir):
    r = core.synth_identifier(spark, sf_dir).toPandas()
    assert (r.valid == r.cv_valid).all() and 0.2 < r.valid.mean() < 0.8


def test_plan_counts_add_up(spark, sf_dir):
    r = core.carrier_plan(spark, sf_dir).toPandas()
    assert len(r) == 24 and abs(r[r.genre == "letter"].n.sum() / r.n.sum() - 0.75) < 0.02


def test_siblings(spark, sf_dir):
    r = {x["sibling_variant"]: x for x in core.insert_and_siblings(spark, sf_dir).collect()}
    assert r["original"]["with_element"] == r["original"]["n"] == r["empty"]["n"] == r["decoy"]["with_element"] and r["empty"]["with_element"] == 0


def test_minhash_finds_exact_copies(spark, sf_dir):
    dropped = core.dedup_minhash(spark, sf_dir).count()
    assert dropped >= core.dedup_exact(spark, sf_dir).count()


def test_recipe_accounts_for_rows(spark, sf_dir):
    r = core.recipe_run(spark, sf_dir).toPandas()
    assert set(r.operator) == {"length_band@1.0.0", "dedup_exact@1.0.0", "sample@1.0.0", "split@1.0.0"}


def agrees(spark, at, name, texts):
    """Whether a query and its SQL agree on documents of these texts."""
    n = len(texts)
    pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": texts, "lang": ["en"] * n, "source": [f"src{i % 7}" for i in range(n)], "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}), at / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([0], pa.int64()), "quality": pa.array([1], pa.int32()), "toxic": pa.array([0], pa.int32())}), at / "labels.parquet")
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet')")
    return same_rows(core.QUERIES[name](spark, str(at)).toPandas(), c.sql(core.SQL[name]).df())


def test_spellings_of_a_value_stay_together(spark, tmp_path):
    """texts that differ in case or white space alone, which the proof takes for one value, were split apart."""
    spelt = lambda i: [f"Word {i} alpha", f"word {i}  ALPHA", f" word {i}\talpha ", f"word {i} alpha\xa0", f"word\xa0{i} alpha", f"word {i} alpha\xa0\n", f"word {i} alpha\x85", f"wo\x0brd {i}", f"wo rd {i}", f"ΣΑΣ {i}", f"σας {i}", f"σασ {i}", f"İ{i}", f"i{i}", f"i\u0307{i}"]
    assert agrees(spark, tmp_path, "split_components", [t for i in range(60) for t in [*spelt(i), None]])


def test_a_column_of_many_values_is_listed(spark, tmp_path):
    """columns of over 10,000 values were left out."""
    assert agrees(spark, tmp_path, "group_columns", ["x" * (i % 10_001) for i in range(20_010)])
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert "n_chars" not in {r["column"] for r in reports.group_columns(d, ["lang", "n_chars"]).collect()}


def test_a_recipe_keeps_texts_of_any_length(spark, tmp_path):
    """texts of over 100,000 characters were dropped."""
    assert agrees(spark, tmp_path, "recipe_run", ["short", None, *[f"{i} " * 200 for i in range(40)], *["word " * n for n in (20_000, 20_001, 300_000)]])

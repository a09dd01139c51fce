import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def same_rows(a, b):
    """Whether two pandas frames hold the same rows, in any order."""
    import pandas as pd

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "is_integer") or type(v).__name__ == "Decimal" else str(v)

    if sorted(a.columns) != sorted(b.columns):
        return False
    key = lambda d: sorted(tuple(map(cell, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    return key(a) == key(b)

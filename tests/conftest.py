from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    local = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", str(local)).config("spark.checkpoint.dir", f"file://{local}/shared").config("spark.sql.warehouse.dir", f"{local}/warehouse")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(frame) -> list[tuple]:
    """Rows of a pandas frame as sorted tuples, columns by name, numbers rounded."""
    import pandas as pd

    def cell(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not isinstance(v, str):
            v = v.tolist() if hasattr(v, "tolist") else v
            return str(v) if isinstance(v, list) else cell(v)
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "None"
        return "%.6g" % v if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False))

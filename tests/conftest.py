from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("the test tables aren't here")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import glob

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _same(got, want):
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert len(got) == len(want)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        differs = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        assert not differs.any(), (c, a[differs].head(), b[differs].head())


@pytest.fixture(scope="session")
def same():
    return _same

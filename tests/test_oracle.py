"""Every query with SQL against DuckDB on the smallest tables, where they are there."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from semantide.plans import core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted([tuple(map(plain, r)) for r in frame[cols].astype(object).values.tolist()], key=repr)


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(core.REGISTRY.queries))
def test_query(spark, views, name):
    got = core.REGISTRY.queries[name](spark, DATA)
    if name not in core.REGISTRY.sql:
        assert got.columns
        got.write.format("noop").mode("overwrite").save()
        return
    assert rows(got.toPandas()) == rows(views.execute(core.REGISTRY.sql[name]).fetch_df())

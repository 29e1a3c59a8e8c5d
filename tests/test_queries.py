"""Every query with SQL is held against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"
WITH_SQL = sorted(catalog.oracle_sql())
WITHOUT = sorted(set(catalog.queries()) - set(WITH_SQL))


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "null" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(text(v.item() if hasattr(v, "item") else v) for v in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalog.queries()[name](spark, DATA).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) > 0
    for c in ours.columns:
        if ours[c].dtype.kind in "iub" and theirs[c].dtype.kind == "f":
            ours[c] = ours[c].astype(float)
        if theirs[c].dtype.kind in "iub" and ours[c].dtype.kind == "f":
            theirs[c] = theirs[c].astype(float)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", WITHOUT)
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns and found.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

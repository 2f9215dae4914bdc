"""Every query against its SQL over the smallest tables."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from shutterloom.plans import catalogue, corpus

DATA = Path(os.environ.get("SHUTTERLOOM_DATA", "/root/testdata/sf0.001"))
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def cells(df):
    show = lambda v: "null" if v is None or v is pd.NaT or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    df = df[sorted(df.columns)]
    return Counter(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def compare(spark, con, queries, sql, name):
    mine = queries[name](spark, str(DATA)).toPandas()
    if name in sql:
        theirs = con.execute(sql[name]).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert cells(mine) == cells(theirs)


@needs_data
@pytest.mark.parametrize("name", [*corpus.QUERIES, *catalogue.QUERIES])
def test_query(spark, con, name):
    compare(spark, con, corpus.QUERIES | catalogue.QUERIES, corpus.SQL | catalogue.SQL, name)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "score", "reason"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

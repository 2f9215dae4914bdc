import os
from pathlib import Path

import duckdb
import pytest

from shutterloom.llm import queries

DATA = Path(os.environ.get("SHUTTERLOOM_DATA", "/root/testdata/sf0.001"))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    mine = queries.QUERIES[name](spark, str(DATA)).toPandas()
    if name in queries.SQL:
        con = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        theirs = con.execute(queries.SQL[name]).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        show = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
        assert show(mine) == show(theirs[mine.columns])

"""The SQL of the training-data queries against the queries, on the smallest tables."""

import os

import pytest

from quern.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DIR}/{f}')")
    want = con.execute(queries.sql()[name]).fetch_df()
    got = queries.queries()[name](spark, DIR).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)

    def rows(df):
        return sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))

    assert rows(got) == rows(want)

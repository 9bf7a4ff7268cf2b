"""Every core query against its SQL over the smallest tables, and the plans that must hold at any size."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quern import catalog

SF = os.environ.get("QUERN_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(map(plain, r)) for r in want.fetchall()) == sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_queries_without_sql_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark, monkeypatch):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    p = plan(catalog.QUERIES["scan_language"](spark, SF))
    assert "ReadSchema: struct<seq:bigint,content:string,lang:string>" in p and "EqualTo(lang,Python)" in p


def test_no_query_pairs_everything_with_everything(spark):
    for name, q in catalog.QUERIES.items():
        p = plan(q(spark, SF))
        assert "CartesianProduct" not in p and (name == "stage_of_chunk" or "NestedLoop" not in p), name  # a range join with three rows

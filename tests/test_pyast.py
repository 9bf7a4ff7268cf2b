import pytest
from pyspark.sql import functions as F

from quern.functions.pyast import features, python_features
from quern.operators import curriculum


@pytest.mark.parametrize(
    "source,want",
    [
        ("", (True, False, 1.0, 0, 0)),
        ("x = (", (False, False, 1.0, 0, 0)),
        ("if a:\n  b\nelif c:\n  d\nelif e:\n  f\nelse:\n  g\n", (True, False, 2.5, 3, 7)),
        ("def f():\n  'd'\n  for x in y:\n    with z: pass\ndef g():\n  assert x\n", (True, True, 2.5, 3, 3)),
        ("match a:\n  case 1:\n    pass\nasync def f():\n  async for x in y:\n    pass\n", (True, False, 1.0, 1, 3)),
        ("[i for i in a if i for j in b]\n", (True, False, 2.0, 0, 4)),
        ("try:\n  a\nexcept E:\n  b\n", (True, False, 1.5, 1, 3)),
        ("class A:\n  def m(self):\n    if self.x:\n      while y: z = 1\n", (True, False, 3.0, 4, 3)),
    ],
)
def test_features(source, want):
    assert features(source)[:5] == want


def test_udf_on_hard_rows(spark):
    rows = [(1, None), (2, "x\x00"), (3, "(" * 5000), (4, "a = 1\n" * 30000), (5, "-" * 20000 + "1")]
    got = {r["i"]: r["f"] for r in spark.createDataFrame(rows, "i int, t string").select("i", python_features(F.col("t")).alias("f")).collect()}
    assert got[1]["ok"] is None and not got[2]["ok"] and not got[3]["ok"] and got[4]["ok"] and got[5]["ok"] is not None


def test_stages_order_and_boundaries(spark):
    trivial, tangled = "x = 1\n", "def f():\n" + "  if a: b\n" * 20
    df = spark.createDataFrame([(1, trivial, "stack", 10), (2, tangled, "stack", 20), (3, trivial, "curated", 5), (4, trivial, "stackoverflow", 7), (5, trivial, None, 1)], "seq int, content string, tag string, n_tokens long")
    staged = curriculum.scored(df).withColumn("stage", curriculum.stage(F.col("composite"), F.col("tag"))).cache()
    assert {r["seq"]: r["stage"] for r in staged.collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 1}
    order = [(r["stage"], r["pass"], r["seq"]) for r in curriculum.ordered(staged).orderBy("stage", "pass", "seq").collect()]
    assert order == [(1, 0, 1), (1, 0, 4), (1, 0, 5), (2, 0, 2), (3, 0, 3), (3, 1, 3), (3, 2, 3)]
    assert [(r["stage"], r["tokens"], r["end_token"]) for r in curriculum.boundaries(staged).orderBy("stage").collect()] == [(1, 18, 18), (2, 20, 38), (3, 15, 53)]
    assert [r["tokens"] for r in curriculum.boundaries(staged.filter("stage = 2")).orderBy("stage").collect()] == [0, 20, 0]
    exact = spark.createDataFrame([(5.0, "x"), (5.0000001, "x")], "s double, t string").select(curriculum.stage(F.col("s"), F.col("t"))).collect()
    assert [r[0] for r in exact] == [1, 2]

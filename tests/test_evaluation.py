import math

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation, qa, training, vectors


@pytest.mark.parametrize("n,c,k,p", [(20, 0, 1, 0.0), (20, 3, 1, 0.15), (20, 3, 10, 0.894737), (5, 3, 3, 1.0), (1, 1, 1, 1.0), (4, 4, 2, 1.0), (10, 1, 10, 1.0)])
def test_pass_at_k(spark, n, c, k, p):
    got = spark.createDataFrame([(n, c, k)], "n long, c long, k int").select(evaluation.pass_at_k(F.col("n"), F.col("c"), F.col("k"))).first()[0]
    assert got == pytest.approx(p, abs=1e-6)


def test_counts_means_and_accuracy(spark):
    samples = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("b", 0), ("c", 0)], "task_id string, sample_idx int")
    outcomes = spark.createDataFrame([("a", 0, True), ("a", 0, True), ("a", 1, None), ("b", 0, False), ("z", 0, True)], "task_id string, sample_idx int, passed boolean")
    counts = evaluation.outcome_counts(samples, outcomes)
    assert sorted(map(tuple, counts.collect())) == [("a", 3, 1), ("b", 1, 0), ("c", 1, 0)]
    means = {r["k"]: (r["tasks"], round(r["p"], 6)) for r in evaluation.mean_pass_rates(counts, [1, 2, 100]).collect()}
    assert means == {1: (3, 0.111111), 2: (1, 0.666667), 100: (0, 0.0)}
    solved = spark.createDataFrame([("x", True), ("x", False), ("y", False)], "lib string, solved boolean")
    assert {r["lib"]: (r["correct"], r["total"]) for r in evaluation.accuracy(solved, "lib").collect()} == {"x": (1, 2), "y": (0, 1), "overall": (1, 3)}


def test_perplexity(spark):
    df = spark.createDataFrame([(10.0, 5), (0.0, 0), (4.0, 4)], "nll double, tokens long").withColumn("perplexity", evaluation.perplexity(F.col("nll"), F.col("tokens")))
    got = evaluation.corpus_perplexity(df).first()
    assert got["files"] == 2 and got["perplexity"] == pytest.approx(math.exp(14 / 9))


def test_questions_and_answers(spark):
    rows = [(1, 20, 2, None, None, None, "early answer"), (2, 1, 1, 5, 20, ["PyThOn-3.x"], "first"), (3, 2, 1, 5, 20, ["python"], "last"), (4, 3, 1, 4, 21, ["python"], "low"), (5, 21, 2, None, None, None, "x"), (6, 4, 1, None, 22, ["python"], "null score"), (7, 22, 2, 1, None, None, "x"), (8, 5, 1, 9, 23, ["java", None], "tag"), (9, 23, 2, 1, None, None, "x"), (10, 20, 2, 1, None, None, "again"), (11, 20, 2, 1, None, None, ""), (12, 6, 1, 9, 24, ["python"], ""), (13, 24, 2, 0, None, None, "x")]
    posts = spark.createDataFrame(rows, "seq long, Id long, PostTypeId int, Score int, AcceptedAnswerId long, Tags array<string>, Body string")
    got = {r["seq"]: r["text"] for r in qa.documents(qa.accepted_pairs(posts)).collect()}
    assert got == {1: "Question:\nlast\n\nAnswer:\nearly answer", 10: "Question:\nlast\n\nAnswer:\nagain"}
    assert qa.accepted_pairs(posts.limit(0)).count() == 0


def test_vectors(spark):
    v = [0.5, -1.0, 2.0, 2.0]
    df = spark.createDataFrame([(v,)], "v array<double>")
    e = [math.exp(x / 0.5 - 4.0) for x in v]
    p, a, x, n, r = df.select(vectors.softmax(F.col("v"), 0.5), vectors.argmax(F.col("v")), vectors.cross_entropy(F.col("v"), F.lit(2)), vectors.rms_norm(F.col("v")), vectors.rope(F.col("v"), F.lit(0.0))).first()
    assert p == pytest.approx([z / sum(e) for z in e]) and a == 2 and x == pytest.approx(math.log(sum(math.exp(z) for z in v)) - 2.0)
    assert sum(z * z for z in n) / 4 == pytest.approx(1, abs=1e-5) and r == pytest.approx(v)
    turned = df.select(vectors.rope(F.col("v"), F.lit(3.0))).first()[0]
    assert sum(z * z for z in turned) == pytest.approx(sum(z * z for z in v))


def test_schedule(spark):
    steps = [-1, 0, 5, 10, 55, 100, 500]
    df = spark.createDataFrame([(s,) for s in steps], "s long").select(training.lr_scale(F.col("s"), 10, 100, 0.1).alias("x"))
    assert [r["x"] for r in df.collect()] == pytest.approx([0, 0, 0.5, 1.0, 0.55, 0.1, 0.1])


def test_locked_metrics(spark):
    rows = [("t", 2, {"a": 1.0, "c": 9.0}), ("t", 1, {"a": 2.0, "b": 3.0}), ("e", 1, {"v": 0.5})]
    df = spark.createDataFrame(rows, "tag string, step long, m map<string,double>")
    got = {(r["tag"], r["step"]): (r["columns"], r["values"]) for r in training.locked(df, "tag", ["step"], "m").collect()}
    assert got == {("t", 1): (["a", "b"], ["2.0", "3.0"]), ("t", 2): (["a", "b"], ["1.0", ""]), ("e", 1): (["v"], ["0.5"])}
    shown = spark.createDataFrame([(0.0,), (0.0005,), (12345.6,), (1.5,), (None,)], "v double").select(training.metric_text(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in shown] == ["0.0000", "5.00e-04", "1.23e+04", "1.5000", None]

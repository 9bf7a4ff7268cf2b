"""Scores of code samples: outcomes by problem, pass@k, accuracy with an overall row, and perplexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix import dense_rank_all


def outcome_counts(samples: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(task_id, n, c): samples of each task and how many passed. Every delivered sample row counts; an outcome that is
    missing or null is a failure, and one that comes twice is one."""
    passed = outcomes.groupBy("task_id", "sample_idx").agg(F.max(F.coalesce("passed", F.lit(False))).alias("passed"))
    joined = samples.select("task_id", "sample_idx").join(passed, ["task_id", "sample_idx"], "left")
    return joined.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("passed").cast("int")), F.lit(0)).alias("c"))


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """1 where fewer than k samples failed, else 1 - prod over i < k of (n - c - i) / (n - i)."""
    miss = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long") - 1), F.lit(1.0), lambda a, i: a * (n - c - i).cast("double") / (n - i).cast("double"))
    return F.when(n - c < k, F.lit(1.0)).otherwise(F.lit(1.0) - miss)


def pass_rates(counts: DataFrame, ks: list[int]) -> DataFrame:
    """(task_id, n, c, k, p) for every k that a task has samples for."""
    k = F.explode(F.array(*[F.lit(x) for x in ks]))
    return counts.withColumn("k", k).filter("k <= n").withColumn("p", pass_at_k(F.col("n"), F.col("c"), F.col("k")))


def mean_pass_rates(counts: DataFrame, ks: list[int]) -> DataFrame:
    """(k, tasks, p): means over the eligible tasks, 0.0 where none is."""
    spark = counts.sparkSession
    got = pass_rates(counts, ks).groupBy("k").agg(F.count(F.lit(1)).alias("tasks"), F.avg("p").alias("p"))
    every = spark.createDataFrame([(x,) for x in ks], "k int")
    return every.join(F.broadcast(got), "k", "left").fillna(0, ["tasks"]).fillna(0.0, ["p"])


def accuracy(solved: DataFrame, group: str) -> DataFrame:
    """(lib, correct, total, accuracy) by group and overall: a problem is right if any of its samples passed."""
    by = solved.rollup(group).agg(F.sum(F.col("solved").cast("int")).alias("correct"), F.count(F.lit(1)).alias("total"), F.grouping(group).alias("_all"))
    return by.select(F.when(F.col("_all") == 1, "overall").otherwise(F.col(group)).alias("lib"), "correct", "total", (F.col("correct") / F.greatest("total", F.lit(1))).alias("accuracy"))


def perplexity(nll: Column, tokens: Column) -> Column:
    """exp(nll / tokens); NaN under one scored token."""
    return F.when(tokens > 0, F.exp(nll / F.greatest(tokens, F.lit(1)))).otherwise(F.lit(float("nan")))


def corpus_perplexity(files: DataFrame, ppl: str = "perplexity", tokens: str = "tokens") -> DataFrame:
    """One row: token-weighted geometric mean over the files that have tokens and a number."""
    ok = files.filter(~F.isnan(ppl) & (F.col(tokens) > 0))
    return ok.agg(F.count(F.lit(1)).alias("files"), F.sum(tokens).alias("tokens"), F.exp(F.sum(F.log(ppl) * F.col(tokens)) / F.sum(tokens)).alias("perplexity"))


def eval_losses(batches: DataFrame, order: list[str], loss: str, per: int = 20) -> DataFrame:
    """(evaluation, batches, loss): means over consecutive runs of batches in the order; a row's place is found by
    two-phase ranks, so the order is global without a single-task window."""
    placed = dense_rank_all(batches.select(*order, loss), order, "_place")
    return placed.groupBy(F.floor(F.col("_place") / per).alias("evaluation")).agg(F.count(F.lit(1)).alias("batches"), F.avg(loss).alias("loss"))


def windows(df: DataFrame, tokens: str, context: int, stride: int) -> DataFrame:
    """df exploded to (begin, end, n_new): windows of a sliding evaluation. The first scores all its targets, a later one
    the last min(stride, its targets); the last window may score some again. Fewer than two tokens give none."""
    n = F.col(tokens)
    begins = F.when(n >= 2, F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), n - 2).cast("long"), F.lit(stride).cast("long"))).otherwise(F.array().cast("array<long>"))
    out = df.withColumn("begin", F.explode(begins)).filter((F.col("begin") == 0) | (F.col("begin") - stride + context < n))
    out = out.withColumn("end", F.least(F.col("begin") + context, n).cast("long"))
    targets = F.col("end") - F.col("begin") - 1
    return out.withColumn("n_new", F.when(F.col("begin") == 0, targets).otherwise(F.least(F.lit(stride), targets)).cast("long"))

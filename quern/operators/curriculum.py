"""Curriculum: complexity, stages, their order with repeated passes, and where they end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.pyast import composite, python_features

#: The greatest score of stage 1, the passes over stage 3, the tags that go there.
STAGE1_MAX, STAGE3_PASSES, STAGE3_TAGS = 5.0, 3, ("curated", "stdlib", "docs")


def stage(score: Column, tag: Column) -> Column:
    return F.when(F.coalesce(tag.isin(*STAGE3_TAGS), F.lit(False)), 3).when(score <= F.lit(STAGE1_MAX), 1).otherwise(2)


def scored(df: DataFrame, text: str = "content") -> DataFrame:
    """df with cyclomatic, max_nesting, unique_identifiers and composite of one parse a row."""
    out = df.withColumn("_f", python_features(F.col(text)))
    out = out.select(*df.columns, "_f.cyclomatic", "_f.max_nesting", "_f.unique_identifiers")
    return out.withColumn("composite", composite(F.col("cyclomatic"), F.col("max_nesting"), F.col("unique_identifiers")))


def ordered(staged: DataFrame, passes: int = STAGE3_PASSES) -> DataFrame:
    """Every row once, those of stage 3 as whole passes one after another; sort by (stage, pass, seq)."""
    return staged.withColumn("pass", F.explode(F.when(F.col("stage") == 3, F.sequence(F.lit(0), F.lit(passes - 1))).otherwise(F.array(F.lit(0)))))


def counts(staged: DataFrame) -> DataFrame:
    by = staged.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return by.select("stage", "n", (F.col("n") * F.lit(100.0) / F.greatest(F.sum("n").over(W.partitionBy(F.lit(1))), F.lit(1))).alias("pct"))  # three rows


def boundaries(staged: DataFrame, tokens: str = "n_tokens", passes: int = STAGE3_PASSES) -> DataFrame:
    """(stage, tokens, end_token): running ends of the three stages, stage 3 counted with its passes; absent stages are 0."""
    spark = staged.sparkSession
    by = staged.groupBy("stage").agg((F.sum(tokens) * F.when(F.first("stage") == 3, passes).otherwise(1)).alias("tokens"))
    every = spark.range(1, 4).select(F.col("id").cast("int").alias("stage"))
    by = every.join(F.broadcast(by), "stage", "left").fillna(0, ["tokens"])
    return by.withColumn("end_token", F.sum("tokens").over(W.orderBy("stage").rowsBetween(W.unboundedPreceding, 0)))  # three rows

"""Relational sides of a training run: schedule, budgets, checkpoints, metrics, parameter groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lr_scale(step: Column, warmup: int, total: int, floor: float) -> Column:
    """Linear warm-up, then half a cosine down to the floor; 0 before the first step."""
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / F.lit(float(max(1, total - warmup)))))
    cosine = F.lit(floor) + F.lit(1 - floor) * F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * x))
    return F.when(step < 0, F.lit(0.0)).when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(cosine)


def latest(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.agg(F.max_by("name", "step").alias("name"), F.max("step").alias("step")).filter("step is not null")


def retention(checkpoints: DataFrame, keep: int) -> DataFrame:
    """Checkpoints with whether they stay: the last max(1, keep) by step. A directory listing is a small table."""
    return checkpoints.withColumn("kept", F.row_number().over(W.orderBy(F.desc("step"), "name")) <= max(1, keep))


@F.pandas_udf(T.StringType())
def metric_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """%.2e for small and large values, %.4f for others; ties go by the binary value, which Java's formatter rounds up."""
    for s in batches:
        yield s.map(lambda v: None if v is None or v != v else f"{v:.2e}" if 0 < abs(v) < 1e-3 or abs(v) > 1e4 else f"{v:.4f}")


def locked(rows: DataFrame, tag: str, order: list[str], metrics: str) -> DataFrame:
    """(tag, order.., values): each tag's columns are those of its first row; later rows lose others and get '' for missing."""
    first = rows.groupBy(tag).agg(F.min_by(F.array_sort(F.map_keys(metrics)), F.struct(*order)).alias("columns"))
    return rows.join(F.broadcast(first), tag).select(tag, *order, "columns", F.transform("columns", lambda c: F.coalesce(F.col(metrics)[c].cast("string"), F.lit(""))).alias("values"))


def parameter_groups(params: DataFrame) -> DataFrame:
    """(optimizer, tensors, elements) of (name, ndim, numel): matrices but the token embedding go to the matrix optimizer."""
    to = F.when((F.col("ndim") >= 2) & ~F.col("name").endswith("token_emb.weight"), "matrix").otherwise("adaptive")
    return params.groupBy(to.alias("optimizer")).agg(F.count(F.lit(1)).alias("tensors"), F.sum("numel").alias("elements"))

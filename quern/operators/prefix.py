"""Ranks and running sums over a whole table without a single-task window: totals of ranges first, then inside each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.plans.durable import cut


def running_sum(df: DataFrame, order: list[str], value: Column | str, out: str, partitions: int | None = None) -> DataFrame:
    """df with the sum of the value over all rows before this one in the order (0 for the first).

    The order must be total for a repeatable result; nulls come first."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_v", value if isinstance(value, Column) else F.col(value)).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged, "running-sum")  # range bounds are sampled anew by every plan, so the ranges are written once
    totals = ranged.groupBy("_part").agg(F.sum("_v").alias("_t"))
    bases = totals.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_t").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row a range
    inner = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = ranged.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    return inside.join(F.broadcast(bases), F.col("_part") == F.col("_p")).withColumn(out, (F.col("_base") + F.col("_in")).cast("long")).drop("_v", "_part", "_p", "_base", "_in")


def dense_rank_all(df: DataFrame, order: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """df with the 0-based place of each row in the order."""
    return running_sum(df, order, F.lit(1), out, partitions)

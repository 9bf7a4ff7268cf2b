"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.durable import cut, shared_dir  # noqa: F401
from quern.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table, pruned to the columns; a table of fewer files than half of the cores is dealt over them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*columns) if columns else df)


def salted_rank(df: DataFrame, keys: list[str], order: list[str], out: str, salts: int | None = None) -> DataFrame:
    """A dense 0-based rank within the keys, without ever putting a whole key into one task.

    Rows of a key are dealt over salts by the hash of the order columns; counts per salt (at most salts rows a key) give
    offsets, and row_number runs inside each salt. The order columns must identify a row for a repeatable result."""
    from pyspark.sql import Window as W

    salts = salts or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = df.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order)))
    on = [ranked[k].eqNullSafe(counts[f"_k{i}"]) for i, k in enumerate(keys)] + [ranked["_salt"] == counts["_s"]]
    return ranked.join(counts, on).withColumn(out, F.col("_base") + F.col("_r") - 1).drop("_salt", "_s", "_base", "_r", *[f"_k{i}" for i in range(len(keys))])

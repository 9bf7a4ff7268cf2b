"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators import dedup, quality
from quern.plans.durable import children


def clean_to_jsonl(stream: DataFrame, text: str, tag: str, out: str, checkpoint: str) -> StreamingQuery:
    """Rows that pass the quality cascade as JSON lines (source, tag); a restart goes on where the checkpoint ends."""
    rows = quality.cascade(stream, text, tag).filter("reason = 'passed'").select(F.col(text).alias("source"), F.col(tag).alias("tag"))
    return rows.writeStream.format("json").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start()


def dedup_stream(stream: DataFrame, id_col: str, text_col: str, state: str, out: str, checkpoint: str) -> StreamingQuery:
    """Near-duplicate removal over micro-batches with the keep-first result of one pass over all of them.

    The index of the kept rows' bands is a table on any file system of the cluster that every batch joins and extends, so state is bounded by storage, not
    by memory. Each batch writes its own folder, named by the batch, so a batch that is run again replaces its rows. Ids
    must grow with the batches, as the order of the stream is the order of the ids."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        banded = dedup.bands(dedup.signatures(batch, id_col, text_col)).persist()
        old = [x for x in children(spark, state) if x.startswith("batch=") and int(x[6:]) < number]
        hit = spark.createDataFrame([], "id long")
        if old:
            known = spark.read.parquet(*[f"{state}/{x}" for x in old])
            hit = banded.join(known.select("band", "hash"), ["band", "hash"], "left_semi").select("id").distinct()
        fresh = banded.join(hit, "id", "left_anti")
        if fresh.limit(1).count():
            kept = dedup.keep_first(fresh)
            verdict = kept.unionByName(hit.select("id", F.lit(False).alias("kept")))
            fresh.join(kept.filter("kept").select("id"), "id", "left_semi").select("band", "hash").write.mode("overwrite").parquet(f"{state}/batch={number}")
        else:
            verdict = hit.select("id", F.lit(False).alias("kept"))
        verdict.write.mode("overwrite").parquet(f"{out}/batch={number}")
        banded.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours", *keys: str) -> DataFrame:
    """Counts and sums by event-time window and key; rows later than the watermark are dropped (an extension: the source
    has no event time)."""
    by = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "2 hours", key: str = "user_id") -> DataFrame:
    """Sessions of a key that end with a gap (an extension as well)."""
    by = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key)
    return by.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read_parquet_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)

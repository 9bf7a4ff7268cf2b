"""Positions in a packed token stream, chunks, splits, and the rows that training reads from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.prefix import running_sum

CHUNK, VAL_SHARE, SEED = 2048, 0.05, 42


def offsets(df: DataFrame, order: list[str], tokens: str = "n_tokens") -> DataFrame:
    """df with start_pos, the position of its first token."""
    return running_sum(df, order, tokens, "start_pos")


def chunk_span(placed: DataFrame, total: int, size: int = CHUNK, tokens: str = "n_tokens") -> DataFrame:
    """(.., first_chunk, last_chunk) of the rows that reach into a full chunk; the remainder of the stream is dropped."""
    full = total // size
    out = placed.filter(F.col(tokens) > 0).withColumn("first_chunk", F.floor(F.col("start_pos") / size))
    out = out.withColumn("last_chunk", F.least(F.floor((F.col("start_pos") + F.col(tokens) - 1) / size), F.lit(full - 1)))
    return out.filter(F.col("first_chunk") < full)


def chunk_split(spark: SparkSession, chunks: int, share: float = VAL_SHARE, seed: int = SEED) -> DataFrame:
    """(chunk_id, split): max(1, share of the chunks) go to val, the first by the hash of id and seed; the rest to train.

    The sample is of exact size, not a Bernoulli draw: a histogram over the first 16 bits of the hash (at most 65,536 rows
    pass the driver) gives the bucket in which the n-th smallest lies; only that bucket, a 65,536th of the chunks, is
    ranked. No chunk gives no rows."""
    key = F.md5(F.concat(F.col("chunk_id").cast("string"), F.lit(f"-{seed}")))
    ids = spark.range(chunks).select(F.col("id").alias("chunk_id")).withColumn("key", key).withColumn("bucket", F.conv(F.substring("key", 1, 4), 16, 10).cast("int"))
    left, edge = max(1, int(chunks * share)), -1
    for bucket, n in sorted((r["bucket"], r["n"]) for r in ids.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()):
        edge = bucket
        if n >= left:
            break
        left -= n
    clear = ids.filter(F.col("bucket") != edge).select("chunk_id", F.when(F.col("bucket") < edge, "val").otherwise("train").alias("split"))
    rank = F.row_number().over(W.partitionBy("bucket").orderBy("key", "chunk_id"))
    return clear.unionByName(ids.filter(F.col("bucket") == edge).select("chunk_id", F.when(rank <= left, "val").otherwise("train").alias("split")))


def batch_rows(spark: SparkSession, tokens: int, context: int, rows: int, batch: int, start: int = 0) -> DataFrame:
    """(row, batch, epoch, start): where each training row begins; context + 1 tokens are read, context apart, and the
    stream begins again where they no longer fit. start is the cursor's position within the stream."""
    if tokens < context + 1:
        raise ValueError("the stream is shorter than one row")
    if not 0 <= start < tokens:
        raise ValueError("the position lies outside the stream")
    left = max(0, (tokens - 1 - start) // context)  # rows before the first wrap
    per = (tokens - 1) // context
    g = F.col("id")
    after = g - F.lit(left)
    return spark.range(rows).select(
        g.alias("row"),
        F.floor(g / batch).alias("batch"),
        F.when(g < left, F.lit(0)).otherwise(F.floor(after / per) + 1).cast("long").alias("epoch"),
        F.when(g < left, F.lit(start) + g * context).otherwise((after % per) * context).cast("long").alias("start"),
    )


def sequences(tokens: DataFrame, context: int) -> DataFrame:
    """(start, x, y) of the non-overlapping rows of (pos, token): y is x moved by one; a bounded group a row."""
    total = tokens.agg((F.max("pos") + 1).alias("n")).first()["n"] or 0
    last = (total - 1) // context
    # the token at a border closes one row and opens the next
    row = F.floor(F.col("pos") / context)
    doubled = tokens.select("pos", "token", F.explode(F.when((F.col("pos") % context == 0) & (F.col("pos") > 0), F.array(row - 1, row)).otherwise(F.array(row))).alias("r")).filter(F.col("r") < last)
    got = doubled.groupBy("r").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("w"))
    return got.select((F.col("r") * context).alias("start"), F.slice("w", 1, context).alias("x"), F.slice("w", 2, context).alias("y"))

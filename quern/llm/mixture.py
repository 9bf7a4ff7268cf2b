"""Problem 5: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The rows of a source get a random order by hash. A source that must be repeated gives its whole order as many times as
its quota holds it, then the longest prefix that the rest of the quota holds; so no row is repeated more often than
another by more than one, and never more than the cap. What is chosen of a source is a sequence of blocks of ``block``
consecutive rows of that order. A binary tree over the output shards splits the block counts of all sources at once: a
node draws, without replacement, which blocks go left (a multivariate hypergeometric draw), so every shard gets an exact
quota of each source and the quotas add up exactly. Shards then take disjoint runs of each source's permuted blocks and
shuffle their rows locally. Shards hold about ``shard_chars`` characters, so a shard's sort is bounded at any scale.

Only counts and sums (a few rows) and the tree's quotas (a row a shard and source) pass the driver; rows are ranked by
salted two-phase windows and met with their shards by an equi-join on the block.

Defined results: null, empty and blank contents take no part; a source that its cap holds below its quota is used up and
stays below; a source without rows or target is reported with zeros; equal rows are different rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import cut
from quern.operators.qa import ANSWER, QUESTION, accepted_pairs

SEED = 20240607
BLOCK = 64
SHARD_CHARS = 32_000_000


def sources(stack: DataFrame, posts: DataFrame, files: DataFrame, repos: DataFrame) -> DataFrame:
    """(source, row_id, size): sizes in characters; bodies and contents are measured where they are scanned."""
    solid = F.col("content").rlike(r"(?U)\S")
    known = F.broadcast(repos.select(F.col("repo").alias("max_stars_repo_name")).distinct())  # a handful of curated repositories
    rest = stack.filter(solid).select("seq", "max_stars_repo_name", F.length("content").alias("size")).join(known, "max_stars_repo_name", "left_anti")
    out = rest.select(F.lit("stack").alias("source"), F.col("seq").alias("row_id"), "size")
    pairs = accepted_pairs(posts, F.length("Body"))
    out = out.unionByName(pairs.select(F.lit("stackoverflow").alias("source"), F.col("seq").alias("row_id"), (F.col("question") + F.col("answer") + len(QUESTION) + len(ANSWER)).alias("size")))
    tags = F.broadcast(repos.select("repo", "tag").distinct())
    own = files.filter(solid).select("file_seq", "repo", F.length("content").alias("size")).join(tags, "repo")
    return out.unionByName(own.select(F.col("tag").alias("source"), F.col("file_seq").alias("row_id"), "size"))


def quotas(sizes: DataFrame, targets: DataFrame, anchor: str = "stack") -> DataFrame:
    """(source, target_share, max_repeats, available_rows, available_chars, quota_chars, capped): what each should give."""
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("available_rows"), F.sum("size").alias("available_chars"))
    t = targets.join(have, "source", "left").fillna(0, ["available_rows", "available_chars"])
    one = W.partitionBy(F.lit(1))  # a row a source
    t = t.withColumn("total", F.coalesce(F.max(F.when((F.col("source") == anchor) & (F.col("target_share") > 0), F.col("available_chars") / F.nullif("target_share", F.lit(0.0)))).over(one), F.lit(0.0)))
    quota = F.round(F.col("target_share") * F.col("total")).cast("long")
    return t.select("source", "target_share", "max_repeats", "available_rows", "available_chars", quota.alias("quota_chars"), (quota > F.col("available_chars") * F.col("max_repeats")).alias("capped"))


def split(counts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Exact quotas (shards, sources): counts split over shards with the given capacities by the tree."""
    out = np.zeros((len(sizes), len(counts)), np.int64)
    stack = [(0, len(sizes), counts.astype(np.int64), 1)]
    while stack:
        lo, hi, have, node = stack.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, node])
        n = int(sizes[lo:mid].sum())
        left = rng.multivariate_hypergeometric(have, n, method="marginals") if have.sum() else have
        stack += [(lo, mid, left, 2 * node), (mid, hi, have - left, 2 * node + 1)]
    return out


def ordered(sizes: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, row_id, size, rank, before): place in the source's random order and characters before it, by two phases."""
    salts = max(8, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the salt is the high part of the same hash that orders, so the order over all salts is one order by hash
    h = F.xxhash64(F.lit(seed), "source", "row_id")
    rows = sizes.withColumn("_h", h).withColumn("_salt", F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * salts))
    per = rows.groupBy("source", "_salt").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_c"))
    w = W.partitionBy("source").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)  # at most salts rows a source
    per = per.select(F.col("source").alias("_src"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_c0"))
    inner = W.partitionBy("source", "_salt").orderBy("_h", "row_id")
    rows = rows.withColumn("_r", F.row_number().over(inner)).withColumn("_c", F.sum("size").over(inner.rowsBetween(W.unboundedPreceding, -1)))
    out = rows.join(per, (F.col("source") == F.col("_src")) & (F.col("_salt") == F.col("_s")))
    return out.select("source", "row_id", "size", (F.col("_n0") + F.col("_r") - 1).alias("rank"), (F.col("_c0") + F.coalesce("_c", F.lit(0))).alias("before"))


def mix(sizes: DataFrame, targets: DataFrame, seed: int = SEED, block: int = BLOCK, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(source, row_id, repeat, size, shard, pos): every chosen row and repeat with its place in the output."""
    spark = sizes.sparkSession
    sizes = cut(sizes, "mixture-sizes")
    rows = cut(ordered(sizes, seed), "mixture-order")
    plan = quotas(sizes, targets).withColumn("passes", F.when(F.col("available_chars") > 0, F.least(F.col("max_repeats").cast("long"), F.floor(F.col("quota_chars") / F.col("available_chars")))).otherwise(F.lit(0)))
    plan = plan.withColumn("rest", F.when(F.col("passes") < F.col("max_repeats"), F.col("quota_chars") - F.col("passes") * F.col("available_chars")).otherwise(F.lit(0)))
    plan = plan.select(F.col("source").alias("_p"), "passes", "rest", "available_rows").collect()  # a row a source
    small = F.broadcast(spark.createDataFrame([tuple(r) for r in plan], "_p string, passes long, rest long, available_rows long"))
    copies = F.col("passes") + F.when(F.col("before") + F.col("size") <= F.col("rest"), 1).otherwise(0)
    chosen = rows.join(small, F.col("source") == F.col("_p")).withColumn("copies", copies).filter("copies > 0")
    chosen = chosen.select("source", "row_id", "size", "rank", "available_rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("repeat"))
    chosen = cut(chosen.withColumn("block", F.floor(((F.col("repeat") - 1) * F.col("available_rows") + F.col("rank")) / block)), "mixture-chosen")
    totals = {r["source"]: (r["blocks"], r["chars"]) for r in chosen.groupBy("source").agg((F.max("block") + 1).alias("blocks"), F.sum("size").alias("chars")).collect()}
    names = sorted(totals)
    counts = np.array([totals[s][0] for s in names], np.int64)
    shards = max(1, -(-sum(totals[s][1] for s in names) // shard_chars))
    capacity = np.full(shards, counts.sum() // shards) + (np.arange(shards) < counts.sum() % shards) if len(names) else np.zeros(shards, np.int64)
    share = split(counts, capacity, seed) if len(names) else np.zeros((shards, 0), np.int64)
    ends = np.cumsum(share, axis=0)
    runs = [(s, int(k), int(e - q), int(e)) for j, s in enumerate(names) for k, (q, e) in enumerate(zip(share[:, j], ends[:, j])) if q]
    runs = pd.DataFrame(runs, columns=["source", "shard", "lo", "hi"])
    table = spark.createDataFrame(runs, "source string, shard long, lo long, hi long") if len(runs) else spark.createDataFrame([], "source string, shard long, lo long, hi long")
    # A source's blocks are already in random order, so a run of them is a draw of permuted blocks.
    table = table.select(F.col("source").alias("_b"), "shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("_block"))
    out = chosen.join(table, (F.col("source") == F.col("_b")) & (F.col("block") == F.col("_block")))
    local = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "source", "row_id", "repeat"), "source", "row_id", "repeat")
    return out.select("source", "row_id", F.col("repeat").cast("int").alias("repeat"), "size", F.col("shard").cast("int").alias("shard"), (F.row_number().over(local) - 1).alias("pos"))


def shares(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a source: target, quota, what was chosen and its actual share of the whole."""
    got = mixed.groupBy("source").agg(F.sum("size").alias("chosen_chars"), F.count(F.lit(1)).alias("chosen_rows"), F.max("repeat").alias("most_repeats"))
    out = quotas(sizes, targets).join(got, "source", "left").fillna(0, ["chosen_chars", "chosen_rows", "most_repeats"])
    out = out.withColumn("all_chars", F.sum("chosen_chars").over(W.partitionBy(F.lit(1))))  # a row a source
    return out.select("source", "target_share", "max_repeats", "available_rows", "available_chars", "quota_chars", "capped", "chosen_rows", "chosen_chars", "most_repeats", F.when(F.col("all_chars") > 0, F.col("chosen_chars") / F.col("all_chars")).otherwise(F.lit(0.0)).alias("actual_share"))

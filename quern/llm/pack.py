"""Problem 8: filling containers of fixed capacity by a configuration linear program over the length histogram.

A configuration is a multiset of length classes that fits into one container. The program "fewest containers such that
every class is covered" is solved by multiplicative weights: a class starts with its size as weight (the dual solution of
the volume bound), its weight falls as it gets covered, and an unbounded-knapsack dynamic program prices the
configurations. One table of the program prices the best configuration of every class, so a round takes a step along all
that are nearly best and share no class. Rounds end where the dual bound, the total weight over the best price, shows that
the covering is within ``GAP``, or after ``ROUNDS``. The fractional solution is rounded down; what remains is packed
best-fit decreasing. The driver sees the histogram
only, which has at most ``capacity`` rows whatever the corpus holds; items meet their containers through a salted rank
within the class and a broadcast table bounded by the number of configurations.

Defined results: empty and null texts take no place; a text longer than the capacity is cut into full containers and a
remainder that is packed like any other; equal lengths and repeated rows each get a place of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import cut, salted_rank

CAPACITY = 2048
#: Lengths are rounded up to a multiple of this for pricing, so the program has at most capacity / GRAIN classes.
GRAIN = 4
#: Rounds at most, gap to the dual bound at which they end, how fast weights fall, share of a class that a step covers, and how much under the best price a configuration may be.
ROUNDS, GAP, FALL, STEP, NEAR = 300, 0.005, 0.5, 0.2, 0.1


def prices(weights: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each capacity up to the given one the greatest total weight (unbounded knapsack) and the class taken last, -1 for
    a unit left free; sizes ascend."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = fits[c]
        if k:
            gain = best[c - sizes[:k]] + weights[:k]
            j = int(gain.argmax())
            if gain[j] > best[c] + 1e-15:
                best[c], pick[c] = gain[j], j
    return best, pick


def configuration(first: int, pick: np.ndarray, sizes: np.ndarray, capacity: int) -> dict[int, int]:
    """Class -> multiplicity of the best configuration that holds an item of the first class."""
    out, c = {first: 1}, capacity - int(sizes[first])
    while c > 0:
        j = int(pick[c])
        if j < 0:
            c -= 1
        else:
            out[j] = out.get(j, 0) + 1
            c -= int(sizes[j])
    return out


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, gap: float = GAP) -> dict[tuple, float]:
    """Configurations and how often each is used, covering every class at least counts times (fractional). Rounds go on
    beyond their number while a class is not covered at all; none are no solution."""
    if not rounds or not len(sizes):
        return {}
    covered, used = np.zeros(len(sizes)), {}
    total = bound = 0.0
    done = 0
    while done < rounds or covered.min() <= 0:
        w = sizes * np.exp(-FALL * (covered - covered.min()))
        best, pick = prices(w / w.max(), sizes, capacity)
        value = w / w.max() + best[capacity - sizes]
        bound = max(bound, float((w * counts).sum() / w.max() / best[capacity]))
        busy: set[int] = set()
        for i in np.argsort(covered, kind="stable").tolist():
            if i in busy or value[i] < (1 - NEAR) * best[capacity] and covered[i] > 0:
                continue
            m = configuration(i, pick, sizes, capacity)
            if busy & m.keys():
                continue
            busy |= m.keys()
            step = STEP * min(counts[j] / x for j, x in m.items())
            for j, x in m.items():
                covered[j] += step * x / counts[j]
            total += step
            key = tuple(sorted(m.items()))
            used[key] = used.get(key, 0.0) + step
        done += 1
        low = covered.min()
        if low > 0 and total / low <= bound * (1 + gap):
            break
    return {k: x / covered.min() for k, x in used.items()}


def fitting_grain(capacity: int, grain: int = GRAIN) -> int:
    """The largest divisor of the capacity up to the grain: rounded sizes then never overfill a container."""
    return next(g for g in range(min(grain, capacity), 0, -1) if capacity % g == 0)


def plan(hist: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN, rounds: int = ROUNDS) -> pd.DataFrame:
    """Rows (cls, lo, hi, base, per, slot): items of the class with rank in [lo, hi) go to container
    base + (rank - lo) div per, at place slot + (rank - lo) mod per inside it."""
    unit = capacity // fitting_grain(capacity, grain)
    sizes = np.array(sorted(hist), int)
    left = np.array([hist[int(s)] for s in sizes], np.int64)
    taken = np.zeros(len(sizes), np.int64)
    rows, container = [], 0
    configs = solve(sizes, left.copy(), unit, rounds)
    for config, x in sorted(configs.items(), key=lambda kv: (-sum(sizes[i] * m for i, m in kv[0]), -kv[1], kv[0])):
        n = min([int(x), *(int(left[i] // m) for i, m in config)])
        if n <= 0:
            continue
        slot = 0
        for i, m in config:
            rows.append((int(sizes[i]), int(taken[i]), int(taken[i]) + n * m, container, m, slot))
            taken[i] += n * m
            left[i] -= n * m
            slot += m
        container += n
    # Best fit decreasing over what the rounding left: equal items that fill or open containers alike go in one step.
    # room: by free units, ranges of containers as (first, count, slot).
    room: dict[int, list[tuple[int, int, int]]] = {}
    mask = 0
    for i in range(len(sizes) - 1, -1, -1):
        s = int(sizes[i])
        while left[i] > 0:
            high = mask >> s
            if high:
                free = s + (high & -high).bit_length() - 1
                where, count, slot = room[free].pop()
            else:
                free, where, count, slot = unit, container, int(left[i]), 0
            per = min(free // s, int(left[i]))
            n = min(count, int(left[i]) // per)
            if not high:
                container += n
            elif n < count:
                room[free].append((where + n, count - n, slot))
            elif not room[free]:
                mask ^= 1 << free
            rows.append((s, int(taken[i]), int(taken[i]) + n * per, where, per, slot))
            taken[i] += n * per
            left[i] -= n * per
            if free - per * s:
                room.setdefault(free - per * s, []).append((where, n, slot + per))
                mask |= 1 << (free - per * s)
    return pd.DataFrame(rows, columns=["cls", "lo", "hi", "base", "per", "slot"]).astype("int64")


def fill(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY, grain: int = GRAIN, rounds: int = ROUNDS) -> DataFrame:
    """(id_col, piece, container, offset, n_tokens) of every row with a positive size."""
    spark = sizes.sparkSession
    grain = fitting_grain(capacity, grain)
    kind = sizes.schema[id_col].dataType
    n = F.col(size_col)
    # A row number stands for rows whose id repeats or is null.
    base = cut(sizes.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), n.cast("long").alias("n")).filter(F.col("n") > 0), "pack-sizes")
    rest = base.select("id", "row", (F.col("n") % capacity).alias("size"), F.floor(F.col("n") / capacity).alias("piece")).filter("size > 0").withColumn("cls", F.ceil(F.col("size") / grain))
    hist = {int(r["cls"]): int(r["c"]) for r in rest.groupBy("cls").agg(F.count(F.lit(1)).alias("c")).collect()}
    table = plan(hist, capacity, grain, rounds)
    containers = int((table.base + (table.hi - table.lo - 1) // table.per).max()) + 1 if len(table) else 0
    frame = F.broadcast(spark.createDataFrame(table, "cls long, lo long, hi long, base long, per long, slot long").withColumnRenamed("cls", "_cls"))
    ranked = salted_rank(rest, ["cls"], ["row"], "rank")
    placed = ranked.join(frame, (F.col("cls") == F.col("_cls")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.select("id", "piece", "size", (F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))).alias("container"), (F.col("slot") + (F.col("rank") - F.col("lo")) % F.col("per")).alias("place"))
    # At most capacity items share a container, so this window is bounded.
    before = W.partitionBy("container").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.select(F.col("id").cast(kind).alias(id_col), "piece", "container", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int").alias("offset"), F.col("size").cast("int").alias(size_col))
    full = base.filter(F.col("n") >= capacity).select("id", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / capacity) - 1)).alias("piece"))
    full = salted_rank(full.withColumn("all", F.lit(0)), ["all"], ["row", "piece"], "rank")
    full = full.select(F.col("id").cast(kind).alias(id_col), "piece", (F.col("rank") + containers).alias("container"), F.lit(0).alias("offset"), F.lit(capacity).alias(size_col))
    return placed.unionByName(full)


def summary(packed: DataFrame, size_col: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least possible number of containers and the share of space used."""
    by = packed.groupBy("container").agg(F.sum(size_col).alias("t"), F.count(F.lit(1)).alias("k"))
    out = by.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("k"), F.lit(0)).alias("pieces"), F.coalesce(F.max("t"), F.lit(0)).alias("fullest"))
    return out.withColumn("least_containers", F.ceil(F.col("tokens") / capacity)).withColumn("fill", F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)).otherwise(F.lit(0.0)))

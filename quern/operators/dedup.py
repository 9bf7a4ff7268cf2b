"""Duplicate removal that keeps the first: exact, and by min-hash bands with the sequential greedy result.

A document is dropped if it shares a band with an earlier document that was kept. Over the graph of shared bands that is
the lexicographically first maximal independent set; rounds settle every node whose smaller neighbours are settled, so
their number is the longest increasing chain, not the number of rows. Sharing a band is the criterion itself: there is
no check of the similarity."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import normalised
from quern.plans.durable import cut

SHINGLE, PERMUTATIONS, BANDS, ROWS = 5, 128, 8, 16
_RUN = re.compile(r"[^\S\n]+")


def shingles(text: str, k: int = SHINGLE) -> set[str]:
    """Distinct k-character substrings of the normalised text; a shorter text is its own only one."""
    text = _RUN.sub(" ", unicodedata.normalize("NFC", text)).strip()
    return {text} if len(text) < k else {text[i : i + k] for i in range(len(text) - k + 1)}


def _family(seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


_A, _B = _family()


def shingle_hashes(text: str, k: int = SHINGLE) -> np.ndarray:
    """Distinct 32-bit hashes of the shingles, computed over all windows at once."""
    text = _RUN.sub(" ", unicodedata.normalize("NFC", text)).strip()
    if len(text) < k:
        return np.array([zlib.crc32(text.encode("utf-8", "surrogatepass"))], np.uint64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(c) - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : i + len(h)] + np.uint64(1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((h ^ (h >> np.uint64(27))) >> np.uint64(32))


def signature(text: str) -> np.ndarray:
    """128 minima of (a h + b mod 2^64) >> 33 over the shingles' hashes (multiply-shift hashing)."""
    h = shingle_hashes(text)
    out = np.full(PERMUTATIONS, np.iinfo(np.uint64).max)
    for lo in range(0, len(h), 2048):
        out = np.minimum(out, (h[None, lo : lo + 2048] * _A[:, None] + _B[:, None]).min(axis=1))
    return (out >> np.uint64(33)).astype(np.int64)


def signatures(df: DataFrame, id_col: str = "seq", text_col: str = "content") -> DataFrame:
    """(id, signature ARRAY<BIGINT>); null texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, signature(t)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t is not None]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), pa.array([s.tolist() for _, s in got], pa.list_(pa.int64()))], ["id", "signature"])

    return df.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, signature array<long>")


def bands(sigs: DataFrame, b: int = BANDS, r: int = ROWS) -> DataFrame:
    """(id, band, hash): one row a band."""
    parts = F.array(*[F.xxhash64(F.slice("signature", i * r + 1, r)) for i in range(b)])
    return sigs.select("id", F.posexplode(parts).alias("band", "hash"))


def edges(banded: DataFrame) -> DataFrame:
    """(u, v), v < u: all pairs of rows that share a band, for reports on small tables; keep_first needs no pairs."""
    a, b = banded.toDF("v", "band", "hash"), banded.toDF("u", "band", "hash")
    return a.join(b, ["band", "hash"]).filter("v < u").select("u", "v").distinct()


def keep_first(banded: DataFrame) -> DataFrame:
    """(id, kept): the greedy keep-first result over rows that share a band, without pairs.

    In each round a bucket (band, hash) that holds a kept row drops its later undecided members, and a row that is the
    smallest undecided of all its buckets is kept. Each round is two aggregations over (id, bucket) rows, so a bucket
    that holds a third of all rows costs as much as any other a row; a bucket's minimum is combined on the map side."""
    rows = cut(banded.select("id", "band", "hash").distinct(), "keep-rows")
    settled: DataFrame | None = None
    open_rows = rows
    while True:
        low = open_rows.groupBy("band", "hash").agg(F.min("id").alias("low"))
        first = open_rows.join(low, ["band", "hash"]).groupBy("id").agg(F.min((F.col("id") == F.col("low")).cast("int")).alias("all_first"))
        kept = cut(first.filter("all_first = 1").select("id", F.lit(True).alias("kept")), "keep-kept")
        # A kept row's buckets drop everyone else who is still open in them: all of them are larger.
        hot = open_rows.join(kept.select("id"), "id", "left_semi").select("band", "hash").distinct()
        gone = open_rows.join(hot, ["band", "hash"], "left_semi").select("id").distinct().join(kept.select("id"), "id", "left_anti")
        gone = cut(gone.select("id", F.lit(False).alias("kept")), "keep-gone")
        done = kept.unionByName(gone)
        settled = done if settled is None else settled.unionByName(done)
        open_rows = cut(open_rows.join(done.select("id"), "id", "left_anti"), "keep-open")
        if open_rows.limit(1).count() == 0:
            return settled


def near_dedup(df: DataFrame, id_col: str = "seq", text_col: str = "content") -> DataFrame:
    return keep_first(bands(signatures(df, id_col, text_col)))


def stats(kept: DataFrame) -> DataFrame:
    """One row: seen, duplicates, unique, duplicate_rate."""
    out = kept.agg(F.count(F.lit(1)).alias("seen"), F.coalesce(F.sum((~F.col("kept")).cast("long")), F.lit(0)).alias("duplicates"))
    return out.select("seen", "duplicates", (F.col("seen") - F.col("duplicates")).alias("unique"), (F.col("duplicates") / F.greatest("seen", F.lit(1))).alias("duplicate_rate"))


def exact_dedup(df: DataFrame, id_col: str = "seq", text_col: str = "content") -> DataFrame:
    """(digest, first id, copies) of the distinct normalised texts: a map-side combined aggregation on the digest."""
    keyed = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col), F.md5(normalised(text_col)).alias("digest"))
    return keyed.groupBy("digest").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("copies"))

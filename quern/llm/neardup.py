"""Problem 1: near-duplicate texts by Golay-code fuzzy hashing.

Every text is normalised and cut into its distinct 5-character substrings. Their hashes, dealt over the bins of a few
permutations by value, give one minimum a bin (one-permutation min-hashing; an empty bin borrows from a fixed other one),
and each minimum gives one bit of a fingerprint of 23-bit segments. A segment decodes to the indices of the Golay
codewords near it: the nearest one and, where that is three bits away, five more. ``width`` segments form a band; a key is
the band with one index of each of its segments, of which at most one is not the nearest.

The pigeonhole principle bounds what may be missed: if a band of two texts differs in at most two bits, they always share
one of its keys, so fingerprints that differ in fewer than three bits a band always meet. At the threshold a bit differs
with probability (1 - similarity) / 2; more errors in every band at once are left (1 in 10,000 pairs at similarity 0.85,
fewer above). Random meetings grow with the rows, so ``shape`` widens the bands with their number,
and adds bands, so that a row meets a bounded number of others by chance.

A key row carries the size and 24 bits of the fingerprint in one number, so the join itself drops random meetings before anything is
shuffled again. Texts that share a key and are close in size and in the whole fingerprint are compared exactly.

Exact copies are one class, represented by its smallest id, so a class takes part in the search once however many rows
it has; classes are made by a partial aggregation, never by collecting a group. Keys, candidates and texts travel by
shuffle joins, whose hot partitions AQE splits; nothing of the corpus is collected, nothing but a counted number of ids is
broadcast, and no bucket is capped.

Defined results: null texts and texts under ``min_chars`` characters after normalisation match nothing; rows with a null
id are left out; of rows with equal ids one counts; identical texts are pairs of similarity 1.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import golay
from quern.llm.common import cut

SHINGLE = 5
THRESHOLD = 0.85
MIN_CHARS = 100
#: Fingerprint bits that may differ: so many standard deviations above what the threshold lets expect.
SLACK = 5.5
#: Up to so many ids of candidates (64 MB as a hash table) are broadcast to pick their texts where they are scanned.
BROADCAST_IDS = 4_000_000
#: Fingerprint bits that a key row carries.
WORD = 24
#: Segments a permutation: few bins, so that short texts leave few of them empty.
SEGMENTS_EACH = 3
#: (segments a band, bands, rows up to which a row meets some sixty others by chance); each shape misses about 1 in 10,000 pairs at similarity 0.85.
SHAPES = ((2, 10, 1_000_000), (3, 22, 1_000_000_000), (4, 48, None))
_RUN = re.compile(r"[^\S\n ][^\S\n]*| [^\S\n]+")
_U = np.uint64


def normalise(text: str) -> str:
    """NFC, each run of white space other than newline to one space, stripped."""
    return _RUN.sub(" ", unicodedata.normalize("NFC", text)).strip()


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-character substrings; injective while code points stay under 4096."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    n = len(c) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, _U)
    if int(c.max()) < 4096:
        h = c[:n]
        for k in range(1, SHINGLE):
            h = (h << _U(12)) | c[k : k + n]
    else:
        h = c[:n]
        for k in range(1, SHINGLE):
            h = h * _U(0x100000001B3) + _mix(c[k : k + n] + _U(k))
    h = _mix(h + _U(0x9E3779B97F4A7C15))
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def jaccard(a: str, b: str) -> float:
    """Exact similarity of two normalised texts."""
    top = max(map(ord, a + b))
    if top < 4096:
        x, y = shingle_hashes(a), shingle_hashes(b)
        both = np.concatenate((x, y))
        both.sort()
        inter = int((both[1:] == both[:-1]).sum())
        return inter / (len(x) + len(y) - inter)
    x, y = ({t[i : i + SHINGLE] for i in range(len(t) - SHINGLE + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def shape(rows: int) -> tuple[int, int]:
    """(segments a band, bands) for so many rows."""
    return next((w, n) for w, n, most in SHAPES if most is None or rows <= most)


@functools.lru_cache(maxsize=4)
def _plan(segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(edges of the bins of a permutation, salts of the permutations, where an empty bin looks, salts of the bins)."""
    permutations, bins = -(-segments // SEGMENTS_EACH), SEGMENTS_EACH * golay.LENGTH
    rng = np.random.default_rng(20240501)
    edges = (np.arange(bins, dtype=object) * (1 << 64) // bins).astype(_U)
    borrow = np.stack([rng.permutation(permutations * bins) for _ in range(64)])
    return edges, rng.integers(1, 1 << 63, permutations, dtype=_U), borrow, rng.integers(1, 1 << 63, permutations * bins, dtype=_U)


def sketch(hashes: list[np.ndarray], segments: int) -> np.ndarray:
    """The 23-bit segments (n, segments) of each non-empty hash set."""
    edges, permutations, borrow, salts = _plan(segments)
    n, bins = len(hashes), len(edges)
    low, full = np.zeros((n, len(salts)), _U), np.zeros((n, len(salts)), bool)
    for i, h in enumerate(hashes):
        for p, salt in enumerate(permutations):
            x = h if p == 0 else np.sort(_mix(h ^ salt))
            start = np.searchsorted(x, edges)
            full[i, p * bins : (p + 1) * bins] = np.append(start[1:], len(x)) > start
            low[i, p * bins : (p + 1) * bins] = x[np.minimum(start, len(x) - 1)]
    for row in borrow:
        empty = ~full
        if not empty.any():
            break
        take = empty & full[:, row]
        low = np.where(take, low[:, row], low)
        full = full | take
    bits = (_mix(low ^ salts) >> _U(63)).astype(np.int64).reshape(n, -1, golay.LENGTH)
    return (bits << np.arange(golay.LENGTH)).sum(axis=2)[:, :segments]


def keys(segments: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of every key of every row: the band and an index of each of its segments, 12 bits each, at most
    one of them not that of the nearest codeword."""
    n, count = segments.shape
    index = golay.decode(segments).reshape(n, count // width, width, golay.MOST_KEYS)
    nearest = index[:, :, :, 0]
    shift = np.arange(width) * golay.DIMENSION
    band = np.arange(count // width, dtype=np.int64)[None, :] << width * golay.DIMENSION
    base = band | (nearest << shift).sum(axis=2)
    # One segment's nearest index given up for another of its indices.
    other = base[:, :, None, None] + (index[:, :, :, 1:] - nearest[:, :, :, None] << shift[None, None, :, None])
    on = index[:, :, :, 1:] >= 0
    rows = np.arange(n)
    at = np.concatenate((np.repeat(rows, count // width), np.broadcast_to(rows[:, None, None, None], on.shape)[on]))
    return at, np.concatenate((base.ravel(), other[on]))


def _parts(segments: int) -> list[str]:
    """Columns of a fingerprint, two segments each."""
    return [f"s{i}" for i in range((segments + 1) // 2)]


def sketches(df: DataFrame, id_col: str, text_col: str, segments: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, h1, h2, size, s0..) of every row long enough; h1 and h2 identify the normalised text."""
    names = _parts(segments)
    schema = "id long, h1 long, h2 long, size int, " + ", ".join(f"{s} long" for s in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                ids, sets, digests = [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if i is None or not text or len(text) * 3 < min_chars:  # NFC lengthens a text three times at most
                        continue
                    text = normalise(text)
                    if len(text) >= min_chars:
                        ids.append(i)
                        sets.append(shingle_hashes(text))
                        digests.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                if not ids:
                    continue
                wide = np.pad(sketch(sets, segments), ((0, 0), (0, segments % 2)))
                digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                cols = [pa.array(ids, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([len(s) for s in sets], pa.int32())]
                cols += [pa.array(wide[:, 2 * k] | wide[:, 2 * k + 1] << golay.LENGTH) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "h1", "h2", "size", *names])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def key_rows(reps: DataFrame, width: int, bands: int) -> DataFrame:
    """(key, id, mark): the search keys of each representative; its mark is its size and WORD bits of its fingerprint."""
    names = _parts(width * bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                ids, sizes = part.column(0).to_numpy(), part.column(1).to_numpy()
                packed = np.stack([part.column(2 + k).to_numpy() for k in range(len(names))], axis=1)
                segments = np.stack((packed & (1 << golay.LENGTH) - 1, packed >> golay.LENGTH), axis=2).reshape(len(ids), -1)[:, : width * bands]
                # Half from the first and half from the last band, of which a pair that meets in one band has one at least by chance.
                mark = sizes.astype(np.int64) << WORD | (segments[:, 0] & (1 << WORD // 2) - 1) << WORD // 2 | segments[:, -1] & (1 << WORD // 2) - 1
                at, key = keys(segments, width)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[at]), pa.array(mark[at])], ["key", "id", "mark"])

    return reps.select("id", "size", *names).mapInArrow(run, "key long, id long, mark long")


def allowed_bits(threshold: float, n: int) -> int:
    """Of n fingerprint bits so many may differ at the threshold."""
    p = (1 - threshold) / 2
    return int(p * n + SLACK * (p * (1 - p) * n) ** 0.5)


def similar_classes(df: DataFrame, id_col: str = "seq", text_col: str = "content", threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives (a, b, similarity), membership (id, rep)); a < b."""
    width, bands = shape(df.count())
    names = _parts(width * bands)
    all_rows = cut(sketches(df, id_col, text_col, width * bands, min_chars), "neardup-sketch")
    classes = all_rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    members = cut(all_rows.select("id", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "rep").distinct(), "neardup-members")
    is_rep = members.filter("id = rep").select("id")
    reps = cut(all_rows.drop("h1", "h2").join(is_rep, "id", "left_semi").dropDuplicates(["id"]), "neardup-reps")

    k = key_rows(reps, width, bands)
    a, b = k.toDF("key", "a", "mark_a"), k.toDF("key", "b", "mark_b")
    size_a, size_b = F.shiftright("mark_a", WORD), F.shiftright("mark_b", WORD)
    small, large = F.least(size_a, size_b), F.greatest(size_a, size_b)
    near = F.bit_count(F.col("mark_a").bitwiseXOR(F.col("mark_b")).bitwiseAND(F.lit((1 << WORD) - 1))) <= allowed_bits(threshold, WORD)
    met = a.join(b, "key").filter((F.col("a") < F.col("b")) & (small >= F.lit(threshold) * large) & near).select("a", "b").distinct()
    left = reps.select(F.col("id").alias("a"), *[F.col(s).alias(f"a_{s}") for s in names])
    right = reps.select(F.col("id").alias("b"), *[F.col(s).alias(f"b_{s}") for s in names])
    differ = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in names), F.lit(0))
    close = cut(met.join(left, "a").join(right, "b").filter(differ <= allowed_bits(threshold, width * bands * golay.LENGTH)).select("a", "b"), "neardup-candidates")

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    needed = close.select(F.col("a").alias("id")).unionByName(close.select(F.col("b").alias("id"))).distinct()
    if 2 * close.count() <= BROADCAST_IDS:  # else both sides travel
        needed = F.broadcast(needed)
    texts = texts.join(needed, "id", "left_semi").dropDuplicates(["id"])
    pairs = close.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return verified(pairs, threshold), members


def verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose exact similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            j = np.array([jaccard(normalise(x), normalise(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], float)
            on = pa.array(np.flatnonzero(j >= threshold), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(on), batch.column(1).take(on), pa.array(j[j >= threshold])], ["a", "b", "similarity"])

    return pairs.mapInArrow(run, "a long, b long, similarity double")


def row_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(seq_a, seq_b) of all rows alike enough: links between classes expanded, and pairs inside a class."""
    x, y = members.toDF("x", "a"), members.toDF("y", "b")
    across = links.select("a", "b").join(x, "a").join(y, "b").select("x", "y")
    inside = members.toDF("x", "rep").join(members.toDF("y", "rep"), "rep").filter("x < y").select("x", "y")
    return across.select(F.least("x", "y").alias("seq_a"), F.greatest("x", "y").alias("seq_b")).unionByName(inside.toDF("seq_a", "seq_b"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): connected components of edges (a, b) by alternating large-star and small-star steps."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = cut(small, name)
        e = small
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())  # one row
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(seq, class, group_id, links): of each row its class of copies, its group, and the links of the class to others."""
    links = cut(links.select("a", "b"), "neardup-links")
    root = components(links).toDF("rep", "root")
    degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return members.join(root, "rep", "left").join(degree, "rep", "left").select(F.col("id").alias("seq"), F.col("rep").alias("class"), F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))

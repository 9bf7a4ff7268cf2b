"""Problem 3: evaluation texts leaking into training text, by a prefix-filtered set join with positional bounds.

Words are runs of letters and digits compared without case. Every window of ``width`` consecutive words of an item is a
set to be contained. Words are ordered by rarity, their document frequency over the whole corpus; the necessary prefix
of a window is its rarest word, so a file without that word cannot hold the window. Where the word occurs in a file, its
place in the window fixes the only place at which the window can begin (the positional bound; the length bound is that
the file reaches that far), and the words there are compared exactly.

The items are a stated query set: they are read in blocks of ``BLOCK`` windows, each broadcast against all rows. Nothing
of the corpus is shuffled but the word counts, which are added up in each batch first and have one row a word of the items.

Defined results: null and short texts (under ``width`` words) on either side match nothing; a file and a task that share
several windows, or a task whose texts repeat, give one row with the number of distinct windows shared.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 12
BLOCK = 200_000
WORDS = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def windows(items: list[tuple[str, str, str | None]], width: int = WIDTH) -> dict[tuple[str, ...], set[tuple[str, str]]]:
    out: dict[tuple[str, ...], set[tuple[str, str]]] = defaultdict(set)
    for suite, task, text in items:
        w = words(text)
        for i in range(len(w) - width + 1):
            out[tuple(w[i : i + width])].add((suite, task))
    return out


def document_frequency(corpus: DataFrame, text_col: str, vocabulary: set[str]) -> dict[str, int]:
    """In how many rows of the corpus each word of the vocabulary occurs."""
    shared = corpus.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = shared.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total.update(known.intersection(WORDS.findall(text.lower())))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    counts = corpus.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counts.collect()}  # at most one row a word of the items


def prefix_index(block: dict, frequency: dict[str, int]) -> tuple[dict[str, tuple[int, ...]], dict]:
    """Necessary word -> its places in windows; joined window -> tasks."""
    places, table = defaultdict(set), {}
    for w, tasks in block.items():
        at = min(range(len(w)), key=lambda i: (frequency.get(w[i], 0), w[i], i))
        places[w[at]].add(at)
        table[" ".join(w)] = sorted(tasks)
    return {k: tuple(sorted(v)) for k, v in places.items()}, table


def probe(found: list[str], places: dict, table: dict, width: int) -> Counter:
    """Tasks with the number of distinct windows that the words hold."""
    n, hits = len(found), set()
    present = places.keys() & set(found)
    if present:
        for at, word in enumerate(found):
            if word in present:
                for p in places[word]:
                    start = at - p
                    if start >= 0 and start + width <= n:
                        key = " ".join(found[start : start + width])
                        if key in table:
                            hits.add(key)
    return Counter(task for key in hits for task in table[key])


def leaks(corpus: DataFrame, items: list[tuple[str, str, str | None]], id_col: str = "seq", text_col: str = "content", width: int = WIDTH) -> DataFrame:
    """(id_col, suite, task_id, shared) of every row of the corpus and task that share a window."""
    spark = corpus.sparkSession
    kind = corpus.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, suite string, task_id string, shared int"
    every = windows(items, width)
    if not every:
        return spark.createDataFrame([], schema)
    frequency = document_frequency(corpus, text_col, {w for k in every for w in k})
    keys = sorted(every)
    parts = []
    for lo in range(0, len(keys), BLOCK):
        shared = spark.sparkContext.broadcast(prefix_index({k: every[k] for k in keys[lo : lo + BLOCK]}, frequency))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            places, table = shared.value
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                rows = [(i, *task, n) for i, text in enumerate(texts) if text for task, n in probe(WORDS.findall(text.lower()), places, table, width).items()]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int32())], [id_col, "suite", "task_id", "shared"])

        parts.append(corpus.select(id_col, text_col).mapInArrow(run, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) > 1:
        out = out.groupBy(id_col, "suite", "task_id").agg(F.sum("shared").cast("int").alias("shared"))
    return out

"""Problem 7: encoding a corpus with a public byte-level BPE by forced-boundary splitting.

A byte pair that occurs inside no vocabulary entry can never be merged across, so such a pair marks a certain cut. Where
the cut also leaves the pre-tokenizer's matches unchanged, the two sides can be encoded on their own and concatenated.
Texts are cut at such places into fragments of about ``FRAGMENT`` bytes; fragments seen before in a task come from a cache.

Defined results: a null and an empty text give an empty list; literals of special tokens are ordinary text; NUL,
combining and invisible characters are bytes like any other; a text without any certain cut is one fragment.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.functions.tokens import encode_text

TOKENIZERS = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
#: The pre-tokenizer of byte_bpe_50k (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FRAGMENT = 256
#: Rows encoded at a time: the ids of one slice are Python integers until they are packed.
SLICE = 512
#: Cached fragments per worker; the cache is emptied when full, so memory stays bounded.
CACHE = 4096

_SPACE, _LETTER, _DIGIT, _OTHER, _QUOTE = 1, 2, 3, 4, 5


def _ascii_classes() -> np.ndarray:
    c = np.zeros(256, np.uint8)
    for i in range(128):
        ch = chr(i)
        c[i] = _SPACE if ch.isspace() else _LETTER if ch.isalpha() else _DIGIT if ch.isdigit() else _QUOTE if ch == "'" else _OTHER
    return c


class ForcedBoundaryEncoder:
    """Encoder for one vocabulary file in tiktoken format."""

    def __init__(self, path: str, pattern: str = PATTERN, fragment: int = FRAGMENT):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        never = np.ones((256, 256), bool)
        for token in ranks:
            for a, b in zip(token, token[1:]):
                never[a, b] = False
        self.never = never
        cls = _ascii_classes()
        left, right = cls[:, None], cls[None, :]
        # Both bytes ASCII: before white space, and between runs of different kinds unless an apostrophe may begin a contraction.
        kinds = ((right == _SPACE) & (left > _SPACE)) | ((left > _SPACE) & (right > _SPACE) & (left != right) & (left != _QUOTE) & ~((left == _OTHER) & (right == _QUOTE)))
        self.certain = never & kinds
        self.certain_wide = never.copy()
        self.certain_wide[:0x80, :] = False
        self.certain_wide[:, :0xC3] = False
        self.fragment = fragment
        self.cache: dict[bytes, list[int]] = {}

    def cuts(self, raw: bytes) -> np.ndarray:
        """Byte offsets at which raw can certainly be cut."""
        x = np.frombuffer(raw, np.uint8)
        a, b = x[:-1], x[1:]
        at = np.flatnonzero(self.certain[a, b]) + 1
        wide = np.flatnonzero(self.certain_wide[a, b]) + 1
        if len(wide):
            # The character before must not be white space: those have lead bytes C2, E1, E2 or begin with E3 80.
            lead = np.where((x & 0xC0) != 0x80, np.arange(len(x)), 0)
            lead = np.maximum.accumulate(lead)[wide - 1]
            second = x[np.minimum(lead + 1, len(x) - 1)]
            ok = ~np.isin(x[lead], (0xC2, 0xE1, 0xE2)) & ~((x[lead] == 0xE3) & (second == 0x80))
            at = np.union1d(at, wide[ok])
        return at

    def fragments(self, text: str) -> list[str]:
        if len(text) <= self.fragment:
            return [text]
        raw = text.encode()
        at = self.cuts(raw)
        if not len(at):
            return [text]
        out, start = [], 0
        while len(raw) - start > self.fragment:
            i = int(np.searchsorted(at, start + self.fragment))
            if i == len(at):
                break
            end = int(at[i])
            out.append(raw[start:end].decode())
            start = end
        out.append(raw[start:].decode())
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        for part in self.fragments(text):
            got = self.cache.get(part)
            if got is None:
                got = encode_text(self.encoding, part)
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[part] = got
            ids += got
        return ids


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(path)


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.tiktoken"


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids ARRAY<INT>) of every row of df, one narrow pass without a shuffle."""
    path = path or vocabulary()
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                lists = [enc.encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int64).astype(np.int32)
                flat = np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(ends[-1]))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, n_tokens INT): the lengths that encode_corpus would give, without moving the ids."""
    path = path or vocabulary()
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            sizes = pa.array([len(enc.encode(t)) for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], [id_col, "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens int")

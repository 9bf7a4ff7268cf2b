"""Encoding and decoding with a tokenizer file that is a parameter; each Python worker loads it once."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = os.environ.get("QUERN_TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.json")
#: Which special token ends a file in the default vocabulary (fixed value).
EOF = "<|endoftext|>"


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer with padding and truncation off; special-token literals in a text are ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    t.encode_special_tokens = True
    return t


#: The pre-tokenizer of the default vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def ranks(path: str):
    """A faster encoder of the same vocabulary, where its ranks lie beside the tokenizer file; else None."""
    beside = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(beside):
        return None
    import tiktoken

    with open(beside, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(beside, pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


#: From this length on a text is cut by a matcher whose stack does not grow with runs of white space.
LONG = 5000


def encode_text(encoding, text: str) -> list[int]:
    """The ids of a text as ordinary text; a text of any length and form is encoded without exhausting a stack."""
    if len(text) < LONG:
        return encoding.encode_ordinary(text)
    return [i for piece in _pieces(encoding._pat_str).findall(text) for i in (encoding.encode_ordinary(piece) if len(piece) < LONG else encoding._encode_single_piece(piece))]


@functools.lru_cache(maxsize=4)
def _pieces(pattern: str):
    import regex

    return regex.compile(pattern)


def encode(c: Column, add_eof: bool = False, path: str = FILE) -> Column:
    """ARRAY<INT> of ids; null and empty texts give an empty list, plus the end mark if asked for."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t, fast = tokenizer(path), ranks(path)
        end = [t.token_to_id(EOF)] if add_eof else []
        for s in batches:
            if fast:
                yield pd.Series([encode_text(fast, x or "") + end for x in s])
            else:
                yield pd.Series([e.ids + end for e in t.encode_batch([x or "" for x in s], add_special_tokens=False)])

    return run(c)


def decode(c: Column, skip_special_tokens: bool = True, path: str = FILE) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t, fast = tokenizer(path), ranks(path)
        for s in batches:
            rows = [list(x) if x is not None else [] for x in s]
            if fast and skip_special_tokens:
                yield pd.Series([fast.decode([i for i in x if i < fast.n_vocab]) for x in rows])
            else:
                yield pd.Series(t.decode_batch(rows, skip_special_tokens=skip_special_tokens))

    return run(c)


def vocabulary(spark: SparkSession, path: str = FILE) -> DataFrame:
    """(id, token) ordered by id: bounded by the vocabulary's size."""
    vocab = sorted((i, t) for t, i in tokenizer(path).get_vocab().items())
    return spark.createDataFrame(pd.DataFrame(vocab, columns=["id", "token"]).astype({"id": "int32"}))


def special_ids(path: str = FILE) -> dict[str, int | None]:
    """Ids of the end, padding and unknown marks; padding and unknown fall back to the end mark where there is none."""
    t = tokenizer(path)
    end = t.token_to_id(EOF)
    return {"eof": end, "pad": t.token_to_id("<|pad|>") if t.token_to_id("<|pad|>") is not None else end, "unk": t.token_to_id("<|unk|>") if t.token_to_id("<|unk|>") is not None else end}


def padded(ids: Column, width: int, pad: int) -> Column:
    """The ids filled up to the width; longer ones stay."""
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(width) - F.size(ids)).cast("int")))

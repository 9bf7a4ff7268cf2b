"""Documents that a run leaves behind: metadata, results, metrics by tag, vocabulary."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.tokens import FILE, tokenizer
from quern.operators.training import locked


def pack_metadata(stats: dict, boundaries: DataFrame | None = None, **more) -> dict:
    """Totals of packing with the ends of the stages, which are there only if stages were counted."""
    out = dict(stats) | more
    if boundaries is not None:
        ends = {r["stage"]: r["end_token"] for r in boundaries.collect()}  # three rows
        if ends:
            out["stage_boundaries"] = {f"stage{s}_end_token": ends[s] for s in sorted(ends)} | {"stage3_upsample": 3}
    return out


def write_json(document: dict, path: str) -> None:
    """One JSON file, complete or not there at all."""
    tmp = f"{path}.{os.getpid()}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(document, f, indent=2)
    os.replace(tmp, path)


def result_document(df: DataFrame, **about) -> DataFrame:
    """The rows of a small result as one JSON document with what is said about the run."""
    rows = F.collect_list(F.struct(*df.columns))
    return df.agg(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in about.items()], rows.alias("results"))).alias("value"))


def write_metrics(rows: DataFrame, path: str, tag: str = "tag", order: str = "step", metrics: str = "metrics") -> None:
    """CSV parts by tag; a tag's columns are those of its first row, given in the header line of each of its parts."""
    fixed = locked(rows, tag, [order], metrics)
    line = F.concat_ws(",", F.col(order).cast("string"), F.array_join("values", ","))
    head = F.concat_ws(",", F.lit(order), F.array_join("columns", ","))
    body = fixed.select(F.col(tag).alias("tag"), F.lit(1).alias("_k"), F.col(order).alias("_o"), line.alias("value"))
    heads = fixed.groupBy(F.col(tag).alias("tag")).agg(F.lit(0).alias("_k"), F.lit(None).cast("long").alias("_o"), F.first(head).alias("value"))
    body.unionByName(heads).repartition("tag").sortWithinPartitions("tag", "_k", "_o").select("tag", "value").write.partitionBy("tag").text(path)


def write_vocabulary(folder: str, path: str = FILE, special: tuple[str, ...] = ("<|endoftext|>",)) -> None:
    """vocab.txt by id, and what a reader must know of the tokenizer."""
    os.makedirs(folder, exist_ok=True)
    t = tokenizer(path)
    with open(os.path.join(folder, "vocab.txt"), "w", encoding="utf-8") as f:
        for token, i in sorted(t.get_vocab().items(), key=lambda x: x[1]):
            f.write(f"{i}\t{token}\n")
    import tokenizers

    write_json({"vocab_size": t.get_vocab_size(), "special_tokens": {s: t.token_to_id(s) for s in special}, "model_type": "bpe", "tokenizers_version": tokenizers.__version__}, os.path.join(folder, "tokenizer_meta.json"))

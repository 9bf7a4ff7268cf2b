"""The flat token file: unsigned 16-bit ids one after another, as a Spark data source ("packed_tokens") and a writer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STRIPE = 4 << 20


class _Stripe(InputPartition):
    def __init__(self, path: str, lo: int, hi: int, base: int):
        self.path, self.lo, self.hi, self.base = path, lo, hi, base


class PackedTokens(DataSource):
    """(pos LONG, token INT) of a file or of a folder of part files in the order of their names; read by byte ranges."""

    @classmethod
    def name(cls) -> str:
        return "packed_tokens"

    def schema(self) -> str:
        return "pos long, token int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("stripe", STRIPE)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, stripe: int):
        self.path, self.stripe = path, stripe - stripe % 2

    def partitions(self) -> list[InputPartition]:
        files = part_files(self.path)
        out, base = [], 0
        for f in files:
            size = os.path.getsize(f)
            if size % 2:
                raise ValueError(f"{f} holds half a token")
            out += [_Stripe(f, lo, min(size, lo + self.stripe), base + lo // 2) for lo in range(0, size, self.stripe)]
            base += size // 2
        return out or [_Stripe("", 0, 0, 0)]

    def read(self, p: _Stripe) -> Iterator[pa.RecordBatch]:
        if p.hi > p.lo:
            with open(p.path, "rb") as f:
                f.seek(p.lo)
                x = np.frombuffer(f.read(p.hi - p.lo), np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype=np.int64) + p.base), pa.array(x.astype(np.int32))], ["pos", "token"])


def mounted(path: str) -> str:
    """A path that every executor sees under the same name; other file systems are refused, not written to local disks."""
    if "://" in path.removeprefix("file://"):
        raise ValueError(f"token files need a mounted path, not {path}")
    return path.removeprefix("file://")


def part_files(path: str) -> list[str]:
    path = mounted(path)
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return sorted(os.path.join(path, x) for x in os.listdir(path) if x.endswith(".bin")) if os.path.isdir(path) else [path]


def token_count(path: str) -> int:
    """Two bytes a token."""
    return sum(os.path.getsize(f) for f in part_files(path)) // 2


def arranged(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """The rows in the given order over partitions: what write() expects. Arrange before encoding: cutting the ranges
    reads the input once more, which is cheap for a scan and dear for an encoder."""
    n = partitions or max(1, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def write(encoded: DataFrame, ids: str, folder: str) -> dict:
    """Write the ids of arranged rows as part files whose names sort in the order of the partitions; totals.

    Every task writes its own file under a name that holds its number, through a rename, so a repeated attempt replaces
    and never appends."""
    folder = mounted(folder)
    if os.path.exists(folder):
        raise FileExistsError(folder)
    os.makedirs(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        c = TaskContext.get()
        name = os.path.join(folder, f"part-{c.partitionId():06d}.bin")
        tmp = f"{name}.{c.taskAttemptId()}.tmp"
        tokens = files = 0
        with open(tmp, "wb") as f:
            for pdf in batches:
                for x in pdf[ids]:
                    a = np.asarray(x if x is not None else [], np.int64)
                    if len(a) and (a.min() < 0 or a.max() > 65535):
                        raise ValueError("a token id does not fit into 16 bits")
                    f.write(a.astype(np.uint16).tobytes())
                    tokens += len(a)
                    files += 1
        os.replace(tmp, name)
        yield pd.DataFrame({"tokens": [tokens], "files": [files]})

    got = encoded.select(ids).mapInPandas(run, "tokens long, files long").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("files"), F.lit(0))).first()
    return {"total_tokens": got[0], "total_files": got[1], "output_path": folder, "size_gb": got[0] * 2 / 1024**3}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackedTokens)

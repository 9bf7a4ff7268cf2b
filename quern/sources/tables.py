"""Scans with explicit schemas; order that carries meaning is always a column."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import is_blank

CHECKPOINT = T.StructType([T.StructField("source", T.StringType()), T.StructField("tag", T.StringType())])
#: Repositories' tags in the order in which their sources come (fixed values).
ORDER = {"curated": 0, "stdlib": 1, "stack": 2, "stackoverflow": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_splits(df: DataFrame) -> int | None:
    """How many splits the largest file scan of a plan has at least, by the number and sizes of its files; None if the
    plan reads anything but files."""
    spark, most, splits = df.sparkSession, -1, None
    width = int(str(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
            return None
        location = leaf.relation().location()
        size = location.sizeInBytes()
        if size > most:
            most, splits = size, max(len(location.inputFiles()), size // width)
    return splits


def spread(df: DataFrame) -> DataFrame:
    """A scan of so few files that its splits would leave over half of the cores idle is dealt over them before Python
    work; any other is taken as it is split. Sizes do not matter, so an input of many files has the same plan at every size."""
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, scan_splits(df)
    return df.repartition(max(2, cores)) if splits is not None and 2 * splits < cores else df


def code_rows(stack: DataFrame, repos: DataFrame) -> DataFrame:
    """Rows of the general code scan that are kept: content present, repository not among those fetched directly."""
    known = F.broadcast(repos.select(F.col("repo")).distinct())  # a handful of curated repositories
    named = stack.filter(F.coalesce("content", F.lit("")) != "").withColumn("repo", F.coalesce("max_stars_repo_name", F.lit("")))
    return named.join(known, "repo", "left_anti")


def quota(files: DataFrame, repos: DataFrame, tag: str, limit: int, parts: int) -> DataFrame:
    """Files of the repositories with the tag: at most max(1, limit div parts) a repository, limit in all."""
    mine = F.broadcast(repos.filter(F.col("tag") == tag).select("repo").distinct())
    per = max(1, limit // parts)
    ranked = files.filter(F.col("content").isNotNull() & ~is_blank("content")).join(mine, "repo")
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("repo").orderBy("file_path", "file_seq"))).filter(F.col("rank") <= per)
    return ranked.orderBy("repo", "rank").limit(limit)


def corpus_rows(df: DataFrame, language: str, lang_col: str = "lang", text_col: str = "content", least: int = 50) -> DataFrame:
    return df.filter((F.col(lang_col) == language) & (F.length(text_col) >= least))


def jsonl(spark: SparkSession, path: str, schema: T.StructType = CHECKPOINT) -> DataFrame:
    """Rows of JSON lines that parse and have every key; blank and broken lines are left out (see jsonl_report)."""
    raw = spark.read.schema(T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    ok = F.col("_bad").isNull()
    for f in schema.names:
        ok = ok & F.col(f).isNotNull()
    return raw.filter(ok).select(*schema.names)


def jsonl_report(spark: SparkSession, path: str, schema: T.StructType = CHECKPOINT) -> DataFrame:
    """(loaded, skipped): counts of usable and other non-blank lines."""
    text = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", schema)
    ok = F.lit(True)
    for f in schema.names:
        ok = ok & parsed[f].isNotNull()
    return text.agg(F.count(F.when(ok, 1)).alias("loaded"), F.count(F.when(~ok | ok.isNull(), 1)).alias("skipped"))


def source_tree(spark: SparkSession, *paths: str, pattern: str = "*.py") -> DataFrame:
    """(path, content) of the files under the paths, whole, in the order of their names."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")).orderBy("path")


def archives(spark: SparkSession, path: str, limit: int | None = None, suffix: str = ".py") -> DataFrame:
    """(archive, path, content) of the source files in tar archives: bad bytes are dropped, blank files skipped, at most
    limit files an archive in the order of their paths. An archive is read by one task; archives in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, blob in zip(pdf["path"], pdf["content"]):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(blob)) as tar:
                    for m in sorted((m for m in tar.getmembers() if m.isfile() and m.name.endswith(suffix)), key=lambda m: m.name):
                        if limit is not None and len(rows) >= limit:
                            break
                        text = tar.extractfile(m).read().decode("utf-8", "ignore")
                        if text.strip():
                            rows.append((name, m.name, text))
                yield pd.DataFrame(rows, columns=["archive", "path", "content"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, "archive string, path string, content string")


def checkpoints(spark: SparkSession, names: DataFrame) -> DataFrame:
    """(name, step) of complete checkpoint directories among (name, is_dir)."""
    step = F.regexp_extract("name", r"step_([0-9]+)\z", 1)
    return names.filter(F.col("is_dir") & ~F.col("name").endswith(".tmp") & (step != "")).select("name", step.cast("long").alias("step"))

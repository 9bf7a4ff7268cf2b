"""Benchmark problems and samples from JSON lines, each suite projected to its own fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HUMANEVAL = "task_id string, prompt string, canonical_solution string, test string, entry_point string"
MBPP = "task_id int, text string, code string, test_list array<string>, test_setup_code string"
#: Fields of the third suite; a field counts as present if its key is, even with a null, so keys are looked up in the raw line.
_DS1000 = T.MapType(T.StringType(), T.StringType())


def humaneval(spark: SparkSession, path: str) -> DataFrame:
    """Problems in the order of the number in their id."""
    return spark.read.schema(HUMANEVAL).json(path).orderBy(F.split("task_id", "/")[1].cast("int"))


def mbpp(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MBPP).json(path).withColumn("test_setup_code", F.coalesce("test_setup_code", F.lit("")))


def _first_key(m: Column, *keys: str, default: Column | None = None) -> Column:
    """The value of the first key that is there (its null counts), else the default."""
    out = default if default is not None else F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.map_contains_key(m, k), m[k]).otherwise(out)
    return out


def ds1000(spark: SparkSession, path: str, library: str | None = None) -> DataFrame:
    """(id, prompt, reference_code, test_code, lib): the id falls back to the metadata's, the library to another name."""
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", _DS1000).alias("m"), "value")
    m = F.col("m")
    out = rows.select(
        _first_key(m, "id", default=F.get_json_object("value", "$.metadata.problem_id")).alias("id"),
        m["prompt"].alias("prompt"),
        _first_key(m, "reference_code", default=F.lit("")).alias("reference_code"),
        _first_key(m, "code_context", "test", default=F.lit("")).alias("test_code"),
        _first_key(m, "lib", "library", default=F.lit("Unknown")).alias("lib"),
    )
    return out if library is None else out.filter(F.lower("lib") == library.lower())


def bigcodebench(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, prompt, test, entry_point): the complete prompt is preferred where it is not empty."""
    rows = spark.read.schema("task_id string, prompt string, complete_prompt string, test string, entry_point string").json(path)
    return rows.select("task_id", F.coalesce(F.nullif("complete_prompt", F.lit("")), "prompt").alias("prompt"), "test", "entry_point")


def evalplus(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    if dataset not in ("humaneval", "mbpp"):
        raise ValueError(f"unknown dataset {dataset!r}")
    return spark.read.schema("task_id string, prompt string, entry_point string, canonical_solution string").json(path)


def samples(spark: SparkSession, path: str, key: str = "task_id") -> DataFrame:
    """(key STRING, completions): the samples of each problem as one list in the order of their texts."""
    raw = spark.read.schema(f"{key} string, completion string").json(path)
    return raw.groupBy(key).agg(F.array_sort(F.collect_list("completion")).alias("completions"))

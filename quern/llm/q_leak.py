"""Queries of problem 3."""

from pyspark.sql import functions as F

from quern.llm.common import table
from quern.llm.leak import leaks


def _items(spark, sf_dir):
    """The evaluation texts: two tables of fixed size."""
    humaneval = spark.read.parquet(f"{sf_dir}/humaneval_samples.parquet").select("task_id", "prompt").distinct().collect()
    mbpp = spark.read.parquet(f"{sf_dir}/mbpp.parquet").select(F.col("task_id").cast("string"), "text").distinct().collect()
    return [("humaneval", r[0], r[1]) for r in humaneval] + [("mbpp", r[0], r[1]) for r in mbpp]


def p3_leaks(spark, sf_dir):
    return leaks(table(spark, sf_dir, "stream_stack_all", "seq", "content"), _items(spark, sf_dir))


def p3_found(spark, sf_dir):
    return p3_leaks(spark, sf_dir).select("seq", "suite", "task_id")


def p3_tasks(spark, sf_dir):
    """Which items leaked, into how many files, and the most windows found in one file."""
    return p3_leaks(spark, sf_dir).groupBy("suite", "task_id").agg(F.count(F.lit(1)).alias("files"), F.max("shared").alias("most_shared"))


QUERIES = {"p3_found": p3_found, "p3_leaks": p3_leaks, "p3_tasks": p3_tasks}

_SHARED = r"""
with i as (select 'humaneval' as suite, task_id, prompt as t from humaneval_samples union select 'mbpp', cast(task_id as varchar), text from mbpp),
iw as (select suite, task_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') as w from i where t is not null),
ig as (select distinct suite, task_id, array_to_string(w[k:k+11], ' ') as g from (select suite, task_id, w, unnest(range(1, len(w) - 10)) as k from iw)),
cw as (select seq, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') as w from stream_stack_all where content is not null),
cg as (select distinct seq, array_to_string(w[k:k+11], ' ') as g from (select seq, w, unnest(range(1, len(w) - 10)) as k from cw)),
h as (select seq, suite, task_id, cast(count(*) as int) as shared from cg join ig using (g) group by 1, 2, 3)
"""

SQL = {
    "p3_found": _SHARED + "select seq, suite, task_id from h",
    "p3_leaks": _SHARED + "select seq, suite, task_id, shared from h",
    "p3_tasks": _SHARED + "select suite, task_id, count(*) as files, max(shared) as most_shared from h group by 1, 2",
}

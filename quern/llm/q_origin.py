"""Queries of problem 2."""

from pyspark.sql import functions as F

from quern.llm.common import table
from quern.llm.origin import verdicts


def p2_verdicts(spark, sf_dir):
    df = table(spark, sf_dir, "stream_stack_all", "seq", "content", "max_stars_repo_name", "max_stars_repo_path", "lang")
    return verdicts(df.filter(F.col("lang").isin("Python", "JavaScript"))).withColumnRenamed("id", "seq")


def p2_found(spark, sf_dir):
    return p2_verdicts(spark, sf_dir).select("seq")


QUERIES = {"p2_found": p2_found, "p2_verdicts": p2_verdicts}

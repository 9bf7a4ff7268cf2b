"""Queries of problem 4."""

from quern.llm.common import table
from quern.llm.parsecheck import failures, rates


def p4_found(spark, sf_dir):
    return p4_failures(spark, sf_dir).select("seq")


def p4_failures(spark, sf_dir):
    return failures(table(spark, sf_dir, "stream_stack_all", "seq", "content", "lang"))


def p4_rates(spark, sf_dir):
    return rates(table(spark, sf_dir, "stream_stack_all", "seq", "content", "lang", "max_stars_repo_name"))


QUERIES = {"p4_found": p4_found, "p4_failures": p4_failures, "p4_rates": p4_rates}

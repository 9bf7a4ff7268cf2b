"""Queries of problem 8."""

from quern.llm.common import table
from quern.llm.encode import count_tokens
from quern.llm.pack import fill, summary


def p8_packed(spark, sf_dir):
    return fill(count_tokens(table(spark, sf_dir, "documents", "doc_id", "text")))


def p8_fill(spark, sf_dir):
    return summary(p8_packed(spark, sf_dir))


QUERIES = {"p8_packed": p8_packed, "p8_fill": p8_fill}

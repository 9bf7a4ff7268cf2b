"""Queries of problem 7."""

from quern.llm.common import table
from quern.llm.encode import count_tokens, encode_corpus


def p7_ids(spark, sf_dir):
    return encode_corpus(table(spark, sf_dir, "documents", "doc_id", "text"))


def p7_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"p7_ids": p7_ids, "p7_counts": p7_counts}

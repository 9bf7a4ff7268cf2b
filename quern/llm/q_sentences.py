"""Queries of problem 9."""

from quern.llm.common import table
from quern.llm.sentences import sentence_ends, sentence_units


def p9_found(spark, sf_dir):
    return sentence_ends(table(spark, sf_dir, "documents", "doc_id", "text"))


def p9_units(spark, sf_dir):
    return sentence_units(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"p9_found": p9_found, "p9_units": p9_units}

"""Queries of problem 6."""

from quern.llm.common import table
from quern.llm.secrets import redacted, secret_lines

_TABLES = (("stream_stack_all", "seq"), ("fetch_repo_py_files", "file_seq"))


def _both(operator, spark, sf_dir):
    a, b = (operator(table(spark, sf_dir, name, key, "content"), name, key) for name, key in _TABLES)
    return a.unionByName(b)


def p6_found(spark, sf_dir):
    return _both(secret_lines, spark, sf_dir)


def p6_redacted(spark, sf_dir):
    return _both(redacted, spark, sf_dir)


QUERIES = {"p6_found": p6_found, "p6_redacted": p6_redacted}

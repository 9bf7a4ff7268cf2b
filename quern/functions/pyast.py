"""Syntax-tree features of Python sources: one parse a row gives all of them."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("has_docstring", T.BooleanType()), T.StructField("cyclomatic", T.DoubleType()), T.StructField("max_nesting", T.IntegerType()), T.StructField("unique_identifiers", T.IntegerType()), T.StructField("error", T.StringType())])
_FAILURES = (SyntaxError, ValueError, RecursionError, MemoryError)
_BRANCHES = frozenset((ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With, ast.Assert, ast.comprehension))
_FUNCTIONS = frozenset((ast.FunctionDef, ast.AsyncFunctionDef))
_DOCUMENTED = _FUNCTIONS | {ast.ClassDef}
_SCOPES = _DOCUMENTED | {ast.If, ast.For, ast.While, ast.With, ast.Try}
#: Fields that hold no nodes worth a visit.
_PLAIN = frozenset("ctx op ops id attr arg name names level module type_comment kind value_kind asname simple is_async lineno rest".split())


class _Fields(dict):
    """Node type -> its fields that can hold other nodes."""

    def __missing__(self, kind: type) -> tuple[str, ...]:
        self[kind] = got = () if kind in (ast.Constant, ast.Pass, ast.alias) else tuple(f for f in kind._fields if f not in _PLAIN)
        return got


_CHILDREN = _Fields()


def features(source: str | None) -> tuple:
    """(ok, has_docstring, cyclomatic, max_nesting, unique_identifiers, error).

    Complexity is one plus branches over functions (half the branches without functions), nesting counts the scopes from
    the module down, identifiers are distinct names read or written. What does not parse has complexity 1, nesting 0 and
    no names; a null source gives nulls."""
    if source is None:
        return None, None, None, None, None, None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except _FAILURES as e:
        return False, False, 1.0, 0, 0, type(e).__name__
    branches = functions = deepest = 0
    names: set[str] = set()
    documented = bool(ast.get_docstring(tree))
    todo: list[tuple[ast.AST, int]] = [(tree, 0)]
    while todo:  # an explicit stack: depth is not bounded by the interpreter's
        node, depth = todo.pop()
        kind = type(node)
        if kind is ast.Name:
            names.add(node.id)
            continue
        if kind in _SCOPES:
            depth += 1
            if depth > deepest:
                deepest = depth
            if kind in _FUNCTIONS:
                functions += 1
            if not documented and kind in _DOCUMENTED:
                documented = bool(ast.get_docstring(node))
        if kind in _BRANCHES:
            branches += 1
        for field in _CHILDREN[kind]:
            v = getattr(node, field, None)
            if v.__class__ is list:
                for x in v:
                    if isinstance(x, ast.AST):
                        todo.append((x, depth))
            elif isinstance(v, ast.AST):
                todo.append((v, depth))
    cyclomatic = 1.0 + (branches / functions if functions else branches * 0.5)
    return True, documented, cyclomatic, deepest, len(names), None


@F.pandas_udf(SCHEMA)
def python_features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([features(t) for t in s], columns=SCHEMA.names).astype({"max_nesting": "Int32", "unique_identifiers": "Int32", "ok": "boolean", "has_docstring": "boolean"})


def composite(cyclomatic: Column, nesting: Column, identifiers: Column) -> Column:
    """0.5 complexity + 0.3 nesting + 0.2 twentieths of the identifiers (fixed weights)."""
    return F.lit(0.5) * cyclomatic + F.lit(0.3) * nesting + F.lit(0.2) * (identifiers / F.lit(20.0))

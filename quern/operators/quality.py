"""The quality cascade: each predicate is a flag, the first that fails is the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.pyast import python_features
from quern.functions.text import line_stats, newline_count

#: Thresholds (fixed values).
MIN_CHARS, MIN_LINES, MAX_LINE, MAX_LONG, MIN_COMMENTS, MAX_COMMENTS = 100, 5, 1000, 0.2, 0.01, 0.80


def long_enough(c: str) -> Column:
    return (F.length(c) >= MIN_CHARS) & (newline_count(c) >= MIN_LINES)


def line_lengths_ok(stats: Column, share: float = MAX_LONG) -> Column:
    """Of line_stats: at most the share of the lines is too long; a text without lines fails."""
    return (stats["lines"] > 0) & (stats["long"] / F.greatest(stats["lines"], F.lit(1)) <= F.lit(share))


def comment_ratio_ok(stats: Column, least: float = MIN_COMMENTS, most: float = MAX_COMMENTS) -> Column:
    """Of line_stats: the share of comments among the lines that are not blank; a text without such lines fails."""
    ratio = stats["marked"] / F.greatest(stats["solid"], F.lit(1))
    return (stats["solid"] > 0) & (ratio >= F.lit(least)) & (ratio <= F.lit(most))


def with_cheap_reason(df: DataFrame, c: str, out: str = "reason") -> DataFrame:
    """df with the first cheap predicate that fails, or 'passed'. Lines are counted for texts that are long enough only;
    a null text fails by length."""
    long = F.coalesce(long_enough(c), F.lit(False))
    rows = df.withColumn("_lines", line_stats(F.when(long, F.col(c)), MAX_LINE))
    reason = F.when(~long, "length").when(~line_lengths_ok(F.col("_lines")), "line_length").when(~comment_ratio_ok(F.col("_lines")), "comment_ratio").otherwise("passed")
    return rows.withColumn(out, reason).drop("_lines")


def cascade(df: DataFrame, text: str = "content", tag: str | None = None) -> DataFrame:
    """df with reason: length, line_length, comment_ratio, syntax, docstring or passed.

    Only rows that pass the cheap predicates are parsed: the parser gets a null for the others. A docstring is required
    of every row, or of those tagged stack where a tag column is named. A null text fails by length."""
    out = with_cheap_reason(df, text, "_cheap")
    out = out.withColumn("_ast", python_features(F.when(F.col("_cheap") == "passed", F.col(text))))
    needs = F.lit(True) if tag is None else F.coalesce(F.col(tag) == "stack", F.lit(False))
    reason = F.when(F.col("_cheap") != "passed", F.col("_cheap")).when(~F.col("_ast.ok"), "syntax").when(needs & ~F.col("_ast.has_docstring"), "docstring").otherwise("passed")
    return out.withColumn("reason", reason).drop("_cheap", "_ast")


def counters(reasons: DataFrame) -> DataFrame:
    """(reason, n, share of all in per cent)."""
    by = reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))  # a row a reason
    return by.select("reason", "n", (F.col("n") * F.lit(100.0) / F.greatest(total, F.lit(1))).alias("pct"))

"""Accepted question-and-answer documents from a stream of posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The document template (fixed value).
QUESTION, ANSWER = "Question:\n", "\n\nAnswer:\n"


def is_question(min_score: int = 5, tag: str = "python") -> Column:
    """A question with an accepted answer, a score (null counts 0) and a tag that contains the word, and a body."""
    tagged = F.coalesce(F.exists("Tags", lambda t: F.coalesce(F.lower(t).contains(tag), F.lit(False))), F.lit(False))
    return (F.col("PostTypeId") == 1) & (F.coalesce("Score", F.lit(0)) >= min_score) & F.col("AcceptedAnswerId").isNotNull() & tagged & (F.coalesce("Body", F.lit("")) != "")


def is_answer() -> Column:
    return (F.col("PostTypeId") == 2) & (F.coalesce("Body", F.lit("")) != "")


def accepted_pairs(posts: DataFrame, value: Column | None = None, **question) -> DataFrame:
    """(seq, answer_id, question, answer) of every delivered accepted answer.

    Of the questions that name the same answer the last in delivery order counts; an answer delivered twice gives two
    rows. The value taken of either body is the body itself unless another expression over Body is given (its length, for
    instance, which keeps the bodies out of the shuffle). The build side is reduced to one row a key before the join."""
    value = F.col("Body") if value is None else value
    asked = posts.filter(is_question(**question)).select(F.col("AcceptedAnswerId").alias("answer_id"), "seq", value.alias("v"))
    asked = asked.groupBy("answer_id").agg(F.max_by("v", "seq").alias("question"))
    given = posts.filter(is_answer()).select("seq", F.col("Id").alias("answer_id"), value.alias("answer"))
    return given.join(asked, "answer_id").select("seq", "answer_id", "question", "answer")


def documents(pairs: DataFrame) -> DataFrame:
    """(seq, text): the pairs in their template."""
    return pairs.select("seq", F.concat(F.lit(QUESTION), "question", F.lit(ANSWER), "answer").alias("text"))

"""Arithmetic on arrays of logits and states, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once a row: a lambda variable holds it wherever the body uses it."""
    return F.transform(F.array(value), body)[0]


def softmax(v: Column, temperature: float = 1.0) -> Column:
    def exps(s: Column) -> Column:
        return F.transform(s["v"], lambda x: F.exp((x - s["top"]) / F.lit(temperature)))

    shifted = bound(F.struct(v.alias("v"), F.array_max(v).alias("top")), exps)
    return bound(shifted, lambda e: bound(F.struct(e.alias("e"), total(e).alias("sum")), lambda s: F.transform(s["e"], lambda x: x / s["sum"])))


def argmax(v: Column) -> Column:
    """0-based place of the greatest value, the first of equal ones."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def logsumexp(v: Column) -> Column:
    return bound(F.struct(v.alias("v"), F.array_max(v).alias("top")), lambda s: F.log(F.aggregate(s["v"], F.lit(0.0), lambda a, x: a + F.exp(x - s["top"]))) + s["top"])


def cross_entropy(v: Column, target: Column) -> Column:
    return logsumexp(v) - F.element_at(v, target.cast("int") + 1)


def rms_norm(v: Column, eps: float = 1e-6) -> Column:
    scale = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) / F.size(v) + F.lit(eps))
    return bound(F.struct(v.alias("v"), scale.alias("scale")), lambda s: F.transform(s["v"], lambda x: x / s["scale"]))


def silu(x: Column) -> Column:
    return x / (F.lit(1.0) + F.exp(-x))


def rope(v: Column, position: Column, base: float = 10000.0) -> Column:
    """The halves of the vector rotated as pairs by position / base^(2 i / d)."""
    half = F.size(v) / 2
    def turn(x: Column, i: Column) -> Column:
        j = (i % half).cast("int")
        angle = position / F.pow(F.lit(base), j * F.lit(2.0) / F.size(v))
        other = F.when(i < half, -F.element_at(v, (j + half + 1).cast("int"))).otherwise(F.element_at(v, j + 1))
        return x * F.cos(angle) + other * F.sin(angle)
    return F.transform(v, turn)

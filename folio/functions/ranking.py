"""Expressions on score vectors; all are narrow and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bound(value: Column, use) -> Column:
    """use(value), with the value worked out once for all that a lambda in it does."""
    return F.element_at(F.transform(F.array(value), use), 1)


def softmax(logits: Column) -> Column:
    powers = _bound(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda a, b: a + b)
    return _bound(powers, lambda w: _bound(total(w), lambda s: F.transform(w, lambda x: x / s)))


def ranked(p: Column) -> Column:
    """array<struct<confianca, idx>>: largest first, of equal ones the larger index first."""
    pairs = F.transform(p, lambda x, i: F.struct(x.cast("double").alias("confianca"), i.alias("idx")))
    return F.reverse(F.array_sort(pairs))


def top_k(p: Column, k: int = 3) -> Column:
    return F.slice(ranked(p), 1, k)


def argmax(p: Column) -> Column:
    """Index of the largest value, of equal ones the smallest; null for an empty vector."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")

"""Expressions over arrays of numbers, summed in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if the dimensions differ or a vector is zero."""
    whole = F.size(a) == F.size(b)
    return F.when(whole & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def unit(a: Column) -> Column:
    """The vector over its length plus 1e-8."""
    return F.transform(_double(a), lambda x: x / (norm(a) + 1e-8))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(_double(a), _double(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(_double(a), _double(b), lambda x, y: x - y)


def scale(a: Column, by: Column) -> Column:
    return F.transform(_double(a), lambda x: x * by)


def constant(values: list[float]) -> Column:
    """A vector known when the query is made."""
    return F.array(*(F.lit(float(v)) for v in values))


def sign_lanes(v: Column, dim: int) -> Column:
    """The sign code of a vector: a bit for each v >= 0, 32 a lane, as longs (the last lane filled up with zeros)."""
    lanes = [F.aggregate(F.transform(F.slice(_double(v), 1 + 32 * k, min(32, dim - 32 * k)), lambda x, i: F.when(x >= 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x) for k in range((dim + 31) // 32)]
    return F.array(*lanes)


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two sign codes differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def log_likelihood(p: Column, seed: Column) -> Column:
    """The cross-entropy score of a distribution under a seed one: sum of log(p + 1e-12) times seed."""
    return F.aggregate(F.zip_with(_double(p), _double(seed), lambda x, y: F.log(x + 1e-12) * y), F.lit(0.0), lambda s, x: s + x)


def max_similarity(a: Column, b: Column) -> Column:
    """The largest dot product between the vectors of two arrays of vectors."""
    return F.array_max(F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: dot(x, y)))))


def chamfer(a: Column, b: Column) -> Column:
    """The mean over the vectors of a of their largest dot product with one of b."""
    best = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: dot(x, y))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(a)

"""Operators of score channels by name, and the library's functions for Spark SQL.

A channel's operator is declared with its table, so a search knows how to score
it without knowing its name; new ones are registered here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.vectors import constant, cosine, dot, log_likelihood
from tidemark.sources.store import Table

Operator = Callable[[Column, Column], Column]
_OPERATORS: dict[str, Operator] = {"cosine": dot, "crossent": log_likelihood, "angle": cosine}

#: SQL functions over arrays of numbers, which Catalyst puts in place of their calls; null where dimensions differ.
SQL_FUNCTIONS = {
    "vector_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(a) = size(b) THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) END"),
    "vector_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "vector_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "vector_dot(a, b) / nullif(vector_norm(a) * vector_norm(b), 0D)"),
    "overlaps": ("t0 BIGINT, t1 BIGINT, lo BIGINT, hi BIGINT", "BOOLEAN", "coalesce(t1, t0) >= lo AND t0 <= hi"),
}


def register_operator(name: str, operator: Operator) -> None:
    """Make an operator (row vector, query vector) -> score known by a name; a known one is replaced."""
    _OPERATORS[name] = operator


def operators() -> list[str]:
    return sorted(_OPERATORS)


def operator_of(table: Table) -> str:
    """The operator that a channel's table declares in its notes; cosine without any."""
    return table.version().notes.get("op", "cosine")


def channel_score(table: Table, vector: str, query: list[float], out: str = "score") -> DataFrame:
    """A channel's rows with their score by its own operator."""
    name = operator_of(table)
    if name not in _OPERATORS:
        raise KeyError(f"there is no operator {name}; known are {', '.join(operators())}")
    return table.dataframe().withColumn(out, _OPERATORS[name](F.col(vector), constant(query)))


def register_sql(spark: SparkSession) -> list[str]:
    """Make the functions known to a session's SQL; their names."""
    for name, (arguments, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(SQL_FUNCTIONS)

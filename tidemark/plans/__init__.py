"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.vectors import top_k
from tidemark.operators.windows import tumbling
from tidemark.plans import composed, evidence, ranks, relational, storage, times, vectors
from tidemark.plans.common import NS, T0, T1, event_store

_MODULES = (storage, times, vectors, ranks, composed, evidence, relational)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """A store of three commits, a pinned snapshot, a time window, pooled windows of each stream, and the best of them."""
    own = event_store(spark, folder)
    found, _ = own.window(T0, T1 + 3 * (T1 - T0), version=own.snapshot())
    pooled = tumbling(found["events"], 6 * 3600 * NS, ["stream"], {"rows": F.count(F.lit(1)), "score": F.avg("value")})
    return top_k(pooled, "score", 20, "start")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in _MODULES for name, (_, text) in m.QUERIES.items() if text is not None}

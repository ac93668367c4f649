"""What the registered queries share: the driver's tables in the shapes that the operators read, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import new_folder, table
from tidemark.sources.store import Store

NS = 1_000_000_000
DAY = 86_400 * NS
#: 2024-01-05 00:00 UTC and a day later, in nanoseconds.
T0 = 1_704_412_800 * NS
T1 = T0 + DAY

EV = "ev AS (SELECT event_id, event_type AS stream, user_id, epoch_us(ts) * 1000 AS ts, value FROM events)"
IV = EV + ", iv AS (SELECT event_id, user_id, stream, ts, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1, ts) AS t1, value FROM ev)"
DOT = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as samples: event_id, stream, user_id, ts in nanoseconds, value."""
    return table(spark, folder, "events").select("event_id", F.col("event_type").alias("stream"), "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts"), "value")


def intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Events as intervals up to the user's next one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, folder).withColumn("t1", F.coalesce(F.lead("ts").over(w) - 1, F.col("ts"))).select("event_id", "user_id", "stream", "ts", "t1", "value")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


def vector_of(spark: SparkSession, folder: str, vec_id: int) -> list[float]:
    """One query vector."""
    row = embeddings(spark, folder).where(F.col("vec_id") == vec_id).first()
    return list(row["embedding"]) if row else [0.0] * 64


def store(spark: SparkSession) -> Store:
    """A fresh store in the shared folder."""
    return Store.create(spark, new_folder(spark, "store"), "queries")


def event_store(spark: SparkSession, folder: str, parts: int = 3) -> Store:
    """A store whose table `events` got the events in commits by event id."""
    own = store(spark)
    ev = events(spark, folder)
    for k in range(parts):
        own.table("events").append(ev.where(F.col("event_id") % parts == k), kind="timeseries")
    return own

"""Streams into stores, sliding spans and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.store import Store


def append_stream(stream: DataFrame, store: Store, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to a table, a commit a batch; a batch that was committed before a failure is not appended again."""
    own = store.table(table)

    def one(batch: DataFrame, number: int) -> None:
        if own.version().notes.get(f"batch:{checkpoint}", -1) >= number or batch.isEmpty():
            return
        own.append(batch, evolve=True, notes={f"batch:{checkpoint}": number})

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def spans(stream: DataFrame, at: str, by: list[str], aggs: dict[str, Column], width: str = "15 seconds", stride: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Sliding windows of a stream, given out once no more rows can come: rows later than `late` are left out."""
    w = F.window(at, width, stride)
    return stream.withWatermark(at, late).groupBy(*by, w).agg(F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in aggs.items())).select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "rows", *aggs)


def stream_sessions(stream: DataFrame, at: str, by: list[str], gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Sessions of a stream, ended by a gap."""
    s = F.session_window(at, gap)
    return stream.withWatermark(at, late).groupBy(*by, s).agg(F.count(F.lit(1)).alias("rows")).select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "rows")

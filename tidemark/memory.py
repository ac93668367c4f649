"""A memory of recordings: sequences of descriptors in a store, searched by warping a query against a shortlist."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sequences import arc_resample, unit_rows, warp_search
from tidemark.sources.store import Store

TABLE = "traces"


class Memory:
    """Recordings by name; a step of a recording is a row of numbers, and seconds_per_step its pace."""

    def __init__(self, store: Store, seconds_per_step: float = 1.0):
        self.store, self.pace = store, seconds_per_step

    @classmethod
    def open(cls, spark: SparkSession, path: str, seconds_per_step: float = 1.0) -> Memory:
        """The memory at a path, made if there is none."""
        try:
            return cls(Store.create(spark, path, "memory"), seconds_per_step)
        except FileExistsError:
            return cls(Store.open(spark, path), seconds_per_step)

    def add(self, recordings: DataFrame, recording: str = "recording", trace: str = "trace") -> int:
        """Add recordings (name, array of arrays of numbers) that are new by name; how many were added."""
        own = recordings.select(F.lit(0).cast("long").alias("ts"), F.col(recording).alias("recording"), F.col(trace).cast("array<array<double>>").alias("trace")).where(F.size("trace") > 0).dropDuplicates(["recording"])
        table = self.store.table(TABLE)
        if TABLE in self.store.tables():
            own = own.join(table.dataframe().select("recording"), "recording", "left_anti").select("ts", "recording", "trace")
        before = table.version().total("rows")
        if own.isEmpty():
            return 0
        return table.append(own, kind="embeddings").total("rows") - before

    def recordings(self) -> DataFrame:
        return self.store.table(TABLE).dataframe().select("recording", F.size("trace").alias("steps"))

    def query(self, clip: list[list[float]], k: int = 10, shortlist: int = 100, band: float = 0.25, resample: float | None = None, leave_out: str | None = None) -> DataFrame:
        """The k best recordings: score, and the span of each that matches in seconds."""
        x = np.asarray(clip, dtype=float)
        if resample:
            x, _ = arc_resample(x, np.r_[0.0, np.linalg.norm(np.diff(unit_rows(x), axis=0), axis=1)], resample)
        rows = self.store.table(TABLE).dataframe().select("recording", "trace")
        if leave_out is not None:
            rows = rows.where(F.col("recording") != leave_out)
        found = warp_search(rows, "recording", "trace", x, k, shortlist, band)
        return found.select("recording", "score", (F.col("start") * self.pace).alias("t0"), (F.col("end") * self.pace).alias("t1"))

    def query_recording(self, recording: str, k: int = 10, **options: object) -> DataFrame:
        """Recordings like one of the memory's own, itself left out."""
        row = self.store.table(TABLE).dataframe().where(F.col("recording") == recording).select("trace").first()
        if row is None:
            raise KeyError(recording)
        return self.query(row["trace"], k, leave_out=recording, **options)

    def stats(self) -> dict[str, int]:
        own = self.store.table(TABLE).version()
        return {"recordings": own.total("rows"), "bytes": own.total("size"), "version": own.number}

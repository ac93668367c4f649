"""Windows over streams: tumbling, pooled, sliding, multi-scale, incremental, and sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import floor_div, floor_to


def _aggregates(aggs: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in aggs.items()]


def tumbling(df: DataFrame, width: int, by: list[str], aggs: dict[str, Column], at: str = "ts") -> DataFrame:
    """Windows that start at multiples of the width and end at their last instant, or at the stream's last row before it."""
    start = floor_to(F.col(at), width)
    last = df.groupBy(*by).agg(F.max(at).alias("__last"))
    out = df.groupBy(*by, start.alias("start")).agg(*_aggregates(aggs))
    return out.join(last, by).withColumn("end", F.least(F.col("start") + (width - 1), F.col("__last"))).drop("__last")


def sliding(df: DataFrame, width: int, stride: int, by: list[str], aggs: dict[str, Column], at: str = "ts", min_rows: int = 1, align: str = "first") -> DataFrame:
    """Windows [start, start + width) every stride from each stream's first row (or from 0), those of min_rows rows at least.

    A row is dealt to the width / stride windows that hold it before rows are
    pooled, so partial sums shrink them ahead of the shuffle.  The last window
    starts half a width before the stream's end at the latest.
    """
    origin = df.groupBy(*by).agg(F.min(at).alias("__first"), F.max(at).alias("__last"))
    own = df.join(origin, by)
    base = F.col("__first") if align == "first" else F.lit(0)
    past = F.col(at) - base
    high = floor_div(past, stride)
    low = floor_div(past - width, stride) + 1
    low = F.greatest(low, F.lit(0)) if align == "first" else low
    dealt = own.select("*", F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("__k")).withColumn("start", (base + F.col("__k") * stride).cast("long"))
    if align == "first":
        dealt = dealt.where((F.col("start") <= F.col("__last") - width // 2) | (F.col("__k") == 0))
    return dealt.groupBy(*by, "start").agg(F.count(F.lit(1)).alias("rows"), *_aggregates(aggs)).where(F.col("rows") >= min_rows).withColumn("end", F.col("start") + width)


def multiscale(df: DataFrame, widths: list[int], by: list[str], at: str = "ts") -> DataFrame:
    """The grid of windows of each width, half a width apart, within each stream's extent: width, start, end."""
    extent = df.groupBy(*by).agg(F.min(at).alias("__a"), F.max(at).alias("__b"))
    one = lambda w: extent.where(F.col("__a") + w <= F.col("__b")).select(*by, F.lit(w).cast("long").alias("width"), F.explode(F.sequence(F.col("__a"), F.col("__b") - w, F.lit(w // 2).cast("long"))).alias("start"))
    return reduce(DataFrame.unionByName, map(one, widths)).withColumn("end", F.col("start") + F.col("width"))


def capped(df: DataFrame, by: list[str], most: int, order: str = "ts") -> DataFrame:
    """At most `most` rows of each group, evenly spaced by place, first and last among them."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("__k", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    chosen = F.floor(F.col("__k") * F.lit(float(most - 1)) / (F.col("__n") - 1)) != F.floor((F.col("__k") - 1) * F.lit(float(most - 1)) / (F.col("__n") - 1))
    return ranked.where((F.col("__n") <= most) | (F.col("__k") == 0) | chosen).drop("__k", "__n")


def incremental(df: DataFrame, done: DataFrame, width: int, by: list[str], aggs: dict[str, Column], at: str = "ts", done_until: str = "end") -> DataFrame:
    """Tumbling windows that start at or after the end of what each stream has already: `done` holds windows made before."""
    mark = done.groupBy(*by).agg(F.max(done_until).alias("__mark"))
    fresh = df.join(mark, by, "left").where(F.col("__mark").isNull() | (floor_to(F.col(at), width) > F.col("__mark")))
    return tumbling(fresh.drop("__mark"), width, by, aggs, at)


def sessions(df: DataFrame, gap: int, by: list[str], aggs: dict[str, Column], at: str = "ts") -> DataFrame:
    """Runs of rows whose neighbours are at most `gap` apart: session number from 1, start, end, rows."""
    w = Window.partitionBy(*by).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    numbered = df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return numbered.groupBy(*by, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("rows"), *_aggregates(aggs))


def segments(scored: DataFrame, stream: str = "stream", start: str = "start", end: str = "end", score: str = "score", share: float = 0.55) -> DataFrame:
    """Windows that score at least median + share x (maximum - median), joined across gaps of a usual window: start, end, best, mean, windows.

    The gap is the whole part of the median window length plus 1.  The two
    statistics of the whole table are one row, joined by broadcast.
    """
    stats = scored.agg(F.percentile(score, 0.5).alias("__m"), F.max(score).alias("__x"), (F.percentile(F.col(end) - F.col(start), 0.5).cast("long") + 1).alias("__gap"))
    kept = scored.crossJoin(F.broadcast(stats)).where(F.col(score) >= F.col("__m") + share * (F.col("__x") - F.col("__m")))
    w = Window.partitionBy(stream).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = kept.withColumn("__new", F.when(F.col(start) - reach <= F.col("__gap"), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(stream, "__run").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.max(score).alias("best"), F.avg(score).alias("mean"), F.count(F.lit(1)).alias("windows")).drop("__run")


def deltas(df: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """Differences to the row before in each stream, and the length of the step through all values."""
    w = Window.partitionBy(*by).orderBy(order)
    out = df.select("*", *((F.col(v) - F.lag(v).over(w)).alias(f"d_{v}") for v in values))
    return out.withColumn("step", F.sqrt(sum((F.col(f"d_{v}") * F.col(f"d_{v}") for v in values), F.lit(0.0))))


def arc_length(df: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """The running sum of steps along each stream."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return deltas(df, by, order, values).withColumn("arc", F.sum(F.coalesce("step", F.lit(0.0))).over(w))


def edge_delta(df: DataFrame, by: list[str], at: str, value: str, edge: int) -> DataFrame:
    """The mean of the last `edge` of each stream minus that of the first."""
    w = Window.partitionBy(*by)
    own = df.withColumn("__a", F.min(at).over(w)).withColumn("__b", F.max(at).over(w))
    first = F.avg(F.when(F.col(at) <= F.col("__a") + edge, F.col(value)))
    last = F.avg(F.when(F.col(at) >= F.col("__b") - edge, F.col(value)))
    return own.groupBy(*by).agg((last - first).alias("delta"))


def novelty(df: DataFrame, by: list[str], order: str, value: str, k: int = 3) -> DataFrame:
    """How far each value is from the one before, from the mean of k before, from their extrapolation, and the means before from after."""
    w = Window.partitionBy(*by).orderBy(order)
    before, after = F.avg(value).over(w.rowsBetween(-k, -1)), F.avg(value).over(w.rowsBetween(1, k))
    one, two = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    return df.select("*", F.abs(F.col(value) - one).alias("adjacent"), F.abs(F.col(value) - before).alias("hist_mean"), F.abs(F.col(value) - (2 * one - two)).alias("extrap"), F.abs(after - before).alias("two_sided"))

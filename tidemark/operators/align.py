"""Alignment of samples to timelines: as-of joins, resampling, and clock models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.time import floor_div


def timeline(spark: SparkSession, t0: int, t1: int, rate_hz: float, drift_free: bool = False) -> DataFrame:
    """Points ts from t0 to t1: steps of whole nanoseconds, or each point rounded by itself so no error adds up."""
    if rate_hz <= 0 or t1 < t0:
        return spark.range(0).select(F.col("id").alias("ts"))
    if drift_free:
        n = int((t1 - t0) * rate_hz / 1e9) + 1
        return spark.range(n).select((F.lit(t0) + F.floor(F.col("id") * (1e9 / rate_hz) + 0.5)).cast("long").alias("ts"))
    step = int(1e9 / rate_hz)
    return spark.range((t1 - t0) // step + 1).select((F.lit(t0) + F.col("id") * step).alias("ts"))


def neighbours(probes: DataFrame, samples: DataFrame, by: list[str], values: list[str], at: str = "ts", bucket: int | None = None) -> DataFrame:
    """Each probe with the last sample at or before it (prev_ts, prev_<value>) and the first at or after it (next_...).

    One sort by stream and time; of samples with equal times the one with the
    largest values counts.  Columns of probes other than `by` and time are kept.
    bucket: a length of time by which streams are cut before the sort, for
    streams that are too long for one task; the last and first sample of each
    bucket are then carried across buckets, a row for each bucket that is in use.
    """
    rest = [c for c in probes.columns if c not in (*by, at)]
    pack = F.struct(F.col(at).alias("ts"), *(F.col(v) for v in values))
    kind = samples.select(pack.alias("x")).schema["x"].dataType
    a = probes.select(*by, at, *rest, F.lit(None).cast(kind).alias("__s"))
    b = samples.select(*by, at, *(F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in rest), pack.alias("__s"))
    both = a.withColumn("__probe", F.lit(True)).unionByName(b.withColumn("__probe", F.lit(False)))
    keys = list(by)
    if bucket is not None:
        both = both.withColumn("__bucket", floor_div(F.col(at), bucket))
        keys.append("__bucket")
    w = Window.partitionBy(*keys)
    back = F.last("__s", ignorenulls=True).over(w.orderBy(at, F.col("__probe"), "__s").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("__s", ignorenulls=True).over(w.orderBy(F.col(at).desc(), F.col("__probe"), "__s").rowsBetween(Window.unboundedPreceding, 0))
    out = both.select("*", back.alias("__b"), ahead.alias("__a")).where("__probe")
    if bucket is not None:
        # of the first time in a bucket the largest values count, as within it
        low = both.where("not __probe").groupBy(*keys).agg(F.min(at).alias("__first"))
        first = both.where("not __probe").join(low, keys).where(F.col(at) == F.col("__first")).groupBy(*keys).agg(F.max("__s").alias("__f"))
        per = both.groupBy(*keys).agg(F.max("__s").alias("__l")).join(first, keys, "left")
        order = Window.partitionBy(*by).orderBy("__bucket")
        carried = per.select(*keys, F.last("__l", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__cb"), F.first("__f", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__ca"))
        out = out.join(carried, keys).withColumn("__b", F.coalesce("__b", "__cb")).withColumn("__a", F.coalesce("__a", "__ca"))
    named = [F.col(f"{s}.{c}").alias(f"{p}_{c}") for p, s in (("prev", "__b"), ("next", "__a")) for c in ("ts", *values)]
    return out.select(*by, at, *rest, *named)


def asof(probes: DataFrame, samples: DataFrame, by: list[str], values: list[str], direction: str = "nearest", at: str = "ts", bucket: int | None = None) -> DataFrame:
    """Each probe with the values of one sample of its stream: backward, forward or nearest (a tie goes to the earlier); null without any."""
    both = neighbours(probes, samples, by, values, at, bucket)
    rest = [c for c in probes.columns if c not in (*by, at)]
    early = {"backward": F.lit(True), "forward": F.lit(False)}.get(direction, F.col("next_ts").isNull() | F.col("prev_ts").isNotNull() & (F.col(at) - F.col("prev_ts") <= F.col("next_ts") - F.col(at)))
    return both.select(*by, at, *rest, *(F.when(early, F.col(f"prev_{v}")).otherwise(F.col(f"next_{v}")).alias(v) for v in ("ts", *values) if v != "ts"), F.when(early, F.col("prev_ts")).otherwise(F.col("next_ts")).alias("sample_ts"))


def linear(probes: DataFrame, samples: DataFrame, by: list[str], values: list[str], at: str = "ts", bucket: int | None = None) -> DataFrame:
    """Each probe with values interpolated between its neighbours; the first and last samples are held outward."""
    both = neighbours(probes, samples, by, values, at, bucket)
    rest = [c for c in probes.columns if c not in (*by, at)]
    share = (F.col(at) - F.col("prev_ts")).cast("double") / (F.col("next_ts") - F.col("prev_ts"))
    between = lambda v: F.when(F.col("prev_ts").isNull(), F.col(f"next_{v}")).when(F.col("next_ts").isNull() | (F.col("next_ts") == F.col("prev_ts")), F.col(f"prev_{v}")).otherwise(F.col(f"prev_{v}") + share * (F.col(f"next_{v}") - F.col(f"prev_{v}")))
    return both.select(*by, at, *rest, *(between(v).cast("double").alias(v) for v in values))


def aligned(samples: DataFrame, t0: int, t1: int, rate_hz: float, values: list[str], by: list[str], interp: str = "nearest", edge_guard_s: float = 1.0) -> DataFrame:
    """Every stream's values at the points of one timeline; only samples within the guard of [t0, t1] are looked at."""
    guard = int(edge_guard_s * 1e9)
    near = samples.where(F.col("ts").between(t0 - guard, t1 + guard))
    streams = near.select(*by).distinct()
    probes = streams.crossJoin(timeline(samples.sparkSession, t0, t1, rate_hz)) if by else timeline(samples.sparkSession, t0, t1, rate_hz)
    return (linear if interp == "linear" else asof)(probes, near, by, values)


def clock_fit(pairs: DataFrame, sensor: str, tick: str, time: str) -> DataFrame:
    """Per sensor: rate (ns a tick), the upper median of the offsets, and pairs; sensors with fewer than two are left out."""
    fit = pairs.groupBy(sensor).agg(F.regr_slope(F.col(time).cast("double"), F.col(tick).cast("double")).alias("rate"), F.count(F.lit(1)).alias("pairs")).where("pairs >= 2")
    off = pairs.join(fit, sensor).withColumn("__o", F.col(time) - F.col("rate") * F.col(tick))
    w = Window.partitionBy(sensor).orderBy("__o")
    middle = off.withColumn("__k", F.row_number().over(w) - 1).where(F.col("__k") == F.floor(F.col("pairs") / 2))
    return middle.select(sensor, "rate", F.col("__o").alias("offset"), "pairs")


def joint_rate(fits: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """The rate of all sensors, weighted by pairs, and whether none differs by more than the tolerance."""
    mean = fits.agg((F.sum(F.col("rate") * F.col("pairs")) / F.sum("pairs")).alias("joint_rate"))
    return fits.crossJoin(F.broadcast(mean)).groupBy("joint_rate").agg((F.max(F.abs(F.col("rate") / F.col("joint_rate") - 1)) <= tolerance).alias("agree"), F.count(F.lit(1)).alias("sensors"))


def fixed_length(df: DataFrame, by: list[str], order: str, length: int) -> DataFrame:
    """`length` rows of each stream at evenly spaced places (rounded half to even), some perhaps twice: their slot and the row."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("__k", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    slots = F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("slot")
    place = F.bround(F.col("slot") * (F.col("__n") - 1) / F.lit(float(max(length - 1, 1)))).cast("long")
    wanted = ranked.select(*by, "__n").distinct().select(*by, "__n", slots).withColumn("__k", place).drop("__n")
    return wanted.join(ranked.drop("__n"), [*by, "__k"]).drop("__k")

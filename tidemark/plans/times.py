"""Queries over time: alignment, interval joins, windows, novelty."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import align, intervals, windows
from tidemark.plans.common import DAY, EV, IV, NS, T0, embeddings, events
from tidemark.plans.common import intervals as spans_of
from tidemark.session import table

HOUR = 3600 * NS
P = "pr AS (SELECT s.stream, t.ts FROM (SELECT DISTINCT stream FROM ev WHERE ts BETWEEN {lo} AND {hi}) s, (SELECT {t0} + i * {step} AS ts FROM range({n}) r(i)) t), near AS (SELECT stream, ts, max(value) AS value FROM ev WHERE ts BETWEEN {lo} AND {hi} GROUP BY stream, ts)"
STEP, END = 600 * NS, T0 + 6 * HOUR
GRID = P.format(lo=T0 - HOUR, hi=END + HOUR, t0=T0, step=STEP, n=(END - T0) // STEP + 1)
BOTH = f"{EV}, {GRID}, p AS (SELECT pr.stream, pr.ts, b.ts AS prev_ts, b.value AS pv FROM pr ASOF LEFT JOIN near b ON pr.stream = b.stream AND pr.ts >= b.ts), bo AS (SELECT p.*, a.ts AS next_ts, a.value AS nv FROM p ASOF LEFT JOIN near a ON p.stream = a.stream AND p.ts <= a.ts)"


def align_nearest(spark, d):
    out = align.aligned(events(spark, d), T0, END, 1 / 600, ["value"], ["stream"], "nearest", 3600)
    return out.select("stream", "ts", "value", "sample_ts")


def align_linear(spark, d):
    out = align.aligned(events(spark, d), T0, END, 1 / 600, ["value"], ["stream"], "linear", 3600)
    return out.select("stream", "ts", F.round("value", 6).alias("value"))


def asof_backward(spark, d):
    probes = events(spark, d).where("stream = 'purchase'").select("user_id", "ts", "event_id")
    samples = events(spark, d).where("stream = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return align.asof(probes, samples, ["user_id"], ["value"], "backward", bucket=2 * DAY)


def drift_free_timeline(spark, d):
    return align.timeline(spark, T0, T0 + 10 * NS, 30.0, drift_free=True)


def containment_join(spark, d):
    w = Window.partitionBy("user_id").orderBy("start", "k")
    base = events(spark, d).where("stream = 'view'").select("user_id", F.col("ts").alias("start"), F.col("event_id").alias("k"))
    spans = base.withColumn("end", F.least(F.col("start") + HOUR * 12, F.coalesce(F.lead("start").over(w) - 1, F.lit(2**62)))).withColumnRenamed("k", "span_id")
    points = events(spark, d).where("stream = 'purchase'").select("user_id", "ts", "event_id")
    return intervals.containment_join(points, spans, ["user_id"]).select("event_id", "span_id")


def overlap_join(spark, d):
    iv = spans_of(spark, d)
    a = iv.where("stream = 'click'").select("ts", F.least("t1", F.col("ts") + 6 * HOUR).alias("t1"), F.col("event_id").alias("a"))
    b = iv.where("stream = 'view'").select(F.col("ts").alias("r_ts"), F.least("t1", F.col("ts") + 6 * HOUR).alias("r_t1"), F.col("event_id").alias("b"))
    return intervals.overlap_join(a, b, HOUR).select("a", "b")


def overlap_anti(spark, d):
    iv = spans_of(spark, d).select("event_id", "stream", "ts", F.least("t1", F.col("ts") + HOUR).alias("t1"))
    probe = iv.where("stream = 'purchase'").select(F.col("ts").alias("r_ts"), F.col("t1").alias("r_t1"))
    return intervals.overlap_join(iv.where("stream <> 'purchase'"), probe, HOUR, how="left_anti").select("event_id")


def clock_fit(spark, d):
    ev = events(spark, d).select("stream", (F.col("event_id") * 7 + F.col("user_id")).alias("tick"), (F.col("ts") - T0).alias("y"))
    return align.clock_fit(ev, "stream", "tick", "y").select("stream", F.round(F.col("rate") / 1e9, 4).alias("rate"), F.round(F.col("offset") / 1e12, 2).alias("offset"), "pairs")


def tumbling_windows(spark, d):
    return windows.tumbling(events(spark, d), 6 * HOUR, ["stream"], {"n": F.count(F.lit(1)), "mean": F.round(F.avg("value"), 6)}).select("stream", "start", "end", "n", "mean")


def sliding_windows(spark, d):
    ev = events(spark, d)
    return windows.sliding(ev, 4 * HOUR, HOUR, ["stream"], {"mean": F.round(F.avg("value"), 6)}, min_rows=4).select("stream", "start", "end", "rows", "mean")


def multiscale_windows(spark, d):
    return windows.multiscale(events(spark, d), [2 * HOUR, 4 * HOUR, 8 * HOUR], ["stream"])


def capped_sequences(spark, d):
    return windows.capped(events(spark, d), ["stream"], 32, "ts").select("stream", "event_id")


def session_islands(spark, d):
    return windows.sessions(events(spark, d), 3 * HOUR, ["user_id"], {"total": F.round(F.sum("value"), 4)})


def incremental_windows(spark, d):
    ev = events(spark, d)
    done = windows.tumbling(ev.where(F.col("ts") < T0), 6 * HOUR, ["stream"], {"n": F.count(F.lit(1))})
    return windows.incremental(ev, done, 6 * HOUR, ["stream"], {"n": F.count(F.lit(1))}).select("stream", "start", "n")


def segment_merge(spark, d):
    w = windows.tumbling(events(spark, d), HOUR, ["stream"], {"score": F.avg("value")})
    out = windows.segments(w.withColumn("end", F.col("start") + HOUR - 1))
    return out.select("stream", "start", "end", F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean"), "windows")


def presence_runs(spark, d):
    return intervals.presence(events(spark, d), ["user_id"], "ts", 2 * HOUR)


def span_union(spark, d):
    return intervals.merge_spans(spans_of(spark, d).withColumn("t1", F.least("t1", F.col("ts") + HOUR)), ["stream"], 0)


def covered_seconds(spark, d):
    return intervals.covered_time(spans_of(spark, d).withColumn("t1", F.least("t1", F.col("ts") + HOUR)), ["user_id"])


def gap_insertion(spark, d):
    own = events(spark, d).where("stream = 'view'").select("user_id", "event_id", F.floor(F.col("value") * 1000).cast("long").alias("length"))
    return intervals.gapped(own, ["user_id"], "event_id", "length", 500).select("event_id", "start", "end")


def sensor_bucket_join(spark, d):
    per = lambda s, n: events(spark, d).where(F.col("stream") == s).groupBy((F.floor(F.col("ts") / HOUR)).cast("long").alias("hour")).agg(F.round(F.avg("value"), 6).alias(n))
    return per("view", "view_mean").join(per("click", "click_mean"), "hour")


def novelty_adjacent(spark, d):
    out = windows.novelty(events(spark, d), ["stream"], "ts", "value")
    return out.select("event_id", *(F.round(c, 6).alias(c) for c in ("adjacent", "hist_mean", "extrap", "two_sided")))


def arc_length_cumsum(spark, d):
    own = events(spark, d).select("user_id", "event_id", "ts", "value", F.sqrt("value").alias("root"))
    return windows.arc_length(own, ["user_id"], "ts", ["value", "root"]).select("event_id", F.round("arc", 4).alias("arc"))


def edge_delta(spark, d):
    return windows.edge_delta(events(spark, d), ["user_id"], "ts", "value", DAY).select("user_id", F.round("delta", 6).alias("delta"))


def keyframe_governing(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, d).select("event_id", F.last(F.when(F.col("stream") == "purchase", F.col("event_id")), True).over(w).alias("keyframe"))


def fixed_length_resample(spark, d):
    return align.fixed_length(events(spark, d), ["stream"], "ts", 16).select("stream", "slot", "event_id")


def event_binding_argmax(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    step = F.hypot(F.col("value") - F.lag("value").over(w), F.lit(0.0))
    tracks = events(spark, d).withColumn("step", step).groupBy("user_id", F.floor(F.col("ts") / DAY).cast("long").alias("day")).agg(F.sum("step").alias("path"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return tracks.groupBy("day").agg(F.max_by("user_id", F.struct(F.round("path", 6), -F.col("user_id"))).alias("agent"), F.round(F.max("path"), 6).alias("path"))


def slot_renaming(spark, d):
    conv = table(spark, d, "conversations")
    first = conv.groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return first.select("conv_id", "role", (F.dense_rank().over(Window.partitionBy("conv_id").orderBy("first", "role")) - 1).cast("long").alias("slot"))


def motion_view(spark, d):
    flat = embeddings(spark, d).select("label", F.posexplode("embedding").alias("pos", "x"))
    return flat.groupBy("label", "pos").agg(F.round(F.stddev_pop("x"), 6).alias("std"))


def _tumble(where: str = "true") -> str:
    return f"SELECT stream, ts // {6 * HOUR} * {6 * HOUR} AS start, count(*) AS n, round(avg(value), 6) AS mean FROM ev WHERE {where} GROUP BY 1, 2"


ISLAND = "sum(n) OVER (PARTITION BY {by} ORDER BY {o} ROWS UNBOUNDED PRECEDING)"
NEAR = "prev_ts IS NOT NULL AND (next_ts IS NULL OR ts - prev_ts <= next_ts - ts)"
SEG = f"""WITH {EV}, w AS (SELECT stream, ts // {HOUR} * {HOUR} AS start, avg(value) AS score FROM ev GROUP BY 1, 2),
  s AS (SELECT median(score) AS m, max(score) AS x FROM w),
  k AS (SELECT w.stream, start, start + {HOUR} - 1 AS end_, score FROM w, s WHERE score >= m + 0.55 * (x - m)),
  f AS (SELECT *, CASE WHEN start - max(end_) OVER (PARTITION BY stream ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {HOUR} THEN 0 ELSE 1 END AS n FROM k),
  g AS (SELECT *, sum(n) OVER (PARTITION BY stream ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM f)
  SELECT stream, min(start) AS start, max(end_) AS "end", round(max(score), 6) AS best, round(avg(score), 6) AS mean, count(*) AS windows FROM g GROUP BY stream, run"""
HOURLY = f"{IV}, h AS (SELECT user_id, stream, ts AS s, least(t1, ts + {HOUR}) AS e FROM iv)"


def _union(by: str) -> str:
    return f"""WITH {HOURLY}, f AS (SELECT {by}, s, e, CASE WHEN s - max(e) OVER (PARTITION BY {by} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS n FROM h),
      g AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM f),
      u AS (SELECT {by}, min(s) AS start, max(e) AS "end", count(*) AS members FROM g GROUP BY {by}, run)"""


def _runs(gap: int, by: str, extra: str) -> str:
    return f"""WITH {EV}, f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY {by} ORDER BY ts) <= {gap} THEN 0 ELSE 1 END AS n FROM ev),
      g AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM f)
      SELECT {by}, {extra} FROM g GROUP BY {by}, session"""


QUERIES = {
    "align_nearest": (align_nearest, f"WITH {BOTH} SELECT stream, ts, CASE WHEN {NEAR} THEN pv ELSE nv END AS value, CASE WHEN {NEAR} THEN prev_ts ELSE next_ts END AS sample_ts FROM bo"),
    "align_linear": (align_linear, f"WITH {BOTH} SELECT stream, ts, round(CASE WHEN prev_ts IS NULL THEN nv WHEN next_ts IS NULL OR next_ts = prev_ts THEN pv ELSE pv + (ts - prev_ts)::DOUBLE / (next_ts - prev_ts) * (nv - pv) END, 6) AS value FROM bo"),
    "asof_backward": (asof_backward, f"WITH {EV}, s AS (SELECT user_id, ts, max(value) AS value FROM ev WHERE stream = 'view' GROUP BY 1, 2) SELECT p.user_id, p.ts, p.event_id, s.value, s.ts AS sample_ts FROM (SELECT * FROM ev WHERE stream = 'purchase') p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts"),
    "drift_free_timeline": (drift_free_timeline, f"SELECT {T0} + floor(i * (1e9::DOUBLE / 30) + 0.5)::BIGINT AS ts FROM range(301) r(i)"),
    "containment_join": (containment_join, f"WITH {EV}, b AS (SELECT user_id, ts AS start, event_id AS k FROM ev WHERE stream = 'view'), s AS (SELECT user_id, start, k AS span_id, least(start + {HOUR * 12}, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY start, k) - 1, {2**62})) AS e FROM b) SELECT p.event_id, s.span_id FROM (SELECT * FROM ev WHERE stream = 'purchase') p ASOF JOIN s ON p.user_id = s.user_id AND p.ts >= s.start WHERE p.ts <= s.e"),
    "overlap_join": (overlap_join, f"WITH {IV}, c AS (SELECT event_id, user_id, stream, ts, least(t1, ts + {6 * HOUR}) AS t1 FROM iv) SELECT a.event_id AS a, b.event_id AS b FROM c a JOIN c b ON a.ts <= b.t1 AND b.ts <= a.t1 WHERE a.stream = 'click' AND b.stream = 'view'"),
    "overlap_anti": (overlap_anti, f"WITH {IV}, c AS (SELECT event_id, stream, ts, least(t1, ts + {HOUR}) AS t1 FROM iv) SELECT event_id FROM c a WHERE stream <> 'purchase' AND NOT EXISTS (SELECT 1 FROM c b WHERE b.stream = 'purchase' AND a.ts <= b.t1 AND b.ts <= a.t1)"),
    "clock_fit": (clock_fit, f"WITH {EV}, p AS (SELECT stream, event_id * 7 + user_id AS tick, ts - {T0} AS y FROM ev), f AS (SELECT stream, regr_slope(y::DOUBLE, tick::DOUBLE) AS rate, count(*) AS pairs FROM p GROUP BY stream), o AS (SELECT p.stream, rate, pairs, y - rate * tick AS o, row_number() OVER (PARTITION BY p.stream ORDER BY y - rate * tick) - 1 AS k FROM p JOIN f USING (stream)) SELECT stream, round(rate / 1e9, 4) AS rate, round(o / 1e12, 2) AS \"offset\", pairs FROM o WHERE k = pairs // 2"),
    "tumbling_windows": (tumbling_windows, f"WITH {EV}, t AS ({_tumble()}), l AS (SELECT stream, max(ts) AS last FROM ev GROUP BY 1) SELECT stream, start, least(start + {6 * HOUR - 1}, last) AS \"end\", n, mean FROM t JOIN l USING (stream)"),
    "sliding_windows": (sliding_windows, f"WITH {EV}, e AS (SELECT * FROM ev), x AS (SELECT stream, min(ts) AS a, max(ts) AS b FROM e GROUP BY 1), w AS (SELECT stream, unnest(range(a, b + 1, {HOUR})) AS start, a, b FROM x) SELECT w.stream, start, start + {4 * HOUR} AS \"end\", count(*) AS rows, round(avg(value), 6) AS mean FROM w JOIN e ON e.stream = w.stream AND e.ts >= start AND e.ts < start + {4 * HOUR} WHERE start <= b - {2 * HOUR} OR start = a GROUP BY 1, 2 HAVING count(*) >= 4"),
    "multiscale_windows": (multiscale_windows, f"WITH {EV}, x AS (SELECT stream, min(ts) AS a, max(ts) AS b FROM ev GROUP BY 1), s AS (SELECT unnest([{2 * HOUR}, {4 * HOUR}, {8 * HOUR}]) AS width) SELECT stream, width, start, start + width AS \"end\" FROM (SELECT stream, width, unnest(generate_series(a, b - width, width // 2)) AS start FROM x, s WHERE a + width <= b)"),
    "capped_sequences": (capped_sequences, f"WITH {EV}, r AS (SELECT stream, event_id, row_number() OVER (PARTITION BY stream ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY stream) AS n FROM ev) SELECT stream, event_id FROM r WHERE n <= 32 OR k = 0 OR floor(k * 31.0::DOUBLE / (n - 1)) <> floor((k - 1) * 31.0::DOUBLE / (n - 1))"),
    "session_islands": (session_islands, _runs(3 * HOUR, "user_id", 'session, min(ts) AS start, max(ts) AS "end", count(*) AS rows, round(sum(value), 4) AS total')),
    "incremental_windows": (incremental_windows, f"WITH {EV}, m AS (SELECT stream, least(max(ts // {6 * HOUR} * {6 * HOUR}) + {6 * HOUR - 1}, max(ts)) AS mark FROM ev WHERE ts < {T0} GROUP BY 1) SELECT ev.stream, ts // {6 * HOUR} * {6 * HOUR} AS start, count(*) AS n FROM ev LEFT JOIN m USING (stream) WHERE mark IS NULL OR ts // {6 * HOUR} * {6 * HOUR} > mark GROUP BY 1, 2"),
    "segment_merge": (segment_merge, SEG),
    "presence_runs": (presence_runs, _runs(2 * HOUR, "user_id", 'min(ts) AS start, max(ts) AS "end", count(*) AS rows')),
    "span_union": (span_union, _union("stream") + ' SELECT stream, start, "end", members FROM u'),
    "covered_seconds": (covered_seconds, _union("user_id") + ' SELECT user_id, sum("end" - start)::BIGINT AS covered FROM u GROUP BY 1'),
    "gap_insertion": (gap_insertion, f"WITH {EV}, o AS (SELECT user_id, event_id, floor(value * 1000)::BIGINT AS length FROM ev WHERE stream = 'view'), s AS (SELECT event_id, length, (coalesce(sum(length) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 500)::BIGINT AS start FROM o) SELECT event_id, start, start + length AS \"end\" FROM s"),
    "sensor_bucket_join": (sensor_bucket_join, f"WITH {EV}, v AS (SELECT ts // {HOUR} AS hour, round(avg(value), 6) AS view_mean FROM ev WHERE stream = 'view' GROUP BY 1), c AS (SELECT ts // {HOUR} AS hour, round(avg(value), 6) AS click_mean FROM ev WHERE stream = 'click' GROUP BY 1) SELECT hour, view_mean, click_mean FROM v JOIN c USING (hour)"),
    "novelty_adjacent": (novelty_adjacent, f"WITH {EV} SELECT event_id, round(abs(value - lag(value) OVER w), 6) AS adjacent, round(abs(value - avg(value) OVER (PARTITION BY stream ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)), 6) AS hist_mean, round(abs(value - (2 * lag(value) OVER w - lag(value, 2) OVER w)), 6) AS extrap, round(abs(avg(value) OVER (PARTITION BY stream ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) - avg(value) OVER (PARTITION BY stream ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)), 6) AS two_sided FROM ev WINDOW w AS (PARTITION BY stream ORDER BY ts)"),
    "arc_length_cumsum": (arc_length_cumsum, f"WITH {EV}, s AS (SELECT event_id, user_id, ts, coalesce(sqrt(power(value - lag(value) OVER w, 2) + power(sqrt(value) - lag(sqrt(value)) OVER w, 2)), 0) AS step FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT event_id, round(sum(step) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS arc FROM s"),
    "edge_delta": (edge_delta, f"WITH {EV}, x AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS a, max(ts) OVER (PARTITION BY user_id) AS b FROM ev) SELECT user_id, round(avg(value) FILTER (ts >= b - {DAY}) - avg(value) FILTER (ts <= a + {DAY}), 6) AS delta FROM x GROUP BY 1"),
    "keyframe_governing": (keyframe_governing, f"WITH {EV} SELECT event_id, last_value(CASE WHEN stream = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS keyframe FROM ev"),
    "fixed_length_resample": (fixed_length_resample, f"WITH {EV}, r AS (SELECT stream, event_id, row_number() OVER (PARTITION BY stream ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY stream) AS n FROM ev), s AS (SELECT DISTINCT stream, n FROM r), w AS (SELECT stream, slot::INTEGER AS slot, round_even(slot * (n - 1) / 15.0::DOUBLE, 0)::BIGINT AS k FROM s, range(16) t(slot)) SELECT w.stream, w.slot, r.event_id FROM w JOIN r USING (stream, k)"),
    "event_binding_argmax": (event_binding_argmax, f"WITH {EV}, s AS (SELECT user_id, ts // {DAY} AS day, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts)) AS step FROM ev), t AS (SELECT user_id, day, round(sum(step), 6) AS path FROM s GROUP BY 1, 2 HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY path DESC NULLS LAST, user_id) AS k FROM t) SELECT day, user_id AS agent, path FROM r WHERE k = 1"),
    "slot_renaming": (slot_renaming, "WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) SELECT conv_id, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY t, role) - 1 AS slot FROM f"),
    "motion_view": (motion_view, "WITH f AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INTEGER - 1 AS pos FROM embeddings) SELECT label, pos, round(stddev_pop(x), 6) AS std FROM f GROUP BY 1, 2"),
}

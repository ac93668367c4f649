"""Queries over gates, audits, pair relations and boosts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import dot
from tidemark.operators import evidence, sequences
from tidemark.plans.common import DAY, EV, NS, embeddings, events, vector_of
from tidemark.plans.ranks import SC, scores

HOUR = 3600 * NS


def precision_floor(spark, d):
    return evidence.precision_floor(scores(spark, d), "a", 90, 0.1).select("vec_id")


def direction_gate(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    ev = events(spark, d).withColumn("delta", F.col("value") - F.lag("value").over(w)).where("delta is not null")
    return evidence.direction_gate(ev, "user_id", "delta", True).select("event_id")


def no_match_gate(spark, d):
    c = scores(spark, d).groupBy("label").agg(F.max("a").alias("s"), F.count(F.lit(1)).alias("n"), F.avg("a").alias("p"))
    return evidence.no_match(c, "label", "s", "n", "p", 1.0)


def top_five_mean(spark, d):
    return evidence.top_mean(scores(spark, d), ["label"], "a").select("label", F.round("score", 6).alias("score"))


def query_variants(spark, d):
    return evidence.variants(scores(spark, d), "label", "vec_id", "a", 3).select("label", F.round("score", 6).alias("score"))


def first_of_each(spark, d):
    return evidence.first_of_each(events(spark, d), ["user_id", "stream"], "ts").select("event_id")


def even_stride(spark, d):
    return evidence.even_stride(events(spark, d), ["stream"], "ts", 8).select("stream", "event_id")


def _tracks(spark, d):
    """Events as tracks of an hour, their boxes from their values."""
    v = F.col("value")
    return events(spark, d).select(F.col("event_id").alias("track"), "ts", (F.col("ts") + HOUR).alias("t1"), (v % 40).alias("x0"), (v % 30).alias("y0"), (v % 40 + 12).alias("x1"), (v % 30 + 12).alias("y1"))


def disjoint_pairs(spark, d):
    return evidence.box_pairs(_tracks(spark, d), HOUR)


def handoff_pairs(spark, d):
    return evidence.handoffs(_tracks(spark, d), HOUR)


def open_cells(spark, d):
    c = scores(spark, d).groupBy("label").agg(F.round(F.max("a"), 9).alias("s"), F.count(F.lit(1)).alias("n"))
    return evidence.open_cells(c, "label", "s", "n", 0.25).select("label")


def byte_table_score(spark, d):
    q = vector_of(spark, d, 5)
    bits = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, i: s + F.when(F.get(F.col("embedding"), i + 8 * k) >= 0, F.pow(F.lit(2.0), i).cast("int")).otherwise(0))
    coded = embeddings(spark, d).select("vec_id", F.array(*(bits(k) for k in range(8))).alias("code"))
    return coded.select("vec_id", F.round(evidence.byte_table_score(F.col("code"), q), 6).alias("score"))


def rank_norm_blend(spark, d):
    s = scores(spark, d).select("vec_id", "a", F.coalesce("b", F.lit(0.0)).alias("b"))
    return evidence.rank_norm_blend(s, "vec_id", "a", "b", 40, 0.5).select("vec_id", "rank")


def collapse_spans(spark, d):
    s = events(spark, d).select("user_id", F.col("ts").alias("start"), (F.col("ts") + 6 * HOUR).alias("end"), "value")
    return evidence.collapse_spans(s, "user_id", "start", "end", "value")


def neighbour_density(spark, d):
    from tidemark.operators.vectors import knn_join

    e = embeddings(spark, d)
    near = knn_join(e.select(F.col("vec_id").alias("q"), "embedding"), e, 15, "q", "vec_id").select(F.col("q").alias("vec_id"), F.col("vec_id").alias("neighbour"))
    ranked = scores(spark, d).withColumn("rank", F.row_number().over(Window.orderBy(F.col("a").desc(), "vec_id"))).select("vec_id", "rank")
    return evidence.neighbour_density(near, ranked, "vec_id", 25).select("vec_id", F.round("density", 6).alias("density"))


def swap_contrast(spark, d):
    out = evidence.swap_contrast(embeddings(spark, d), "embedding", vector_of(spark, d, 5), vector_of(spark, d, 17))
    return out.select("vec_id", F.round("contrast", 6).alias("contrast"))


def anchor_boost(spark, d):
    return evidence.boost(scores(spark, d), "a", {"b": 0.25}).select("vec_id", F.round("a", 6).alias("a"))


def binding_audit(spark, d):
    hits = events(spark, d).select("event_id", F.when(F.col("value") % 7 >= 1, (F.col("value") % 11) / 10).alias("present"), (F.col("value") % 3 >= 0.5).alias("moved"), ((F.col("value") % 9) / 8).alias("hue"), F.when(F.col("value") % 5 >= 1, F.col("value") % 5 >= 2).alias("near"))
    return evidence.binding_audit(hits, "event_id", "present", "moved", "hue", "near").select("event_id", "reason")


def transition_descriptors(spark, d):
    t = _tracks(spark, d).join(events(spark, d).select(F.col("event_id").alias("track"), "user_id"), "track")
    out = evidence.transitions(t.withColumn("day", F.floor(F.col("ts") / DAY)), ["user_id", "day"], "ts", ["x0", "y0", "x1", "y1"])
    return out.select("user_id", "day", "rows", F.round("displacement", 6).alias("displacement"), F.round("growth", 6).alias("growth"))


def sequence_shapes(spark, d):
    own = events(spark, d).select("user_id", "ts", F.array(F.col("value") / 500, F.sin("value"), F.cos("value")).alias("v"))
    return sequences.per_group(own, "user_id", "ts", "v", lambda x: [(i, round(float(v), 6)) for i, v in enumerate(evidence.self_similarity_shape(x))], "place long, value double")


def segment_counts(spark, d):
    own = events(spark, d).select("user_id", "ts", F.array(F.col("value") / 500, F.sin("value"), F.cos("value")).alias("v"))
    return sequences.per_group(own, "user_id", "ts", "v", lambda x: [(evidence.segment_count(sequences.unit_rows(x)),)], "segments long")


def learned_index(spark, d):
    """Pieces of a learned index of each stream's times."""
    own = events(spark, d).select("stream", "ts", F.array(F.col("ts").cast("double")).alias("v"))
    return sequences.per_group(own, "stream", "ts", "v", lambda x: [(int(k), p) for k, p, _ in evidence.linear_segments(x[:, 0].astype(np.int64))], "first_key long, place long")


def object_ranks(spark, d):
    """Of each label's rows, the best by a query half, with the other half's score."""
    q = vector_of(spark, d, 5)
    e = embeddings(spark, d).select("vec_id", "label", F.round(dot(F.slice("embedding", 1, 32), F.array(*map(F.lit, q[:32]))), 9).alias("a"))
    return e.groupBy("label").agg(F.max_by("vec_id", F.struct("a", -F.col("vec_id"))).alias("vec_id"))


TR = f"{EV}, tr AS (SELECT event_id AS track, ts, ts + {HOUR} AS t1, fmod(value, 40) AS x0, fmod(value, 30) AS y0, fmod(value, 40) + 12 AS x1, fmod(value, 30) + 12 AS y1 FROM ev)"
Q5 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {i})"
IW = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"

QUERIES = {
    "precision_floor": (precision_floor, f"WITH {SC} SELECT vec_id FROM sc WHERE a >= (SELECT quantile_cont(a, 0.9) FROM sc) AND a >= 0.1"),
    "direction_gate": (direction_gate, f"WITH {EV}, x AS (SELECT event_id, user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS delta FROM ev), k AS (SELECT user_id FROM x WHERE delta IS NOT NULL GROUP BY 1 HAVING median(delta) > 0) SELECT event_id FROM x WHERE delta IS NOT NULL AND user_id IN (FROM k)"),
    "no_match_gate": (no_match_gate, f"WITH {SC}, c AS (SELECT label, max(a) AS s, count(*) AS n, avg(a) AS p FROM sc GROUP BY 1), t AS (SELECT avg(s) AS a, stddev_pop(s) AS d, quantile_cont(p, 1/3) AS q, avg(n) AS m FROM c) SELECT label, NOT ((s - a) / (d + 1e-12) >= 1.0) OR p < q OR n < m AS no_match FROM c, t"),
    "top_five_mean": (top_five_mean, f"WITH {SC}, r AS (SELECT label, a, row_number() OVER (PARTITION BY label ORDER BY a DESC) AS k FROM sc) SELECT label, round(avg(a), 6) AS score FROM r WHERE k <= 5 GROUP BY 1"),
    "query_variants": (query_variants, f"WITH {SC}, r AS (SELECT label, a, row_number() OVER (PARTITION BY label ORDER BY a DESC) AS k FROM sc), m AS (SELECT label, avg(a) AS s FROM r WHERE k <= 5 GROUP BY 1), b AS (SELECT * FROM m WHERE label <> 3 AND s > (SELECT s FROM m WHERE label = 3) ORDER BY s DESC, label LIMIT 3) SELECT label, round(s, 6) AS score FROM m WHERE label = 3 UNION ALL SELECT label, round(s, 6) FROM b"),
    "first_of_each": (first_of_each, f"WITH {EV} SELECT arg_min(event_id, ts) AS event_id FROM ev GROUP BY user_id, stream"),
    "even_stride": (even_stride, f"WITH {EV}, r AS (SELECT stream, event_id, row_number() OVER (PARTITION BY stream ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY stream) AS n FROM ev) SELECT stream, event_id FROM r WHERE list_contains(list_transform(range(8), lambda i: round_even(i * (n - 1) / 7.0::DOUBLE, 0)::BIGINT), k)"),
    "disjoint_pairs": (disjoint_pairs, f"WITH {TR} SELECT a.track AS a, b.track AS b FROM tr a JOIN tr b ON a.track < b.track AND a.ts <= b.t1 AND b.ts <= a.t1 WHERE {IW} = 0"),
    "handoff_pairs": (handoff_pairs, f"WITH {TR} SELECT a.track AS a, b.track AS b FROM tr a JOIN tr b ON a.track <> b.track AND b.ts > a.t1 AND b.ts <= a.t1 + {HOUR} WHERE {IW} / (288 - {IW}) >= 0.3"),
    "open_cells": (open_cells, f"WITH {SC}, c AS (SELECT label, round(max(a), 9) AS s, count(*) AS n FROM sc GROUP BY 1), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w, max(s) OVER () AS x, stddev_pop(s) OVER () AS d, sum(n) OVER () AS t FROM c) SELECT label FROM b WHERE w < 0.25 * t OR s >= x - d"),
    "byte_table_score": (byte_table_score, f"SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, {Q5.format(i=5)}), lambda p: CASE WHEN p[1] >= 0 THEN p[2] ELSE -p[2] END)), 6) AS score FROM embeddings"),
    "rank_norm_blend": (rank_norm_blend, f"WITH {SC}, s AS (SELECT vec_id, a, coalesce(b, 0) AS b, row_number() OVER (ORDER BY a DESC, vec_id) AS k FROM sc), h AS (SELECT vec_id, 0.5 * (row_number() OVER (ORDER BY a, vec_id) - 1) / 39.0::DOUBLE + 0.5 * (row_number() OVER (ORDER BY b, vec_id) - 1) / 39.0::DOUBLE AS v FROM s WHERE k <= 40) SELECT vec_id, row_number() OVER (ORDER BY round(v, 12) DESC, vec_id) AS rank FROM h UNION ALL SELECT vec_id, k FROM s WHERE k > 40"),
    "collapse_spans": (collapse_spans, None),
    "neighbour_density": (neighbour_density, f"WITH {SC}, p AS (SELECT a.vec_id, b.vec_id AS n, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS k FROM embeddings a, embeddings b), t AS (SELECT vec_id FROM sc ORDER BY a DESC, vec_id LIMIT 25) SELECT vec_id, round(avg((n IN (SELECT vec_id FROM t))::INTEGER), 6) AS density FROM p WHERE k <= 15 GROUP BY 1"),
    "swap_contrast": (swap_contrast, f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {Q5.format(i=5)}) - list_inner_product(embedding::DOUBLE[], {Q5.format(i=17)}), 6) AS contrast FROM embeddings"),
    "anchor_boost": (anchor_boost, f"WITH {SC} SELECT vec_id, round(a + 8 * stddev_pop(a) OVER () * 0.25 * coalesce(b, 0), 6) AS a FROM sc"),
    "binding_audit": (binding_audit, f"WITH {EV}, h AS (SELECT event_id, CASE WHEN fmod(value, 7) >= 1 THEN fmod(value, 11) / 10 END AS p, fmod(value, 3) >= 0.5 AS m, fmod(value, 9) / 8 AS hue, CASE WHEN fmod(value, 5) >= 1 THEN fmod(value, 5) >= 2 END AS n FROM ev), c AS (SELECT count(*) FILTER (p < 0.5) AS g, count(*) FILTER (p >= 0.5) AS t FROM h) SELECT event_id, CASE WHEN p < 0.5 AND t >= g THEN 'absent' WHEN NOT m THEN 'static' WHEN hue < 0.25 THEN 'colour' WHEN NOT n THEN 'landmark' END AS reason FROM h, c"),
    "transition_descriptors": (transition_descriptors, f"WITH {EV}, b AS (SELECT user_id, ts // {DAY} AS day, ts, fmod(value, 40) + 6 AS x, fmod(value, 30) + 6 AS y FROM ev), e AS (SELECT user_id, day, count(*) AS rows, arg_min(x, ts) AS px, arg_min(y, ts) AS py, arg_max(x, ts) AS qx, arg_max(y, ts) AS qy FROM b GROUP BY 1, 2) SELECT user_id, day, rows, round(sqrt(power(qx - px, 2) + power(qy - py, 2)), 6) AS displacement, 0.0::DOUBLE AS growth FROM e"),
    "sequence_shapes": (sequence_shapes, None),
    "segment_counts": (segment_counts, None),
    "learned_index": (learned_index, None),
    "object_ranks": (object_ranks, f"WITH {SC}, r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(a, 9) DESC, vec_id) AS k FROM sc) SELECT label, vec_id FROM r WHERE k = 1"),
}

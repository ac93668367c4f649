"""Queries over scores: fusion, cuts, filters, metrics, composed searches, sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import constant, dot
from tidemark.operators import metrics, ranking, search, sequences
from tidemark.plans.common import EV, embeddings, events, vector_of
from tidemark.session import table

Q, R = 5, 17
#: Seeds of the query-by-example queries.
SEEDS = [3, 8, 21]


def scores(spark, d):
    """Two channels of each vector: its halves against those of a query; ids divisible by 7 abstain in b."""
    q = vector_of(spark, d, Q)
    e = embeddings(spark, d)
    a = dot(F.slice("embedding", 1, 32), constant(q[:32]))
    b = dot(F.slice("embedding", 33, 32), constant(q[32:]))
    return e.select("vec_id", "label", "embedding", a.alias("a"), F.when(F.col("vec_id") % 7 != 0, b).alias("b"))


QV = f"(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {Q})"
SC = f"sc AS (SELECT vec_id, label, list_inner_product(embedding[1:32]::DOUBLE[], {QV}[1:32]) AS a, CASE WHEN vec_id % 7 <> 0 THEN list_inner_product(embedding[33:64]::DOUBLE[], {QV}[33:64]) END AS b FROM embeddings)"
RK = SC + ", ra AS (SELECT vec_id, row_number() OVER (ORDER BY a DESC, vec_id) - 1 AS x FROM sc), rb0 AS (SELECT vec_id, row_number() OVER (ORDER BY b DESC, vec_id) - 1 AS x FROM sc WHERE b IS NOT NULL), rb AS (SELECT sc.vec_id, coalesce(rb0.x, (SELECT median(x) FROM rb0)) AS x FROM sc LEFT JOIN rb0 USING (vec_id)), fu AS (SELECT sc.*, ra.x AS xa, rb.x AS xb, 1.0::DOUBLE / (61 + ra.x) + 2.0::DOUBLE / (61 + rb.x) AS fused FROM sc JOIN ra USING (vec_id) JOIN rb USING (vec_id))"


def _fused(spark, d):
    return ranking.rrf(scores(spark, d), {"a": 1.0, "b": 2.0}, "vec_id")


def rrf_fusion(spark, d):
    return _fused(spark, d).select("vec_id", F.round("fused", 9).alias("fused"))


def explain_fusion(spark, d):
    return ranking.explain_fusion(_fused(spark, d), ["a", "b"], "vec_id", 20).withColumn("fused", F.round("fused", 9))


def rrf_abstain_median(spark, d):
    return ranking.rank0(scores(spark, d), "b", "vec_id", "rank").where("b is null").select("vec_id", "rank")


def rank_fraction(spark, d):
    return ranking.rank_fraction(scores(spark, d), "b", "vec_id", "share").select("vec_id", F.round("share", 9).alias("share"))


def answer_percentile_rank(spark, d):
    return ranking.percentile_rank(scores(spark, d), "b", "vec_id", "share").select("vec_id", F.round("share", 9).alias("share"))


def z_blend(spark, d):
    return ranking.z_blend(scores(spark, d), "a", "b", 0.3).select("vec_id", F.round("blend", 6).alias("blend"))


def variant_max(spark, d):
    return scores(spark, d).select("vec_id", F.round(F.greatest("a", "b"), 6).alias("best"))


def unanimous_filter(spark, d):
    return ranking.unanimous(scores(spark, d), ["a", "b"], "vec_id", 0.33).select("vec_id")


def confidence_cut(spark, d):
    return ranking.confidence_cut(scores(spark, d), "a", 0.6, 100)


def mad_cut(spark, d):
    return ranking.mad_cut(scores(spark, d), "a", 100)


def otsu_cut(spark, d):
    return spark.createDataFrame([(ranking.otsu_cut(scores(spark, d), "a", 100),)], "keep long")


def _fit(mode):
    def run(spark, d):
        r = ranking.fit_cut(scores(spark, d), "a", mode, 90.0)
        return spark.createDataFrame([(r["n"], round(r["cut"], 6), round(r["separation"], 5))], "n long, cut double, separation double")

    return run


def fit_sql(cut: str) -> str:
    return f"WITH {SC}, s AS (SELECT a AS s FROM sc), c AS ({cut}) SELECT count(*) AS n, round(max(cut), 6) AS cut, round((avg(s) FILTER (s > cut) - avg(s) FILTER (s <= cut)) / (stddev_pop(s) + 1e-12), 5) AS separation FROM s, c"


def corroboration_veto(spark, d):
    s = scores(spark, d).withColumn("c", -F.col("a"))
    w = ranking.corroboration(s.fillna({"b": 0.0}), ["a", "b", "c"])
    return spark.createDataFrame(sorted(w.items()), "channel string, weight double")


def informativeness(spark, d):
    return ranking.informativeness(scores(spark, d), "a", "b").select(F.round("informativeness", 6).alias("informativeness"))


def rank_correlation(spark, d):
    return ranking.rank_correlation(scores(spark, d).where("b is not null"), "a", "b", "vec_id").select(F.round("spearman", 6).alias("spearman"))


def prf_centroid(spark, d):
    out = search.feedback(scores(spark, d), "vec_id", "embedding", "a", 25)
    return out.select("vec_id", F.round("feedback", 6).alias("feedback"))


def permutation_rerank(spark, d):
    out = ranking.permute_head(scores(spark, d).select("vec_id", "a", F.coalesce("b", F.lit(-9.0)).alias("b")), "vec_id", "a", "b", 30)
    return out.select("vec_id", F.round("a", 6).alias("a"))


def tail_concentration(spark, d):
    return metrics.tail_concentration(scores(spark, d), "a").select(F.round("tail", 6).alias("tail"))


def auc_rank_sum(spark, d):
    s = scores(spark, d).withColumn("truth", (F.col("label") == 3).cast("int"))
    return metrics.auc(s, "a", "truth").select(F.round("auc", 6).alias("auc"))


def retrieval_metrics(spark, d):
    from tidemark.operators.vectors import knn_join

    e = embeddings(spark, d)
    found = knn_join(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding"), e, 20, "query", "vec_id")
    own = found.join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("want")), "query").join(e.select("vec_id", "label"), "vec_id").withColumn("truth", (F.col("want") == F.col("label")).cast("int"))
    out = metrics.retrieval(own, "query", "rank", "truth", 10)
    return out.select("query", *(F.round(c, 6).alias(c) for c in out.columns if c != "query"))


def nms_temporal(spark, d):
    ev = events(spark, d).withColumn("position", F.row_number().over(Window.partitionBy("stream").orderBy("ts")))
    return ranking.suppress(ev, "stream", "position", "value", 2).select("event_id")


def search_like_qbe(spark, d):
    e = embeddings(spark, d)
    halves = {"low": (e.select("vec_id", F.slice("embedding", 1, 32).alias("v")), "cosine"), "high": (e.select("vec_id", F.slice("embedding", 33, 32).alias("v")), "cosine")}
    found, _ = search.search_like(halves, "vec_id", "v", SEEDS, 25)
    return found.select("vec_id", "rank", F.round("score", 5).alias("score"))


def loo_quality(spark, d):
    q = search.loo_quality(embeddings(spark, d), "vec_id", "embedding", SEEDS)
    return spark.createDataFrame([(round(q, 6),)], "quality double")


def coherence_weight(spark, d):
    q = search.coherence(embeddings(spark, d), "vec_id", "embedding", SEEDS)
    return spark.createDataFrame([(round(q, 6),)], "coherence double")


def answer_join(spark, d):
    ev = events(spark, d).withColumn("episode", F.col("user_id")).withColumnRenamed("stream", "kind")
    wanted = [("view", {"value": F.col("value"), "late": F.col("ts")}), ("click", {"value": F.col("value")})]
    return search.answer(ev, wanted).select("episode", F.round("score", 6).alias("score"), "kinds")


def metadata_plan(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    out, _ = search.plan(docs.where("lang = 'en'"), "doc_id", [("labels", good), ("source", docs.where("source in ('src1', 'src2', 'src3')"))])
    return out.select("doc_id")


def label_lookup(spark, d):
    labels = table(spark, d, "labels")
    return labels.where(F.col("quality").isin([1]) & (F.col("toxic") == 0)).select("doc_id").distinct()


def flag_lookup(spark, d):
    ev = events(spark, d)
    flags = ev.groupBy("user_id").agg(F.max(F.when(F.col("stream") == "purchase", 1).otherwise(0)).alias("has_purchase"), F.max(F.when(F.col("value") > 200, 1).otherwise(0)).alias("has_large"))
    return flags.where("has_purchase = 1 or has_large = 1")


def two_hop_objects(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("episode"))
    return search.two_hops(li, "item", "episode", 7)


def anti_exclusion(spark, d):
    e = embeddings(spark, d)
    return e.join(e.where("label = 2").select("vec_id"), "vec_id", "left_anti").select("vec_id")


def recall_resolution(spark, d):
    s = scores(spark, d).select("vec_id", "label", F.round("a", 9).alias("a"))
    return search.best_per_group(s, "label", "a", "vec_id", 0.0).select("label", "vec_id", F.round("best", 6).alias("best"), "support")


def search_set_pipeline(spark, d):
    s = scores(spark, d).withColumn("position", F.col("vec_id"))
    return search.search_set(s, {"a": 1.0, "b": 1.0}, "vec_id", "embedding", "label", "position", 50, 0.8, 0.1, 1).select("vec_id", "rank")


# sequences: a trace is a user's events, a step of three numbers each


def _traces(spark, d):
    unit = F.array(F.col("value") / 500, F.sin(F.col("value")), F.cos(F.col("value")))
    own = events(spark, d).select("user_id", "ts", unit.alias("v"))
    return own.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "v"))), lambda s: s["v"]).alias("trace"))


def _query_trace(spark, d):
    r = _traces(spark, d).where("user_id = 3").first()
    return np.array(r["trace"], dtype=float)[:16]


def dtw_anchored(spark, d):
    return sequences.warp_search(_traces(spark, d), "user_id", "trace", _query_trace(spark, d), 10, None, 0.0).select("user_id", F.round("distance", 6).alias("distance"))


def dtw_banded(spark, d):
    return sequences.warp_search(_traces(spark, d), "user_id", "trace", _query_trace(spark, d), 10, None, 0.25).select("user_id", F.round("distance", 6).alias("distance"), "start", "end")


def dtw_free_ends(spark, d):
    return sequences.warp_search(_traces(spark, d), "user_id", "trace", _query_trace(spark, d), 10, None, 0.0, True).select("user_id", F.round("distance", 6).alias("distance"))


def dtw_subsequence(spark, d):
    q = sequences.unit_rows(_query_trace(spark, d)[:6])
    own = events(spark, d).select("user_id", "ts", F.array(F.col("value") / 500, F.sin("value"), F.cos("value")).alias("v"))
    return sequences.per_group(own, "user_id", "ts", "v", lambda x: [sequences.warp_subsequence(q, sequences.unit_rows(x))], "start long, end long, cost double").withColumn("cost", F.round("cost", 6))


def localize_rigid(spark, d):
    q = sequences.unit_rows(_query_trace(spark, d)[4:10])
    own = events(spark, d).select("user_id", "ts", F.array(F.col("value") / 500, F.sin("value"), F.cos("value")).alias("v"))
    return sequences.per_group(own, "user_id", "ts", "v", lambda x: [sequences.localize(q, sequences.unit_rows(x))], "start long, end long")


def nw_chain(spark, d):
    chains = events(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "stream"))), lambda s: s["stream"]).alias("chain"))
    seed = chains.where("user_id = 3").first()["chain"]

    def run(batches):
        for pdf in batches:
            yield pdf[["user_id"]].assign(score=[round(sequences.chain_score(list(seed), list(c)), 6) for c in pdf["chain"]])

    return chains.mapInPandas(run, "user_id long, score double")


def changepoints(spark, d):
    own = events(spark, d).select("user_id", "ts", F.array(F.col("value")).alias("v"))
    return sequences.per_group(own, "user_id", "ts", "v", lambda x: [(c,) for c in sequences.change_points(x / 100, "bic")], "cut long")


def event_segmentation(spark, d):
    own = events(spark, d).select("user_id", "ts", F.array(F.col("value") / 500, F.sin("value"), F.cos("value")).alias("v"))
    return sequences.per_group(own, "user_id", "ts", "v", lambda x: sequences.segment_media(sequences.unit_rows(x)), "start long, end long")


def foote_novelty(spark, d):
    own = events(spark, d).select("user_id", "ts", F.array(F.col("value") / 500, F.sin("value"), F.cos("value")).alias("v"))
    return sequences.per_group(own, "user_id", "ts", "v", lambda x: [(i, round(float(v), 6)) for i, v in enumerate(sequences.foote(sequences.unit_rows(x), 4))], "step long, novelty double")


def arc_resampling(spark, d):
    own = events(spark, d).select("user_id", "ts", F.array("value").alias("v"))
    return sequences.per_group(own, "user_id", "ts", "v", lambda x: [(i, float(p)) for i, p in enumerate(np.floor(sequences.arc_resample(x, np.abs(np.diff(x[:, 0], prepend=x[0, 0])), 200.0)[1] * 1e6 + 0.5) / 1e6)], "step long, place double")


def gallery_assign(spark, d):
    e = embeddings(spark, d)
    return sequences.gallery(e, ["label"], "vec_id", "embedding", "vec_id", 0.5).select("label", "vec_id", "identity")


QV2 = "list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {i}))"
SEEDLIST = ", ".join(map(str, SEEDS))
PAIR = f"p AS (SELECT a.vec_id, b.vec_id AS seed, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE b.vec_id IN ({SEEDLIST}))"
MAD = f"WITH {SC}, s AS (SELECT a AS s FROM sc), m AS (SELECT median(s) AS m FROM s), dv AS (SELECT m, median(abs(s - m)) AS d FROM s, m GROUP BY m), k AS (SELECT count(*) AS k FROM s, dv WHERE s >= m + 3 * 1.4826 * d)"

OTSU = """
    WITH r AS (SELECT min(s) AS low, max(s) AS high, least(256, greatest(16, count(*) // 8)) AS bins FROM s),
    b AS (SELECT least(floor((s - low) / (high - low) * bins), bins - 1)::BIGINT AS b, count(*) AS n FROM s, r GROUP BY 1),
    h AS (SELECT i, coalesce(n, 0) / (SELECT count(*) FROM s)::DOUBLE AS p FROM (SELECT unnest(range((SELECT bins FROM r))) AS i) LEFT JOIN b ON b = i),
    c AS (SELECT i, sum(p) OVER (ORDER BY i) AS w, sum(p * i) OVER (ORDER BY i) AS m, sum(p * i) OVER () AS t FROM h)
    SELECT low + (high - low) * ((SELECT i FROM c WHERE w * (1 - w) > 1e-12 ORDER BY round((t * w - m) ** 2 / (w * (1 - w)), 9) DESC, i LIMIT 1) + 1) / bins AS cut FROM r
"""
#: Places at equal amounts of change: between the last knot at or before each target and the next one.
ARC = f"""
    WITH {EV}, x AS (SELECT user_id, row_number() OVER w - 1 AS i, abs(value - coalesce(lag(value) OVER w, value)) AS c FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    k AS (SELECT user_id, i, sum(c) OVER (PARTITION BY user_id ORDER BY i) AS knot FROM x),
    t AS (SELECT user_id, max(knot) AS total, least(512, greatest(4, round_even(max(knot) / 200, 0)))::BIGINT AS n FROM k GROUP BY 1),
    g AS (SELECT user_id, unnest(range(n)) AS step, total, n FROM t WHERE total > 0), p AS (SELECT user_id, step, (step + 0.5) * total / n AS target FROM g),
    d AS (SELECT user_id, knot, max(i) AS i FROM k GROUP BY 1, 2),
    f AS (SELECT d.user_id, d.knot, d.i, lead(d.knot) OVER w AS after FROM d WINDOW w AS (PARTITION BY d.user_id ORDER BY d.knot))
    SELECT p.user_id, step, round(f.i + coalesce((target - f.knot) / (f.after - f.knot), 0), 6) AS place FROM p ASOF JOIN f ON p.user_id = f.user_id AND p.target >= f.knot
    UNION ALL SELECT k.user_id, k.i, k.i FROM k JOIN t USING (user_id) WHERE total <= 0
"""


_STEP = "sum({c}) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) - sum({c}) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS {c}"
FOOTE = f"""
    WITH {EV}, x AS (SELECT user_id, ts, value / 500 AS a, sin(value) AS b, cos(value) AS c FROM ev),
    u AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS step, count(*) OVER (PARTITION BY user_id) AS n, a / l AS a, b / l AS b, c / l AS c FROM (SELECT *, sqrt(a * a + b * b + c * c) + 1e-8 AS l FROM x)),
    d AS (SELECT user_id, step, n, {_STEP.format(c="a")}, {_STEP.format(c="b")}, {_STEP.format(c="c")} FROM u)
    SELECT user_id, step, round(CASE WHEN step BETWEEN 4 AND n - 4 THEN a * a + b * b + c * c ELSE 0 END, 6) AS novelty FROM d
"""


#: Unit rows of every user's trace.
UNIT = f"WITH {EV}, x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) - 1 AS j, count(*) OVER (PARTITION BY user_id) AS n, value / 500 AS a, sin(value) AS b, cos(value) AS c FROM ev), u AS (SELECT user_id, j, n, a / l AS a, b / l AS b, c / l AS c FROM (SELECT *, sqrt(a * a + b * b + c * c) + 1e-8 AS l FROM x))"
ROWS_OF = ", q AS (SELECT row_number() OVER (ORDER BY j) - 1 AS i, a, b, c FROM u WHERE user_id = 3 AND j >= {low} AND j < {high})"


def warped(low: int, high: int, corner: float, along: float, penalty: float, free: bool, band: float | None = None) -> str:
    """Cheapest paths of rows low..high of user 3's trace through all others, row by row: CTEs up to t<rows - 1> of (user_id, j, n, t, e).

    Along a row a path pays `along` x the cost and the penalty for each step, so
    the best is a running minimum once what the whole row costs so far is taken off.
    """
    m = high - low
    over = "OVER (PARTITION BY user_id ORDER BY j)"
    parts = [UNIT + ROWS_OF.format(low=low, high=high)]
    for i in range(m):
        parts.append(f"c{i} AS (SELECT user_id, j, n, w, sum({along} * w + {penalty}) {over} AS cw FROM (SELECT u.user_id, u.j, u.n, 1 - (u.a * q.a + u.b * q.b + u.c * q.c) AS w FROM u, q WHERE q.i = {i}))")
        inside = "true" if band is None else f"j BETWEEN floor({i} * (n - 1) / {max(m - 1, 1)} - greatest(2, round_even({band} * n, 0))) AND ceil({i} * (n - 1) / {max(m - 1, 1)} + greatest(2, round_even({band} * n, 0)))"
        if i == 0:
            first = f"{corner} * w" if free else f"cw + first_value(w) {over}"
            parts.append(f"t0 AS (SELECT user_id, j, n, CASE WHEN {inside} THEN {first} ELSE 'inf'::DOUBLE END AS t, {'j' if free else 0} AS e FROM c0)")
            continue
        parts.append(f"p{i} AS (SELECT c.user_id, c.j, c.n, c.cw, coalesce(lag(t) OVER w, 'inf'::DOUBLE) + {corner} * c.w AS x, t + c.w + {penalty} AS y, coalesce(lag(e) OVER w, 0) AS ex, e AS ey FROM t{i - 1} t JOIN c{i} c ON t.user_id = c.user_id AND t.j = c.j WINDOW w AS (PARTITION BY t.user_id ORDER BY t.j))")
        parts.append(f"r{i} AS (SELECT user_id, j, n, cw, min({{'v': CASE WHEN {inside} THEN least(x, y) - cw ELSE 'inf'::DOUBLE END, 'e': CASE WHEN x <= y THEN ex ELSE ey END}}) {over} AS b FROM p{i})")
        parts.append(f"t{i} AS (SELECT user_id, j, n, CASE WHEN {inside} THEN b.v + cw ELSE 'inf'::DOUBLE END AS t, b.e AS e FROM r{i})")
    return ", ".join(parts)


def placed(low: int, high: int, first: str) -> str:
    """CTE l: the stretch of each trace, as long as rows low..high of user 3's, with the largest sum of products."""
    m = high - low
    return f"""{first}, s AS (SELECT u.user_id, u.j - q.i AS k, any_value(u.n) AS n, sum(u.a * q.a + u.b * q.b + u.c * q.c) AS s FROM u, q GROUP BY 1, 2),
        l AS (SELECT user_id, CASE WHEN n <= {m} THEN 0 ELSE k END AS start, CASE WHEN n <= {m} THEN n ELSE k + {m} END AS "end" FROM s WHERE n <= {m} AND k = 0 OR k BETWEEN 0 AND n - {m} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, k) = 1)"""


#: Global alignments row by row of user 3's chain; along a row the best is a running maximum once the gaps are taken off.
CHAINS = f"""
    WITH RECURSIVE {EV}, o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, stream) AS j, count(*) OVER (PARTITION BY user_id) AS n, stream FROM ev),
    t AS (SELECT 0 AS i, user_id, j, n, j * -0.6::DOUBLE AS t FROM (SELECT user_id, j, n FROM o UNION ALL SELECT DISTINCT user_id, 0, n FROM o)
          UNION ALL
          SELECT i + 1, user_id, j, n, max(x + 0.6 * j) OVER (PARTITION BY user_id ORDER BY j) - 0.6 * j
          FROM (SELECT t.i, t.user_id, t.j, t.n, greatest(t.t - 0.6, coalesce(lag(t.t) OVER (PARTITION BY t.user_id ORDER BY t.j) + CASE WHEN o.stream = q.stream THEN 1 ELSE -0.5 END, '-inf'::DOUBLE)) AS x
                FROM t JOIN o q ON q.user_id = 3 AND q.j = t.i + 1 LEFT JOIN o ON o.user_id = t.user_id AND o.j = t.j))
    SELECT user_id, round(t / greatest(n, i), 6) AS score FROM t WHERE j = n AND i = (SELECT max(n) FROM o WHERE user_id = 3)
"""


def nearest_warped(free: bool = False, band: float | None = None, places: bool = False) -> str:
    """The ten nearest traces to the first sixteen rows of user 3's."""
    ends = "min(t / (16 + j - e + 1))" if free else "min(t / (16 + n)) FILTER (j = n - 1)"
    head = warped(0, 16, 2.0, 1.0, 0.0, free, band)
    head = placed(0, 16, head) if places else head
    return head + f", d AS (SELECT user_id, {ends} AS d FROM t15 GROUP BY 1 ORDER BY d, user_id LIMIT 10) SELECT user_id, round(d, 6) AS distance{', start, l.end' if places else ''} FROM d {'JOIN l USING (user_id)' if places else ''}"


def suppressed(radius: int, rounds: int = 20) -> str:
    """Greedy suppression in SQL, a round at a time: rows best within the radius stay, and what lies near them goes."""
    near = f"OVER (PARTITION BY stream ORDER BY position RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)"
    parts = [f"WITH {EV}, u0 AS (SELECT event_id, stream, position, row_number() OVER (ORDER BY value DESC, position) AS r FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ts) AS position FROM ev))"]
    for k in range(rounds):
        parts.append(f"k{k} AS MATERIALIZED (SELECT * FROM u{k} QUALIFY r = min(r) {near}), u{k + 1} AS MATERIALIZED (SELECT event_id, stream, position, r FROM (SELECT u{k}.*, max(CASE WHEN k{k}.event_id IS NOT NULL THEN 1 ELSE 0 END) {near.replace('stream', f'u{k}.stream').replace('position', f'u{k}.position')} AS gone FROM u{k} LEFT JOIN k{k} USING (event_id)) WHERE gone = 0)")
    # a round too few would leave rows, which would be too many
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT event_id FROM k{k}" for k in range(rounds)) + f" UNION ALL SELECT event_id FROM u{rounds}"


def search_set(rounds: int = 12) -> str:
    """search_set_pipeline in SQL: fusion, a feedback voter, fusion again, the unanimous filter, suppression round by round, and the cut."""
    near = "OVER (PARTITION BY u{k}.label ORDER BY u{k}.vec_id RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
    parts = [f"WITH {RK}, f0 AS (SELECT vec_id, 1.0::DOUBLE / (61 + xa) + 1.0::DOUBLE / (61 + xb) AS s FROM fu), t AS (SELECT vec_id FROM f0 ORDER BY s DESC, vec_id LIMIT 25)"]
    parts.append("f AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE vec_id IN (FROM t)), m AS (SELECT list(m ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS m FROM f GROUP BY 1)), e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
    parts.append("fb AS (SELECT vec_id, row_number() OVER (ORDER BY list_inner_product(e, m) / (sqrt(list_inner_product(m, m)) + 1e-8) / (sqrt(list_inner_product(e, e)) + 1e-8) DESC, vec_id) - 1 AS x FROM e, m)")
    parts.append("ag AS MATERIALIZED (SELECT vec_id, label, a, b, 1.0::DOUBLE / (61 + xa) + 1.0::DOUBLE / (61 + xb) + 3.0::DOUBLE / (61 + fb.x) AS score FROM fu JOIN fb USING (vec_id))")
    parts.append("ga AS (SELECT vec_id, (row_number() OVER (ORDER BY a, vec_id) - 1) / (count(*) OVER () - 1)::DOUBLE AS y FROM ag), gb AS (SELECT vec_id, (row_number() OVER (ORDER BY b, vec_id) - 1) / (count(*) OVER () - 1)::DOUBLE AS y FROM ag WHERE b IS NOT NULL)")
    parts.append("u0 AS MATERIALIZED (SELECT vec_id, label, score, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM ag JOIN ga USING (vec_id) LEFT JOIN gb USING (vec_id) WHERE greatest(ga.y, coalesce(gb.y, 0.5)) >= 0.1)")
    for k in range(rounds):
        own = near.format(k=k)
        parts.append(f"k{k} AS MATERIALIZED (SELECT * FROM u{k} QUALIFY r = min(r) {own}), u{k + 1} AS MATERIALIZED (SELECT vec_id, label, score, r FROM (SELECT u{k}.*, max(CASE WHEN k{k}.vec_id IS NOT NULL THEN 1 ELSE 0 END) {own} AS gone FROM u{k} LEFT JOIN k{k} USING (vec_id)) WHERE gone = 0)")
    parts.append("th AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT vec_id, score AS s FROM k{k}" for k in range(rounds)) + f" UNION ALL SELECT vec_id, score FROM u{rounds})")
    parts.append("me AS (SELECT median(s) AS m FROM th), dv AS (SELECT m, median(abs(s - m)) AS d FROM th, me GROUP BY m), kk AS (SELECT greatest(1, least(count(*) FILTER (s >= m + 3 * 1.4826 * d), 50)) AS base FROM th, dv), tp AS (SELECT avg(s) AS t FROM (SELECT s FROM th ORDER BY s DESC LIMIT 5)), hd AS (SELECT count(*) FILTER (s >= 0.8 * t) AS h FROM th, tp)")
    return ", ".join(parts) + " SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id)::INTEGER AS rank FROM th QUALIFY rank <= (SELECT greatest(least(h, 50), base) FROM hd, kk)"


def like() -> str:
    """search_like_qbe in SQL: two channels, their qualities, and every seed held out in turn."""
    listed = ", ".join(map(str, SEEDS))
    groups = [SEEDS, *([x for x in SEEDS if x != s] for s in SEEDS)]
    parts = ["v AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS v0, embedding[33:64]::DOUBLE[] AS v1 FROM embeddings), n AS (SELECT count(*) AS n FROM v), l AS (SELECT greatest(2, round_even(n * f, 0)) AS d FROM n, (SELECT unnest([1/80, 1/40, 1/20, 1/10, 1/5, 2/5]) AS f))"]
    for c in (0, 1):
        parts.append(f"p{c} AS (SELECT a.vec_id, b.vec_id AS seed, list_inner_product(a.v{c}, b.v{c}) AS s FROM v a, v b WHERE b.vec_id IN ({listed}))")
        parts.append(f"h{c} AS (SELECT vec_id AS held, seed, s FROM p{c} WHERE vec_id IN ({listed}) AND vec_id <> seed)")
        parts.append(f"r{c} AS (SELECT held, h.seed, count(*) FILTER (p.s > h.s AND NOT (p.vec_id IN ({listed}) AND p.vec_id <> h.held)) AS r FROM h{c} h JOIN p{c} p ON p.seed = h.seed GROUP BY 1, 2)")
        parts.append(f"q{c} AS (SELECT avg((r < d)::INTEGER) AS q FROM r{c}, l)")
        for g, group in enumerate(groups):
            own = ", ".join(map(str, group))
            parts.append(f"m{c}{g} AS (SELECT list(x ORDER BY p) AS m FROM (SELECT p, avg(x) AS x FROM (SELECT unnest(v{c}) AS x, generate_subscripts(v{c}, 1) AS p FROM v WHERE vec_id IN ({own})) GROUP BY p))")
            parts.append(f"s{c}{g} AS (SELECT vec_id, list_inner_product(v{c}, m) / (sqrt(list_inner_product(m, m)) + 1e-8) AS s FROM v, m{c}{g}), z{c}{g} AS (SELECT vec_id, (s - avg(s) OVER ()) / stddev_pop(s) OVER () AS z FROM s{c}{g})")
    parts.append("w AS (SELECT (q0.q / greatest(q0.q, q1.q)) ** 8 AS w0, (q1.q / greatest(q0.q, q1.q)) ** 8 AS w1 FROM q0, q1)")
    for g in range(len(groups)):
        parts.append(f"f{g} AS (SELECT vec_id, w0 * a.z + w1 * b.z AS s FROM z0{g} a JOIN z1{g} b USING (vec_id), w)")
    ranks = " UNION ALL ".join(f"SELECT count(*) AS r FROM f{g + 1} WHERE vec_id NOT IN ({', '.join(str(x) for x in SEEDS if x != s)}) AND s > (SELECT s FROM f{g + 1} WHERE vec_id = {s})" for g, s in enumerate(SEEDS))
    parts.append(f"k AS (SELECT least(25, greatest(1, round_even(max(r) * {len(SEEDS) + 1} / {len(SEEDS)}, 0))) AS keep FROM ({ranks}))")
    return "WITH " + ", ".join(parts) + f" SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id)::INTEGER AS rank, round(s, 5) AS score FROM f0, k WHERE vec_id NOT IN ({listed}) QUALIFY rank <= any_value(keep) OVER ()"


QUERIES = {
    "rrf_fusion": (rrf_fusion, f"WITH {RK} SELECT vec_id, round(fused, 9) AS fused FROM fu"),
    "explain_fusion": (explain_fusion, f"WITH {RK} SELECT vec_id, round(fused, 9) AS fused, xa + 1.0::DOUBLE AS place_a, xb + 1.0::DOUBLE AS place_b FROM fu ORDER BY fu.fused DESC, vec_id LIMIT 20"),
    "rrf_abstain_median": (rrf_abstain_median, f"WITH {RK} SELECT vec_id, xb::DOUBLE AS rank FROM fu WHERE b IS NULL"),
    "rank_fraction": (rank_fraction, f"WITH {SC} SELECT vec_id, round((row_number() OVER (ORDER BY b, vec_id) - 1) / (count(*) OVER () - 1)::DOUBLE, 9) AS share FROM sc WHERE b IS NOT NULL UNION ALL SELECT vec_id, 0.5 FROM sc WHERE b IS NULL"),
    "answer_percentile_rank": (answer_percentile_rank, f"WITH {SC} SELECT vec_id, round((row_number() OVER (ORDER BY b, vec_id) - 1) / (count(*) OVER () - 1)::DOUBLE, 9) AS share FROM sc WHERE b IS NOT NULL UNION ALL SELECT vec_id, NULL FROM sc WHERE b IS NULL"),
    "z_blend": (z_blend, f"WITH {SC} SELECT vec_id, round(0.7 * (a - avg(a) OVER ()) / (stddev_pop(a) OVER () + 1e-8) + 0.3 * (b - avg(b) OVER ()) / (stddev_pop(b) OVER () + 1e-8), 6) AS blend FROM sc"),
    "variant_max": (variant_max, f"WITH {SC} SELECT vec_id, round(greatest(a, b), 6) AS best FROM sc"),
    "unanimous_filter": (unanimous_filter, f"WITH {SC}, f AS (SELECT vec_id, (row_number() OVER (ORDER BY a, vec_id) - 1) / (count(*) OVER () - 1)::DOUBLE AS fa FROM sc), g AS (SELECT vec_id, (row_number() OVER (ORDER BY b, vec_id) - 1) / (count(*) OVER () - 1)::DOUBLE AS fb FROM sc WHERE b IS NOT NULL) SELECT vec_id FROM f LEFT JOIN g USING (vec_id) WHERE greatest(fa, coalesce(fb, 0.5)) >= 0.33"),
    "confidence_cut": (confidence_cut, MAD + ", t AS (SELECT avg(s) AS t FROM (SELECT s FROM s ORDER BY s DESC LIMIT 5)), h AS (SELECT count(*) AS h FROM s, t WHERE s >= 0.6 * t) SELECT greatest(least(h, 100), greatest(1, least(k, 100)))::BIGINT AS keep FROM h, k"),
    "mad_cut": (mad_cut, MAD + " SELECT greatest(1, least(k, 100))::BIGINT AS keep FROM k"),
    "otsu_cut": (otsu_cut, f"WITH {SC}, h AS (SELECT a AS s FROM sc ORDER BY a DESC LIMIT 400), e AS (SELECT min(s) AS lo, max(s) AS hi FROM h), b AS (SELECT i, lo + (hi - lo) * (i + 0.5) / 64 AS mid, (SELECT count(*) FROM h WHERE least(63, floor((s - lo) * 64 / (hi - lo))) = i) AS n FROM range(64) r(i), e), c AS (SELECT i, mid, sum(n) OVER (ORDER BY i) / 400.0::DOUBLE AS w, sum(n * mid) OVER (ORDER BY i) / 400.0::DOUBLE AS m, sum(n * mid) OVER () / 400.0::DOUBLE AS t FROM b), v AS (SELECT mid FROM c WHERE w < 1 ORDER BY power(t * w - m, 2) / (w * (1 - w)) DESC, i LIMIT 1) SELECT least(100, greatest(1, count(*)))::BIGINT AS keep FROM (SELECT a AS s FROM sc ORDER BY a DESC LIMIT 100), v WHERE s >= mid"),
    "fit_cut_quantile": (_fit("quantile"), fit_sql("SELECT quantile_cont(s, 0.9) AS cut FROM s")),
    "knee_cut": (_fit("knee"), fit_sql("SELECT (s + t) / 2 AS cut FROM (SELECT s, lead(s) OVER (ORDER BY s) AS t, row_number() OVER (ORDER BY s) - 1 AS p, count(*) OVER () AS n FROM s) WHERE p >= floor(0.05 * n) AND p < floor(0.95 * n) - 1 ORDER BY t - s DESC, p LIMIT 1")),
    "fit_cut_otsu": (_fit("otsu"), fit_sql(OTSU)),
    "corroboration_veto": (corroboration_veto, f"WITH {SC}, s AS (SELECT a, coalesce(b, 0) AS b, -a AS c FROM sc), z AS (SELECT (a - avg(a) OVER ()) / (stddev_pop(a) OVER () + 1e-8) AS a, (b - avg(b) OVER ()) / (stddev_pop(b) OVER () + 1e-8) AS b, (c - avg(c) OVER ()) / (stddev_pop(c) OVER () + 1e-8) AS c FROM s) SELECT 'a' AS channel, CASE WHEN corr(a, b + c) < 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS weight FROM z UNION ALL SELECT 'b', CASE WHEN corr(b, a + c) < 0 THEN 0.0 ELSE 1.0 END FROM z UNION ALL SELECT 'c', CASE WHEN corr(c, a + b) < 0 THEN 0.0 ELSE 1.0 END FROM z"),
    "informativeness": (informativeness, f"WITH {SC} SELECT round(1 - abs(corr(a, b)), 6) AS informativeness FROM sc"),
    "rank_correlation": (rank_correlation, f"WITH {SC}, r AS (SELECT row_number() OVER (ORDER BY a, vec_id) AS x, row_number() OVER (ORDER BY b, vec_id) AS y FROM sc WHERE b IS NOT NULL) SELECT round(corr(x, y), 6) AS spearman FROM r"),
    "prf_centroid": (prf_centroid, f"WITH {SC}, t AS (SELECT vec_id FROM sc ORDER BY a DESC, vec_id LIMIT 25), f AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE vec_id IN (FROM t)), m AS (SELECT list(m ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS m FROM f GROUP BY 1)), e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(list_inner_product(e, m) / (sqrt(list_inner_product(m, m)) + 1e-8) / (sqrt(list_inner_product(e, e)) + 1e-8), 6) AS feedback FROM e, m"),
    "permutation_rerank": (permutation_rerank, f"WITH {SC}, h AS (SELECT vec_id, a, coalesce(b, -9) AS b FROM sc ORDER BY a DESC, vec_id LIMIT 30), v AS (SELECT a, row_number() OVER (ORDER BY a DESC, vec_id) AS k FROM h), w AS (SELECT vec_id, row_number() OVER (ORDER BY b DESC, vec_id) AS k FROM h) SELECT vec_id, round(a, 6) AS a FROM w JOIN v USING (k) UNION ALL SELECT vec_id, round(a, 6) FROM sc WHERE vec_id NOT IN (SELECT vec_id FROM h)"),
    "tail_concentration": (tail_concentration, f"WITH {SC} SELECT round((quantile_cont(a, 0.99) - quantile_cont(a, 0.5)) / (quantile_cont(a, 0.99) - quantile_cont(a, 0.01)), 6) AS tail FROM sc"),
    "auc_rank_sum": (auc_rank_sum, f"WITH {SC}, r AS (SELECT label = 3 AS t, row_number() OVER (ORDER BY a) AS k FROM sc), c AS (SELECT count(*) FILTER (t) AS n, count(*) FILTER (NOT t) AS m, sum(k) FILTER (t) AS s FROM r) SELECT round((s - n * (n + 1) / 2.0::DOUBLE) / (n * m), 6) AS auc FROM c"),
    "retrieval_metrics": (retrieval_metrics, "WITH s AS (SELECT a.vec_id AS query, a.label AS want, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), t AS (SELECT query, rank, (want = label)::INTEGER AS truth, sum((want = label)::INTEGER) OVER (PARTITION BY query ORDER BY rank) AS hits FROM s WHERE rank <= 20), g AS (SELECT query, sum(truth) FILTER (rank <= 10) AS k, sum(truth) AS n, max(CASE WHEN truth = 1 THEN 1.0::DOUBLE / rank END) AS rr, sum(truth * hits / rank::DOUBLE) AS ap, sum(truth / log2(rank + 1)) AS dcg FROM t GROUP BY 1) SELECT query, round(k / 10.0::DOUBLE, 6) AS precision, round(k / n::DOUBLE, 6) AS yield, round(rr, 6) AS reciprocal_rank, round(ap / n, 6) AS average_precision, round(dcg / list_sum(list_transform(range(1, n::BIGINT + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM g"),
    "nms_temporal": (nms_temporal, suppressed(2)),
    "search_like_qbe": (search_like_qbe, like()),
    "loo_quality": (loo_quality, f"WITH {PAIR}, h AS (SELECT vec_id AS held, seed, s FROM p WHERE vec_id IN ({SEEDLIST}) AND vec_id <> seed), r AS (SELECT held, h.seed, count(*) FILTER (p.s > h.s AND NOT (p.vec_id IN ({SEEDLIST}) AND p.vec_id <> h.held)) AS r FROM h JOIN p ON p.seed = h.seed GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM embeddings), l AS (SELECT greatest(2, round_even(n * f, 0)) AS d FROM n, (SELECT unnest([1/80, 1/40, 1/20, 1/10, 1/5, 2/5]) AS f)) SELECT round(avg((r < d)::INTEGER), 6) AS quality FROM r, l"),
    "coherence_weight": (coherence_weight, f"WITH {PAIR}, w AS (SELECT s FROM p WHERE vec_id IN ({SEEDLIST}) AND vec_id < seed), b AS (SELECT s FROM p WHERE vec_id NOT IN ({SEEDLIST})), u AS (SELECT avg((b.s < w.s)::INTEGER) AS u FROM w, b) SELECT round(greatest(u - 0.5, 0) * 2, 6) AS coherence FROM u"),
    "answer_join": (answer_join, f"WITH {EV}, v AS (SELECT user_id, (row_number() OVER (ORDER BY value, event_id) - 1) / (count(*) OVER () - 1)::DOUBLE AS x, (row_number() OVER (ORDER BY ts, event_id) - 1) / (count(*) OVER () - 1)::DOUBLE AS y FROM ev WHERE stream = 'view'), c AS (SELECT user_id, (row_number() OVER (ORDER BY value, event_id) - 1) / (count(*) OVER () - 1)::DOUBLE AS x FROM ev WHERE stream = 'click'), k AS (SELECT user_id, max(least(x, y)) AS s FROM v GROUP BY 1 UNION ALL SELECT user_id, max(x) FROM c GROUP BY 1) SELECT user_id AS episode, round(min(s), 6) AS score, count(*) AS kinds FROM k GROUP BY 1"),
    "metadata_plan": (metadata_plan, "SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "label_lookup": (label_lookup, "SELECT DISTINCT doc_id FROM labels WHERE quality IN (1) AND toxic = 0"),
    "flag_lookup": (flag_lookup, f"WITH {EV} SELECT user_id, max((stream = 'purchase')::INTEGER) AS has_purchase, max((value > 200)::INTEGER) AS has_large FROM ev GROUP BY 1 HAVING max((stream = 'purchase')::INTEGER) = 1 OR max((value > 200)::INTEGER) = 1"),
    "two_hop_objects": (two_hop_objects, "SELECT l_orderkey AS episode, count(DISTINCT l_partkey) AS shared FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = 7) AND l_orderkey <> 7 GROUP BY 1"),
    "anti_exclusion": (anti_exclusion, "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 2)"),
    "recall_resolution": (recall_resolution, f"WITH {SC}, s AS (SELECT vec_id, label, round(a, 9) AS a FROM sc WHERE round(a, 9) >= 0), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY a DESC, vec_id) AS k, count(*) OVER (PARTITION BY label) AS support FROM s) SELECT label, vec_id, round(a, 6) AS best, support FROM r WHERE k = 1"),
    "search_set_pipeline": (search_set_pipeline, search_set()),
    "dtw_anchored": (dtw_anchored, nearest_warped()),
    "dtw_banded": (dtw_banded, nearest_warped(band=0.25, places=True)),
    "dtw_free_ends": (dtw_free_ends, nearest_warped(free=True)),
    "dtw_subsequence": (dtw_subsequence, warped(0, 6, 1.0, 0.0, 0.05, True) + " SELECT user_id, e AS start, j AS \"end\", round(t / 6, 6) AS cost FROM t5 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t, j) = 1"),
    "localize_rigid": (localize_rigid, placed(4, 10, UNIT + ROWS_OF.format(low=4, high=10)) + " SELECT * FROM l"),
    "nw_chain": (nw_chain, CHAINS),
    "changepoints": (changepoints, None),
    "event_segmentation": (event_segmentation, None),
    "foote_novelty": (foote_novelty, FOOTE),
    "arc_resampling": (arc_resampling, ARC),
    "gallery_assign": (gallery_assign, None),
}

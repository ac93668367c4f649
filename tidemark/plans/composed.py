"""Queries over searches in stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.vectors import constant, dot
from tidemark.operators import recall, text
from tidemark.plans.common import DOT, EV, embeddings, events, store, vector_of
from tidemark.session import table

Q, R = 5, 17


def _query(vec_id: int) -> str:
    return f"(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {vec_id})"


def relation_cues(spark, d):
    return table(spark, d, "benchmark").select("item_id", recall.relation(F.col("text")).alias("relation"))


def episode_kinds(spark, d):
    return recall.kinds_of(events(spark, d), "user_id", "stream").select("user_id", F.array_join("kinds", ",").alias("kinds"))


def _windows(spark, d):
    """Vectors as windows: a stream for each label, a window of two steps every step."""
    return embeddings(spark, d).select("vec_id", F.col("label").alias("stream"), F.col("vec_id").alias("ts"), (F.col("vec_id") + 2).alias("t1"), "embedding")


def verified_search(spark, d):
    q, r = vector_of(spark, d, Q), vector_of(spark, d, R)
    motion = F.when(F.col("vec_id") % 3 != 0, dot(F.slice("embedding", 1, 16), constant(q[:16])))
    atoms = {"q": dot(F.col("embedding"), constant(q)), "r": dot(F.col("embedding"), constant(r))}
    found = recall.verified_search(_windows(spark, d), "stream", atoms, {"motion": motion}, 12, where=F.col("stream") < 8)
    return found.select("stream", "ts", "t1", "windows", "rank", F.round("score", 9).alias("score"))


def content_gated_recall(spark, d):
    q = vector_of(spark, d, Q)
    w = _windows(spark, d).withColumn("look", dot(F.col("embedding"), constant(q)))
    plausible = w.orderBy(F.col("look").desc(), "vec_id").limit(60)
    recordings = w.where("vec_id % 4 = 0").withColumn("motion", dot(F.slice("embedding", 1, 16), constant(q[16:32])))
    found = recall.content_gated(plausible, recordings, "stream", "motion", 24)
    return found.select("stream", "recording", "rank", F.round("motion", 6).alias("motion"))


def context_hybrid_search(spark, d):
    q = vector_of(spark, d, Q)
    words = text.words(F.col("text"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.when(F.col("lang") == "en", F.size(F.filter(words, lambda w: w == "the")) / (F.size(words) + 1)).alias("words"))
    own = embeddings(spark, d).join(docs, "vec_id", "left")
    channels = {"appearance": dot(F.slice("embedding", 1, 32), constant(q[:32])), "context": dot(F.slice("embedding", 33, 32), constant(q[32:])), "lexical": F.col("words")}
    found = recall.context_search(own, "vec_id", channels, {"lexical": 0.5}, 20, F.col("label").isin(0, 1, 2, 3, 4, 5))
    return found.select("vec_id", "rank", F.round("score", 9).alias("score"))


def sharp_search(spark, d):
    """A search and the same one again: the second makes no vector."""
    e, q = embeddings(spark, d), vector_of(spark, d, Q)
    cache = store(spark).table("refined")
    make = lambda rows: rows.select("vec_id", F.col("embedding").alias("vector"))
    cheap = dot(F.slice("embedding", 1, 16), constant(q[:16]))
    _, first = recall.sharp_search(e, "vec_id", cheap, make, cache, q)
    found, again = recall.sharp_search(e, "vec_id", cheap, make, cache, q)
    return found.select("vec_id", "rank", F.round("score", 6).alias("score"), F.lit(first).cast("long").alias("made"), F.lit(again).cast("long").alias("made_again"))


def student_search(spark, d):
    e, q = embeddings(spark, d), vector_of(spark, d, Q)
    both = e.select("vec_id").select("vec_id", F.explode(F.array(F.col("vec_id") - 1, F.col("vec_id") + 1, F.col("vec_id") + 2)).alias("neighbour")).join(e.select(F.col("vec_id").alias("neighbour")), "neighbour", "left_semi").select("vec_id", "neighbour")
    found = recall.student_search(e, "vec_id", "embedding", q, F.col("label").isin(1, 5, 7), both, 15)
    return found.select("vec_id", "rank", F.round("score", 6).alias("score"))


def agent_selection(spark, d):
    points = events(spark, d).select((F.col("user_id") % 40).alias("segment"), "user_id", "ts", "event_id", F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    points = points.groupBy("segment", "user_id", "ts").agg(F.max_by("x", "event_id").alias("x"), F.max_by("y", "event_id").alias("y"))
    return recall.agents(points, "segment", "user_id", "ts", "x", "y").select("segment", "user_id", F.round("score", 4).alias("score"))


def basis_similar(spark, d):
    """Vectors of a refitted basis within a time range; rows that came in the old basis afterwards are not compared."""
    own = store(spark).table("clips")
    e = embeddings(spark, d).select(F.col("vec_id").alias("ts"), "vec_id", F.col("embedding").alias("raw"), F.col("embedding").alias("vector"), F.lit("first").alias("basis"))
    own.append(e.where("vec_id % 10 <> 3"), kind="embeddings")
    basis = recall.refit(own, "raw", "vector", "second")
    own.append(e.where("vec_id % 10 = 3"), kind="embeddings")
    probe = spark.createDataFrame([(vector_of(spark, d, Q),)], "v array<double>").select(recall.project(F.col("v"), basis).alias("v")).first()["v"]
    return recall.similar(own, "vector", list(probe), 15, "vec_id", "second", 20, 160).select("vec_id", "rank", F.round("score", 6).alias("score"))


def audit_turns(spark, d):
    own, ev = store(spark).table("turns"), events(spark, d)
    recall.log_turn(own, ev.select("ts", F.col("event_id").alias("turn"), F.col("stream").alias("heard")))
    recall.finish_turn(own, ev.where("event_id % 3 = 0").select((F.col("ts") + 5).alias("ts"), F.col("event_id").alias("turn"), (F.col("value") > 20).alias("finished")))
    return recall.turns_now(own).select("turn", "heard", "finished", "ts")


CUES = sorted(((p, name) for name, own in recall.RELATIONS.items() for p in own), key=lambda x: -len(x[0]))
RANK = "SELECT {key}, row_number() OVER (ORDER BY {c} DESC, {key}) - 1 AS x FROM {t} WHERE {c} IS NOT NULL"


def _fused(source: str, key: str, channels: dict[str, float]) -> str:
    """CTEs of ranks, medians for what abstains, and the fused score, over a CTE."""
    parts = []
    for c in channels:
        parts.append(f"r0{c} AS ({RANK.format(key=key, c=c, t=source)}), r{c} AS (SELECT t.{key}, coalesce(r0{c}.x, (SELECT median(x) FROM r0{c}), 0) AS x FROM {source} t LEFT JOIN r0{c} USING ({key}))")
    total = " + ".join(f"{w}::DOUBLE / (61 + r{c}.x)" for c, w in channels.items())
    return ", ".join(parts) + f", fu AS (SELECT t.*, {total} AS score FROM {source} t " + " ".join(f"JOIN r{c} USING ({key})" for c in channels) + ")"


VERIFIED = f"""
    WITH w AS (SELECT vec_id, label AS stream, vec_id AS ts, vec_id + 2 AS t1, {DOT.format(a="embedding", b=_query(Q))} AS q, {DOT.format(a="embedding", b=_query(R))} AS r,
               CASE WHEN vec_id % 3 <> 0 THEN {DOT.format(a="embedding[1:16]", b=_query(Q) + "[1:16]")} END AS motion FROM embeddings WHERE label < 8),
    n AS (SELECT greatest(greatest(48, least(greatest(count(*) // 1500, 120), 256)) // 2, 12) AS per FROM w),
    c AS (SELECT *, (q + r) / 2 AS appearance FROM w QUALIFY row_number() OVER (ORDER BY q DESC, stream, ts) <= (SELECT per FROM n) OR row_number() OVER (ORDER BY r DESC, stream, ts) <= (SELECT per FROM n)),
    g AS (SELECT *, CASE WHEN ts - 2 <= max(t1 + 2) OVER (PARTITION BY stream ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM c),
    h AS (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY ts) AS run FROM g),
    s AS (SELECT row_number() OVER (ORDER BY stream, min(ts)) AS id, stream, min(ts) AS ts, max(t1) AS t1, count(*) AS windows, max(appearance) AS appearance, max(motion) AS motion FROM h GROUP BY stream, run),
    {_fused("s", "id", {"appearance": 1.0, "motion": 1.0})}
    SELECT stream, ts, t1, windows, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank, round(score, 9) AS score FROM fu QUALIFY rank <= 12
"""
GATED = f"""
    WITH w AS (SELECT vec_id, label AS stream, vec_id AS ts, {DOT.format(a="embedding", b=_query(Q))} AS look, {DOT.format(a="embedding[1:16]", b=_query(Q) + "[17:32]")} AS motion FROM embeddings),
    p AS (SELECT stream, ts FROM w ORDER BY look DESC, vec_id LIMIT 60), r AS (SELECT stream, ts, motion FROM w WHERE vec_id % 4 = 0),
    h AS (SELECT DISTINCT p.stream, r.ts AS recording, r.motion FROM p ASOF JOIN r ON p.stream = r.stream AND p.ts >= r.ts)
    SELECT stream, recording, row_number() OVER (ORDER BY motion DESC, stream, recording)::INTEGER AS rank, round(motion, 6) AS motion FROM h QUALIFY rank <= 24
"""
WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}]+')"
CONTEXT = f"""
    WITH s AS (SELECT e.vec_id, {DOT.format(a="embedding[1:32]", b=_query(Q) + "[1:32]")} AS appearance, {DOT.format(a="embedding[33:64]", b=_query(Q) + "[33:64]")} AS context,
               CASE WHEN lang = 'en' THEN len(list_filter({WORDS}, lambda w: w = 'the'))::DOUBLE / (len({WORDS}) + 1) END AS lexical
               FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id WHERE label IN (0, 1, 2, 3, 4, 5)),
    {_fused("s", "vec_id", {"appearance": 1.0, "context": 1.0, "lexical": 0.5})}
    SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id)::INTEGER AS rank, round(score, 9) AS score FROM fu QUALIFY rank <= 20
"""
SHARP = f"""
    WITH w AS (SELECT vec_id, embedding, {DOT.format(a="embedding[1:16]", b=_query(Q) + "[1:16]")} AS cheap FROM embeddings), s AS (SELECT * FROM w ORDER BY cheap DESC, vec_id LIMIT 48),
    t AS (SELECT vec_id, {DOT.format(a="embedding", b=_query(Q))} AS score FROM s)
    SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id)::INTEGER AS rank, round(score, 6) AS score, (SELECT count(*) FROM s) AS made, 0::BIGINT AS made_again FROM t QUALIFY rank <= 10
"""
STUDENT = f"""
    WITH a AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, {DOT.format(a="embedding", b=_query(Q))} AS s FROM embeddings),
    b AS (SELECT e FROM a ORDER BY s DESC, vec_id LIMIT 25), f AS (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS p FROM b),
    m AS (SELECT list(x ORDER BY p) AS c FROM (SELECT p, avg(x) AS x FROM f GROUP BY p)),
    c AS (SELECT vec_id, CASE WHEN label IN (1, 5, 7) THEN 1.0 ELSE 0.0 END::DOUBLE AS have, s + 0.5 * {DOT.format(a="e", b="c")} / (sqrt({DOT.format(a="c", b="c")}) + 1e-8) AS s FROM a, m),
    h AS (SELECT have FROM c ORDER BY s DESC, vec_id LIMIT 20),
    g AS (SELECT vec_id, s + CASE WHEN (SELECT avg(have) FROM h) >= 0.35 THEN 0.5 * have * (SELECT stddev_pop(s) FROM c) ELSE 0 END AS s FROM c),
    t AS (SELECT vec_id FROM g ORDER BY s DESC, vec_id LIMIT 20),
    n AS (SELECT x.vec_id, avg(CASE WHEN x.vec_id + o IN (SELECT vec_id FROM t) THEN 1.0 ELSE 0.0 END) AS d FROM g x, (VALUES (-1), (1), (2)) v(o) WHERE x.vec_id + o IN (SELECT vec_id FROM g) GROUP BY 1),
    z AS (SELECT g.vec_id, g.s + 0.5 * coalesce(n.d, 0) * (SELECT stddev_pop(s) FROM g) AS s FROM g LEFT JOIN n USING (vec_id))
    SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id)::INTEGER AS rank, round(s, 6) AS score FROM z QUALIFY rank <= 15
"""
AGENTS = f"""
    WITH {EV}, p AS (SELECT user_id % 40 AS segment, user_id, ts, arg_max(value, event_id) AS x, arg_max((event_id % 97)::DOUBLE, event_id) AS y FROM ev GROUP BY 1, 2, 3),
    s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM p WINDOW w AS (PARTITION BY segment, user_id ORDER BY ts)),
    t AS (SELECT segment, user_id, sum(d) AS path, min(ts) AS a, max(ts) AS b, count(*) AS n FROM s GROUP BY 1, 2),
    g AS (SELECT segment, greatest(max(b) - min(a), 1) AS span FROM t GROUP BY 1)
    SELECT segment, user_id, round(path * (b - a) / span, 4) AS score FROM t JOIN g USING (segment) WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY segment ORDER BY path * (b - a) / span DESC, user_id) = 1
"""
BASIS = f"""
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS p FROM e WHERE vec_id % 10 <> 3),
    b AS (SELECT list(m ORDER BY p) AS m, list(s ORDER BY p) AS s FROM (SELECT p, avg(x) AS m, stddev_pop(x) AS s FROM f GROUP BY p)),
    z AS (SELECT vec_id, list_transform(range(1, len(v) + 1), lambda i: (v[i] - m[i]) / s[i]) AS z FROM e, b),
    u AS (SELECT vec_id, z, sqrt({DOT.format(a="z", b="z")}) + 1e-8 AS l FROM z), q AS (SELECT z AS qz, l AS ql FROM u WHERE vec_id = {Q}),
    t AS (SELECT vec_id, {DOT.format(a="z", b="qz")} / (l * ql) AS score FROM u, q WHERE vec_id % 10 <> 3 AND vec_id BETWEEN 20 AND 160)
    SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id)::INTEGER AS rank, round(score, 6) AS score FROM t QUALIFY rank <= 15
"""

def channel_operators(spark, d):
    """Two channels whose tables declare how they are scored, one by an operator registered for it."""
    from tidemark.functions import registry

    registry.register_operator("first", lambda a, b: F.element_at(a, 1) - F.element_at(b, 1))
    own, q = store(spark), vector_of(spark, d, Q)
    rows = embeddings(spark, d).select(F.col("vec_id").alias("ts"), "vec_id", "embedding")
    own.table("look").append(rows, kind="embeddings")
    own.table("edge").append(rows, kind="embeddings", notes={"op": "first"})
    parts = [registry.channel_score(own.table(n), "embedding", q).select(F.lit(n).alias("channel"), F.lit(registry.operator_of(own.table(n))).alias("op"), "vec_id", F.round("score", 6).alias("score")) for n in ("look", "edge")]
    return parts[0].unionByName(parts[1])


def sql_functions(spark, d):
    from tidemark.functions import registry

    registry.register_sql(spark)
    embeddings(spark, d).createOrReplaceTempView("tidemark_vectors")
    return spark.sql(f"SELECT a.vec_id, round(vector_cosine(a.embedding, b.embedding), 6) AS cosine, round(vector_dot(a.embedding, slice(b.embedding, 1, 3)), 6) AS differing, overlaps(a.vec_id, NULL, 10, 90) AS inside FROM tidemark_vectors a JOIN tidemark_vectors b ON b.vec_id = {Q}")


QUERIES = {
    "channel_operators": (channel_operators, f"SELECT 'look' AS channel, 'cosine' AS op, vec_id, round({DOT.format(a='embedding', b=_query(Q))}, 6) AS score FROM embeddings UNION ALL SELECT 'edge', 'first', vec_id, round(embedding[1]::DOUBLE - {_query(Q)}[1], 6) FROM embeddings"),
    "sql_functions": (sql_functions, f"SELECT vec_id, round({DOT.format(a='embedding', b=_query(Q))} / (sqrt({DOT.format(a='embedding', b='embedding')}) * sqrt({DOT.format(a=_query(Q), b=_query(Q))})), 6) AS cosine, NULL::DOUBLE AS differing, vec_id BETWEEN 10 AND 90 AS inside FROM embeddings"),
    "relation_cues": (relation_cues, "SELECT item_id, CASE " + " ".join(f"WHEN contains(lower(text), '{p}') THEN '{n}'" for p, n in CUES) + " END AS relation FROM benchmark"),
    "episode_kinds": (episode_kinds, f"WITH {EV} SELECT user_id, array_to_string(list_sort(list_distinct(list(stream))), ',') AS kinds FROM ev GROUP BY user_id"),
    "verified_search": (verified_search, VERIFIED),
    "content_gated_recall": (content_gated_recall, GATED),
    "context_hybrid_search": (context_hybrid_search, CONTEXT),
    "sharp_search": (sharp_search, SHARP),
    "student_search": (student_search, STUDENT),
    "agent_selection": (agent_selection, AGENTS),
    "basis_similar": (basis_similar, BASIS),
    "audit_turns": (audit_turns, f"WITH {EV} SELECT event_id AS turn, stream AS heard, CASE WHEN event_id % 3 = 0 THEN value > 20 END AS finished, CASE WHEN event_id % 3 = 0 THEN ts + 5 ELSE ts END AS ts FROM ev"),
}

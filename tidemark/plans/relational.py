"""Queries of the SQL surface: joins, grouping, windows, sets and functions, and the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import text
from tidemark.session import table

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def sql(query: str):
    """A query in Spark SQL over the driver's tables."""

    def run(spark, d):
        for n in NAMES:
            if n in query:
                table(spark, d, n).createOrReplaceTempView(n)
        return spark.sql(query)

    return run


def both(query: str) -> tuple:
    """A query that both engines read alike."""
    return sql(query), query


def attested_vocab(spark, d):
    return text.document_frequency(table(spark, d, "documents").where("lang = 'en'"), "text", 5, 0.5)


def idf_names(spark, d):
    out = text.inverse_frequency(table(spark, d, "documents"), "source")
    return out.select("source", "rows", F.round("weight", 6).alias("weight"))


def tfidf_score(spark, d):
    docs = table(spark, d, "documents")
    return text.query_scores(docs, "doc_id", text.words(F.col("text")), {"the": 0.5, "of": 0.25, "with": 1.0}).select("doc_id", F.round("score", 6).alias("score"))


def char_ngram_overlap(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(text.char_grams(F.col("text"), 3, 3))).alias("g"))
    items = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(text.char_grams(F.col("text"), 3, 3))).alias("g"))
    return docs.join(items, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared")).where("shared > 100")


def char_tfidf_norm(spark, d):
    docs = table(spark, d, "documents")
    return text.char_tf_idf(docs, "doc_id", "text", lambda _, w: float(w @ w)).select("doc_id", F.round("value", 6).alias("norm"))


def latent_semantics(spark, d):
    docs = table(spark, d, "documents")
    return text.latent_semantics(docs, "doc_id", "text", 8, 512).select("doc_id", F.size("vector").alias("dimensions"))


def query_hash(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.query_hash(F.col("text")).alias("hash"))


def media_ids(spark, d):
    urls = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    return text.media_ids(urls, "path").select("page_id", "media_id")


def document_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where("trim(line) <> ''").groupBy("line").agg(F.countDistinct("doc_id").alias("docs")).where("docs > 3")


HASH = "WITH h AS (SELECT item_id, sha1(lower(trim(text))) AS x FROM benchmark), s AS (SELECT item_id, substr(x, 15, 2) || substr(x, 13, 2) || substr(x, 11, 2) || substr(x, 9, 2) || substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2) AS y FROM h), u AS (SELECT item_id, ('0x' || y)::UBIGINT::HUGEINT AS u FROM s) SELECT item_id, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS hash FROM u"
WORDS = "regexp_extract_all(lower(text), '[\\p{L}]+')"
TFIDF = f"WITH f AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents), t AS (SELECT doc_id, term, 1 + ln(count(*)) AS tf FROM f GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents), i AS (SELECT term, ln((1 + n) / (1 + count(*))::DOUBLE) + 1 AS idf FROM t, n GROUP BY term, n), w AS (SELECT doc_id, term, tf * idf AS w FROM t JOIN i USING (term)), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1) SELECT doc_id, round(sum(w / l * CASE term WHEN 'the' THEN 0.5 WHEN 'of' THEN 0.25 ELSE 1.0 END), 6) AS score FROM w JOIN l USING (doc_id) WHERE term IN ('the', 'of', 'with') GROUP BY 1"
GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower(text), '[\\p{L}]+'), lambda w: list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3)))))"

MEDIA = r"""
    WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages),
    s AS (SELECT *, regexp_extract(path, '([^/]+?)(?:\.[^./]*)?$', 1) AS s, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS f FROM p), q AS (SELECT *, f || '_' || s AS p FROM s),
    a AS (SELECT s, count(DISTINCT path) AS n FROM q GROUP BY 1), b AS (SELECT p, count(DISTINCT path) AS n FROM q GROUP BY 1)
    SELECT page_id, CASE WHEN a.n = 1 THEN q.s WHEN b.n = 1 THEN q.p ELSE q.p || '_' || sha1(path)[1:8] END AS media_id FROM q JOIN a ON q.s = a.s JOIN b ON q.p = b.p
"""

QUERIES = {
    "attested_vocab": (attested_vocab, f"WITH d AS (SELECT doc_id, unnest(list_distinct({WORDS})) AS word FROM documents WHERE lang = 'en') SELECT word, count(*) AS df FROM d GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.5 * (SELECT count(*) FROM documents WHERE lang = 'en')"),
    "idf_names": (idf_names, "SELECT source, count(*) AS rows, round(ln((SELECT count(*) FROM documents) / count(*)::DOUBLE) / ln((SELECT count(*) FROM documents)), 6) AS weight FROM documents GROUP BY 1"),
    "tfidf_score": (tfidf_score, TFIDF),
    "char_ngram_overlap": (char_ngram_overlap, f"WITH d AS (SELECT doc_id, unnest({GRAMS}) AS g FROM documents), b AS (SELECT item_id, unnest({GRAMS}) AS g FROM benchmark) SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (g) GROUP BY 1, 2 HAVING count(*) > 100"),
    "char_tfidf_norm": (char_tfidf_norm, "SELECT doc_id, 1.0::DOUBLE AS norm FROM documents"),
    "latent_semantics": (latent_semantics, "SELECT doc_id, 8 AS dimensions FROM documents"),
    "query_hash": (query_hash, HASH),
    "media_ids": (media_ids, MEDIA),
    "document_lines": (document_lines, "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT line, count(DISTINCT doc_id) AS docs FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) > 3"),
    "norm_argmax": (sql("SELECT source, max_by(lang, struct(n, lang)) AS norm, max(n) AS evidence FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1"), "SELECT source, lang AS norm, n AS evidence FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang DESC) AS k FROM documents GROUP BY 1, 2) WHERE k = 1"),
    "skill_rates": both("SELECT l_returnflag AS skill, l_linestatus AS strategy, count(*) AS n_try, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS n_ok, round(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) / (count(*) * 1.0e0), 6) AS rate FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "clip_stats": both("SELECT count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(count(*) / (count(DISTINCT conv_id) * 1.0e0), 6) AS per_conversation, max(turn) AS last_turn FROM conversations"),
    "q_pricing_summary": both("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02' GROUP BY l_returnflag, l_linestatus"),
    "q_join_inner": both("SELECT n_name, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "q_join_left": both("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY c_custkey"),
    "q_join_full": both("SELECT coalesce(a.k, b.k) AS k, a.n AS orders, b.n AS lines FROM (SELECT o_orderkey % 50 AS k, count(*) AS n FROM orders GROUP BY o_orderkey % 50) a FULL OUTER JOIN (SELECT l_orderkey % 70 AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey % 70) b ON a.k = b.k"),
    "q_join_using": both("SELECT s, a, b FROM (SELECT n_regionkey AS s, count(*) AS a FROM nation GROUP BY n_regionkey) x JOIN (SELECT r_regionkey AS s, max(r_name) AS b FROM region GROUP BY r_regionkey) y USING (s)"),
    "q_join_theta": both("SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey"),
    "q_semi": both("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)"),
    "q_anti": both("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "q_cube": both("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "q_rollup": both("SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)"),
    "q_grouping_sets": both("SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    "q_window_frames": both("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS place, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS quarter FROM orders"),
    "q_setops_union": both("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region"),
    "q_setops_intersect": both("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size < 10"),
    "q_setops_except": both("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 30"),
    "q_topk": both("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "q_cte_scalar": both("WITH m AS (SELECT avg(o_totalprice) AS a FROM orders) SELECT count(*) AS n FROM orders WHERE o_totalprice > 1.5e0 * (SELECT a FROM m)"),
    "q_string_fn": both("SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substr(p_type, 1, 5) AS t, replace(p_brand, 'Brand', 'B') AS b, concat(p_brand, '/', p_type) AS c, trim(p_name) AS s FROM part"),
    "q_date_fn": (sql("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q, datediff(date '2002-01-01', cast(o_orderdate AS date)) AS days FROM orders"), "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q, date_diff('day', o_orderdate::DATE, DATE '2002-01-01') AS days FROM orders"),
    "q_math_fn": both("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS r, round(power(p_size, 2), 2) AS p, round(ln(p_retailprice), 6) AS l, floor(p_retailprice) AS f, p_size % 7 AS m, abs(-p_size) AS a FROM part"),
    "q_array_fn": (sql("SELECT c_nationkey, sort_array(collect_set(c_mktsegment)) AS segments, size(collect_set(c_mktsegment)) AS n FROM customer GROUP BY c_nationkey"), "SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS segments, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1"),
    "q_map_fn": (sql("SELECT conv_id, map_from_entries(collect_list(struct(turn, role)))[0] AS first FROM conversations GROUP BY conv_id HAVING count(DISTINCT turn) = count(*)"), "SELECT conv_id, max(role) FILTER (turn = 0) AS first FROM conversations GROUP BY 1 HAVING count(DISTINCT turn) = count(*)"),
    "q_json_fn": (sql("SELECT event_id, cast(get_json_object(props, '$.k') AS bigint) AS k FROM events"), "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events"),
    "q_distinct_agg": both("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, sum(DISTINCT o_orderkey % 100) AS s FROM orders GROUP BY o_orderpriority"),
    "q_filter_agg": both("SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS large, count(*) AS n FROM orders GROUP BY o_orderstatus"),
    "q_correlation": both("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(stddev_pop(l_discount), 6) AS d, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem"),
    "q_percentiles": (sql("SELECT l_returnflag, round(percentile(l_extendedprice, 0.5), 4) AS median, round(percentile(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag"), "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1"),
    "q_approx_distinct": (sql("SELECT approx_count_distinct(l_partkey) AS parts FROM lineitem"), None),
    "q_pivot": (sql("SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) PIVOT (count(o_totalprice) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))"), "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1"),
    "page_titles": (sql("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS n FROM pages"), "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS n FROM pages"),
}

"""Queries over stores and scans."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tidemark.operators.intervals import density
from tidemark.plans.common import DAY, EV, IV, T0, T1, event_store, events, intervals, store
from tidemark.sources.log import CommitConflict
from tidemark.sources.store import to_ns


def scan_time_window(spark, d):
    return event_store(spark, d).table("events").scan(T0, T1).select("event_id", "ts", "value")


def scan_projection(spark, d):
    return event_store(spark, d).table("events").scan(T0, T1, columns=["value"])


def scan_values_in(spark, d):
    own = store(spark)
    own.table("events").set_layout("user_id")
    own.table("events").append(events(spark, d))
    return own.table("events").scan_values("user_id", [3, 7, 11], columns=["event_id", "user_id"])


def where_between(spark, d):
    return event_store(spark, d).table("events").where("value", "between", 10.0, 20.0, columns=["event_id", "value"])


def predicate_conjunction(spark, d):
    return event_store(spark, d).table("events").scan(predicate="value > 10 and stream = 'click' and ts >= %d" % T0, columns=["event_id", "stream", "value"])


def interval_overlap_scan(spark, d):
    own = store(spark)
    own.table("spans").append(intervals(spark, d))
    return own.table("spans").scan(T0, T0 + DAY // 4).select("event_id", "ts", "t1")


def multi_table_window(spark, d):
    own = event_store(spark, d)
    own.table("spans").append(intervals(spark, d))
    found, _ = own.window(T0, T1)
    return found["events"].select(F.lit("events").alias("source"), "event_id").unionByName(found["spans"].select(F.lit("spans").alias("source"), "event_id"))


def time_travel_v2(spark, d):
    return event_store(spark, d, 4).table("events").dataframe(version=1).select("event_id", "ts")


def snapshot_sql(spark, d):
    own = event_store(spark, d)
    pinned = own.snapshot()
    own.table("events").append(events(spark, d).limit(5))
    return own.sql("SELECT stream, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY stream", pinned)


def delete_range_view(spark, d):
    own = event_store(spark, d)
    own.table("events").delete_range(T0, T1)
    return own.table("events").dataframe().select("event_id", "ts")


def additive_evolution(spark, d):
    own, ev = store(spark), events(spark, d)
    own.table("e").append(ev.where("event_id % 2 = 0").drop("value"))
    own.table("e").append(ev.where("event_id % 2 = 1"), evolve=True)
    return own.table("e").dataframe().select("event_id", "ts", "value")


def compact_equals_scan(spark, d):
    own = event_store(spark, d)
    own.table("events").compact(target_rows=2000)
    return own.table("events").scan(T0, T1).select("event_id", "ts", "value")


def replace_is_not_append(spark, d):
    own = event_store(spark, d)
    own.table("events").replace(events(spark, d).where("value > 50"))
    return own.table("events").dataframe().select("event_id", "value")


def store_describe(spark, d):
    own = event_store(spark, d)
    own.table("spans").append(intervals(spark, d), kind="events")
    return own.describe().select("name", "kind", "version", "rows", "min_ts", "max_ts")


def table_history(spark, d):
    own = event_store(spark, d)
    own.table("events").delete_range(T0, T1)
    return own.table("events").history().select("version", "op").where("version < 3")


def unread_share(spark, d):
    own, ev = store(spark), events(spark, d)
    own.table("events").append(*(ev.where(F.col("ts").between(T0 + k * DAY, T0 + (k + 1) * DAY - 1)) for k in range(-4, 26)))
    with own.measure() as stats:
        n = own.table("events").scan(T0, T0 + DAY // 2).count()
    return spark.createDataFrame([(n, stats.unread > 80)], "rows long, mostly_unread boolean")


def density_histogram_64(spark, d):
    return density(events(spark, d), T0, T0 + 8 * DAY)


def ts_normalization(spark, d):
    ev = events(spark, d).select("event_id", F.call_function("div", "ts", F.lit(1_000_000)).alias("ts"))  # a quotient of doubles would round up
    return to_ns(ev, "ts")


def append_stream(spark, d):
    from tidemark.session import new_folder
    from tidemark.streaming.ingest import append_stream as run

    own, source = store(spark), new_folder(spark, "stream")
    events(spark, d).repartition(4).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 2).parquet(source)
    run(stream, own, "live", new_folder(spark, "progress")).awaitTermination()
    return own.table("live").dataframe().select("event_id", "ts", "value")


def interval_open_ends(spark, d):
    """Intervals of which every third has no end, in commits by stream: a row without an end ends where it begins."""
    own, spans = store(spark), intervals(spark, d)
    spans = spans.withColumn("t1", F.when(F.col("event_id") % 3 != 0, F.col("t1")))
    own.table("spans").append(*(spans.where(F.col("event_id") % 4 == k) for k in range(4)))
    return own.table("spans").scan(T0, T0 + DAY // 4).select("event_id", "ts", "t1")


def evolving_race(spark, d):
    """Two writers that add a column each at the same time; both columns stay."""
    own, ev = store(spark), events(spark, d)
    own.table("e").append(ev.where("event_id % 3 = 0").select("ts", "event_id"))
    parts = [(1, "value"), (2, "stream")]
    with ThreadPoolExecutor(len(parts)) as pool:
        list(pool.map(lambda p: own.table("e").append(ev.where(F.col("event_id") % 3 == p[0]).select("ts", "event_id", p[1]), evolve=True), parts))
    return own.table("e").dataframe().select("ts", "event_id", "value", "stream")


def compacted_layout(spark, d):
    """Rows by a layout's key once four commits have been compacted into it and their files vacuumed."""
    own = event_store(spark, d, 4)
    t = own.table("events")
    t.set_layout("user_id", ["value"], file_rows=2000)
    t.compact(target_rows=2000)
    t.vacuum(keep=1)
    return t.scan_values("user_id", [5, 8], columns=["event_id", "value"])


def indexed_values(spark, d):
    """Rows by value through the secondary index, with a commit that came after it."""
    own, ev = store(spark), events(spark, d)
    t = own.table("events")
    t.append(*(ev.where(F.col("user_id") % 5 == k) for k in range(4)))
    t.build_index("user_id")
    t.append(ev.where("user_id % 5 = 4"))
    return t.scan_values("user_id", [3, 8, 9], columns=["event_id", "user_id"])


def summarized_log(spark, d):
    """A version before and after the log's summary: rows of version 3 and of the last of twelve commits."""
    own, ev = store(spark), events(spark, d)
    for k in range(12):
        own.table("events").append(ev.where(F.col("event_id") % 12 == k).select("ts", "event_id"))
    return own.table("events").dataframe(3).select("event_id", F.lit(3).alias("version")).unionByName(own.table("events").dataframe().select("event_id", F.lit(11).alias("version")))


def conflicting_commits(spark, d):
    """A compaction and a replacement of the same files: the later one is refused, so rows are neither lost nor doubled."""
    own = event_store(spark, d, 2)
    t = own.table("events")
    before = list(t.version().by_name)
    t.replace(events(spark, d).where("value > 20"))
    refused = False
    try:
        t.log.commit("compact", [], before)
    except CommitConflict:
        refused = True
    return t.dataframe().agg(F.count(F.lit(1)).alias("rows")).withColumn("refused", F.lit(refused))


WINDOW_SQL = f"WITH {EV} SELECT event_id, ts, value FROM ev WHERE ts BETWEEN {T0} AND {T1}"

QUERIES = {
    "scan_time_window": (scan_time_window, WINDOW_SQL),
    "scan_projection": (scan_projection, f"WITH {EV} SELECT ts, value FROM ev WHERE ts BETWEEN {T0} AND {T1}"),
    "scan_values_in": (scan_values_in, f"WITH {EV} SELECT ts, event_id, user_id FROM ev WHERE user_id IN (3, 7, 11)"),
    "where_between": (where_between, f"WITH {EV} SELECT ts, event_id, value FROM ev WHERE value BETWEEN 10 AND 20"),
    "predicate_conjunction": (predicate_conjunction, f"WITH {EV} SELECT ts, event_id, stream, value FROM ev WHERE value > 10 AND stream = 'click' AND ts >= {T0}"),
    "interval_overlap_scan": (interval_overlap_scan, f"WITH {IV} SELECT event_id, ts, t1 FROM iv WHERE t1 >= {T0} AND ts <= {T0 + DAY // 4}"),
    "interval_open_ends": (interval_open_ends, f"WITH {IV}, o AS (SELECT event_id, ts, CASE WHEN event_id % 3 <> 0 THEN t1 END AS t1 FROM iv) SELECT * FROM o WHERE coalesce(t1, ts) >= {T0} AND ts <= {T0 + DAY // 4}"),
    "evolving_race": (evolving_race, f"WITH {EV} SELECT ts, event_id, CASE WHEN event_id % 3 = 1 THEN value END AS value, CASE WHEN event_id % 3 = 2 THEN stream END AS stream FROM ev"),
    "compacted_layout": (compacted_layout, f"WITH {EV} SELECT ts, event_id, value FROM ev WHERE user_id IN (5, 8)"),
    "indexed_values": (indexed_values, f"WITH {EV} SELECT ts, event_id, user_id FROM ev WHERE user_id IN (3, 8, 9)"),
    "summarized_log": (summarized_log, f"WITH {EV} SELECT event_id, 3 AS version FROM ev WHERE event_id % 12 < 4 UNION ALL SELECT event_id, 11 FROM ev"),
    "conflicting_commits": (conflicting_commits, f"WITH {EV} SELECT count(*) AS rows, true AS refused FROM ev WHERE value > 20"),
    "multi_table_window": (multi_table_window, f"WITH {IV} SELECT 'events' AS source, event_id FROM ev WHERE ts BETWEEN {T0} AND {T1} UNION ALL SELECT 'spans', event_id FROM iv WHERE t1 >= {T0} AND ts <= {T1}"),
    "time_travel_v2": (time_travel_v2, f"WITH {EV} SELECT event_id, ts FROM ev WHERE event_id % 4 IN (0, 1)"),
    "snapshot_sql": (snapshot_sql, f"WITH {EV} SELECT stream, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY stream"),
    "delete_range_view": (delete_range_view, f"WITH {EV} SELECT event_id, ts FROM ev WHERE NOT ts BETWEEN {T0} AND {T1}"),
    "additive_evolution": (additive_evolution, f"WITH {EV} SELECT event_id, ts, CASE WHEN event_id % 2 = 1 THEN value END AS value FROM ev"),
    "compact_equals_scan": (compact_equals_scan, WINDOW_SQL),
    "replace_is_not_append": (replace_is_not_append, f"WITH {EV} SELECT event_id, value FROM ev WHERE value > 50"),
    "store_describe": (store_describe, f"WITH {EV} SELECT 'events' AS name, 'timeseries' AS kind, 2::BIGINT AS version, count(*) AS rows, min(ts) AS min_ts, max(ts) AS max_ts FROM ev UNION ALL SELECT 'spans', 'events', 0, count(*), min(ts), max(ts) FROM ev"),
    "table_history": (table_history, "SELECT v::BIGINT AS version, 'append' AS op FROM range(3) r(v)"),
    "unread_share": (unread_share, f"WITH {EV} SELECT count(*) AS rows, true AS mostly_unread FROM ev WHERE ts BETWEEN {T0} AND {T0 + DAY // 2}"),
    "density_histogram_64": (density_histogram_64, f"WITH {EV} SELECT least(63, floor((ts - {T0}) * 64.0::DOUBLE / {8 * DAY}.0::DOUBLE))::BIGINT AS bin, count(*) AS rows FROM ev WHERE ts BETWEEN {T0} AND {T0 + 8 * DAY} GROUP BY 1"),
    "ts_normalization": (ts_normalization, f"WITH {EV} SELECT event_id, ts // 1000000 * 1000000 AS ts FROM ev"),
    "append_stream": (append_stream, f"WITH {EV} SELECT event_id, ts, value FROM ev"),
}

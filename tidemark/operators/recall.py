"""Searches in stages: recall by cheap scores, then segments, structure, expensive vectors; and the namespaces of vectors.

A stage hands a table of candidates to the next one.  What a parameter bounds
(a shortlist, a query's channels) may be broadcast; the corpus is only filtered,
scored in place and cut by a top-k.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import constant, dot, unit
from tidemark.operators import ranking
from tidemark.operators.align import asof
from tidemark.operators.evidence import neighbour_density
from tidemark.operators.vectors import mean_vector, top_k
from tidemark.session import written
from tidemark.sources.store import Table

#: A relation, and the prepositions that ask for it.
RELATIONS = {"containment": ("into", "in", "inside", "within"), "support": ("on", "onto", "on top", "above", "over"), "separation": ("out of", "from", "off", "away")}
#: Windows that a pool holds at least and at most, windows of the corpus for each, and the least of one atom.
POOL_LEAST, POOL_MOST, POOL_SHARE, ATOM_LEAST = 120, 256, 1500, 12
#: Rows that feedback starts from at least, the share of structure that must agree, and the weight of a further stage.
SEEDS_LEAST, HEAD_LEAST, AGREE, STAGE = 25, 20, 0.35, 0.5


def relation(text: Column) -> Column:
    """The relation that a text asks for, by the longest preposition in it (of equal ones the first); null without any."""
    cues = sorted(((p, name) for name, own in RELATIONS.items() for p in own), key=lambda x: -len(x[0]))
    return F.coalesce(*(F.when(F.instr(F.lower(text), p) > 0, F.lit(name)) for p, name in cues))


def kinds_of(events: DataFrame, episode: str, kind: str, out: str = "kinds") -> DataFrame:
    """The different kinds of each episode's events, in order."""
    return events.groupBy(episode).agg(F.sort_array(F.collect_set(kind)).alias(out))


def pool_size(windows: int, atoms: int, pool: int = 48) -> int:
    """Windows that each atom proposes: a pool that grows with the corpus between bounds, shared out."""
    return max(max(pool, min(max(windows // POOL_SHARE, POOL_LEAST), POOL_MOST)) // max(atoms, 1), ATOM_LEAST)


def joined_segments(windows: DataFrame, stream: str, start: str, end: str, pad: int, scores: list[str]) -> DataFrame:
    """Windows of a stream that overlap once each is widened by the pad on both sides, as one segment with the best of each score."""
    w = Window.partitionBy(stream).orderBy(start, end)
    reach = F.max(F.col(end) + pad).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = windows.withColumn("__new", F.when(F.col(start) - pad <= reach, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(stream, "__run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("windows"), *(F.max(c).alias(c) for c in scores)).drop("__run")


def verified_search(windows: DataFrame, stream: str, atoms: dict[str, Column], channels: dict[str, Column], k: int = 8, pool: int = 48, pad: int = 2, where: Column | None = None, start: str = "ts", end: str = "t1") -> DataFrame:
    """Segments for a query of several atoms, best first: union recall, joined segments, fusion by reciprocal ranks.

    Time and stream predicates come before recall.  Each atom proposes its best
    windows; a window's appearance is the mean of all atoms.  Further channels
    score what has been proposed and abstain with null.
    """
    own = windows if where is None else windows.where(where)
    each = own.select(stream, start, end, *(c.alias(f"__a_{n}") for n, c in atoms.items()), *(c.alias(n) for n, c in channels.items()))
    each = each.withColumn("appearance", reduce(lambda a, b: a + b, (F.col(f"__a_{n}") for n in atoms)) / len(atoms)).withColumn("__id", F.struct(stream, start, end))
    per = pool_size(own.count(), len(atoms), pool)
    found = reduce(DataFrame.unionByName, (top_k(each, f"__a_{n}", per, "__id").drop("rank") for n in atoms))
    names = ["appearance", *channels]
    spans = written(joined_segments(found.select(stream, start, end, *names).distinct(), stream, start, end, pad, names), "segments")
    fused = ranking.rrf(spans.withColumn("__id", F.struct(stream, start)), dict.fromkeys(names, 1.0), "__id", out="score")
    return top_k(fused, "score", k, "__id").select(stream, start, end, "windows", "score", "rank")


def content_gated(windows: DataFrame, recordings: DataFrame, stream: str, score: str, top: int = 24, at: str = "ts") -> DataFrame:
    """Of the recordings that hold a plausible window's start, those of the best score: what a window shows gates which motion counts.

    recordings: stream, ts and the score; a window belongs to the last recording
    of its stream that begins at or before it.
    """
    own = recordings.select(stream, F.col(at), F.col(at).alias("recording"), score)
    held = asof(windows.select(stream, at).distinct(), own, [stream], ["recording", score], "backward", at)
    held = held.where("recording is not null").select(stream, "recording", score).distinct()
    return top_k(held.withColumn("__id", F.struct(stream, "recording")), score, top, "__id").drop("__id")


def context_search(df: DataFrame, key: str, channels: dict[str, Column], weights: dict[str, float], k: int = 10, where: Column | None = None, percentile: float | None = None, constant_: float = 60.0) -> DataFrame:
    """Rows by appearance, context and words fused by reciprocal ranks; a row without words abstains there and is not ruled out.

    The predicate chooses candidates before any is ranked; percentile cuts the
    fused scores.
    """
    own = (df if where is None else df.where(where)).select(key, *(c.alias(n) for n, c in channels.items()))
    fused = ranking.rrf(own, {n: weights.get(n, 1.0) for n in channels}, key, constant_, "score")
    if percentile is not None:
        floor = fused.agg(F.percentile("score", percentile / 100).alias("__f"))
        fused = fused.crossJoin(F.broadcast(floor)).where(F.col("score") >= F.col("__f"))
    return top_k(fused, "score", k, key)


def sharp_search(df: DataFrame, key: str, cheap: Column, expensive: Callable[[DataFrame], DataFrame], cache: Table, query: list[float], shortlist: int = 48, k: int = 10) -> tuple[DataFrame, int]:
    """Rows shortlisted by a cheap score and ranked by expensive vectors, and how many of these had to be made.

    expensive: rows to (key, vector).  Vectors are kept in a table of a store,
    once for a key, so a corpus is refined only where it is asked about.
    """
    wanted = written(top_k(df.withColumn("__cheap", cheap), "__cheap", shortlist, key).drop("__cheap", "rank"), "shortlist")
    known = cache.log.numbers()
    missing = wanted.join(cache.dataframe().select(key), key, "left_anti") if known else wanted
    number = missing.count()
    if number:
        cache.append(expensive(missing).select(F.lit(0).cast("long").alias("ts"), key, F.col("vector").cast("array<double>").alias("vector")), kind="embeddings")
    vectors = cache.dataframe().join(F.broadcast(wanted.select(key)), key, "left_semi").dropDuplicates([key])
    return top_k(vectors.select(key, dot(F.col("vector"), constant(query)).alias("score")), "score", k, key), number


def student_search(df: DataFrame, key: str, vector: str, query: list[float], have: Column | None = None, neighbours: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Recall by similarity, feedback from its best, a gate of structure, and density of neighbours: key, score, rank.

    have: whether a row has what the query's structure asks for; it counts only
    if enough of the best rows agree.  neighbours: (key, neighbour).
    """
    own = df.select(key, vector, dot(F.col(vector), constant(query)).alias("__s"), (have.cast("double") if have is not None else F.lit(None).cast("double")).alias("__have"))
    best = top_k(own, "__s", max(SEEDS_LEAST, k // 4), key)
    center = mean_vector(best.withColumn("__g", F.lit(0)), ["__g"], vector).select(F.col(vector).alias("__c"))
    own = own.crossJoin(F.broadcast(center)).withColumn("__s", F.col("__s") + STAGE * dot(F.col(vector), F.col("__c"))).select(key, "__s", "__have")
    own = written(own, "recalled")
    spread = lambda: own.agg(F.stddev_pop("__s")).first()[0] or 0.0
    if have is not None:
        agree = top_k(own, "__s", max(k, HEAD_LEAST), key).agg(F.avg(F.coalesce("__have", F.lit(0.0)))).first()[0]
        if (agree or 0.0) >= AGREE:
            own = written(own.withColumn("__s", F.col("__s") + STAGE * spread() * F.coalesce("__have", F.lit(0.0))), "gated")
    if neighbours is not None:
        dense = neighbour_density(neighbours, top_k(own, "__s", max(k, HEAD_LEAST), key), key, k, HEAD_LEAST)
        column = next(c for c in dense.columns if c != key)
        own = own.join(dense, key, "left").withColumn("__s", F.col("__s") + STAGE * spread() * F.coalesce(F.col(column), F.lit(0.0)))
    return top_k(own.select(key, F.col("__s").alias("score")), "score", k, key)


def agents(points: DataFrame, segment: str, track: str, at: str, x: str, y: str) -> DataFrame:
    """Per segment the track that moves most for longest: path length times its share of the segment's time; tracks of one point are left out."""
    w = Window.partitionBy(segment, track).orderBy(at)
    steps = points.withColumn("__d", F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)))
    per = steps.groupBy(segment, track).agg(F.sum("__d").alias("path"), F.min(at).alias("__a"), F.max(at).alias("__b"), F.count(F.lit(1)).alias("__n"))
    span = per.groupBy(segment).agg(F.greatest(F.max("__b") - F.min("__a"), F.lit(1)).alias("__span"))
    scored = per.where("__n > 1").join(span, segment).withColumn("score", F.col("path") * (F.col("__b") - F.col("__a")) / F.col("__span"))
    best = scored.groupBy(segment).agg(F.max(F.struct(F.col("score"), (-F.col(track)).alias("t"))).alias("b"))
    return best.select(segment, (-F.col("b.t")).alias(track), F.col("b.score").alias("score"))


def fit_basis(df: DataFrame, vector: str) -> tuple[list[float], list[float]]:
    """Mean and deviation of each place of the vectors: two numbers a place."""
    flat = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("p", "x"))
    rows = flat.groupBy("p").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("p").collect()  # a row a place
    return [r["m"] for r in rows], [r["s"] or 1.0 for r in rows]


def project(vector: Column, basis: tuple[list[float], list[float]]) -> Column:
    """A vector in a basis, of unit length."""
    moved = F.zip_with(vector.cast("array<double>"), constant(basis[0]), lambda x, m: x - m)
    return unit(F.zip_with(moved, constant(basis[1]), lambda x, s: x / s))


def refit(table: Table, raw: str, vector: str, name: str) -> tuple[list[float], list[float]]:
    """Fit a basis of a new name on a table's raw vectors and rewrite every row in it: a basis is a namespace, and rows of two are never compared."""
    rows = table.dataframe()
    basis = fit_basis(rows, raw)
    table.replace(rows.withColumn(vector, project(F.col(raw), basis)).withColumn("basis", F.lit(name)))
    return basis


def similar(table: Table, vector: str, query: list[float], k: int, key: str, basis: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """The nearest rows of a basis within a time range; both are predicates of the scan, so other files are not read."""
    rows = table.scan(since, until, predicate=f"basis = '{basis}'")
    return top_k(rows.select(key, dot(F.col(vector), constant(query)).alias("score")), "score", k, key)


def log_turn(table: Table, turns: DataFrame, turn: str = "turn", at: str = "ts") -> None:
    """Append rows of turns that begin: (ts, turn, what is known of them)."""
    table.append(turns.withColumn("finished", F.lit(None).cast("boolean")), kind="audit", evolve=True)


def finish_turn(table: Table, turns: DataFrame) -> None:
    """Append rows of turns that end: (ts, turn, finished); what was logged stays as it was."""
    table.append(turns, kind="audit", evolve=True)


def turns_now(table: Table, turn: str = "turn", at: str = "ts") -> DataFrame:
    """Each turn with the last known value of every column."""
    rows = table.dataframe()
    return rows.groupBy(turn).agg(F.max(at).alias(at), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in rows.columns if c not in (turn, at)))

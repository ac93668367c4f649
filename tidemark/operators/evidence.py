"""Gates, audits, boosts and pair relations that refine a ranking."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import constant, dot
from tidemark.operators.intervals import iou, overlap_join, overlap_pairs
from tidemark.operators.ranking import abstain, global_order, rank_fraction


def precision_floor(df: DataFrame, score: str, percentile: float | None = None, least: float | None = None) -> DataFrame:
    """Rows at a percentile of the scores (linear between rows) and at a least score or more."""
    out = df if least is None else df.where(F.col(score) >= least)
    if percentile is None:
        return out
    floor = df.agg(F.percentile(score, percentile / 100).alias("__f"))
    return out.crossJoin(F.broadcast(floor)).where(F.col(score) >= F.col("__f")).drop("__f")


def direction_gate(df: DataFrame, kind: str, delta: str, rising: bool) -> DataFrame:
    """Rows of the kinds whose median delta is positive (or negative, if not rising)."""
    medians = df.groupBy(kind).agg(F.percentile(delta, 0.5).alias("__m"))
    kept = medians.where(F.col("__m") > 0 if rising else F.col("__m") < 0).select(kind)
    return df.join(kept, kind, "left_semi")


def no_match(classes: DataFrame, name: str, score: str, support: str, posterior: str, least_z: float = 3.0) -> DataFrame:
    """Per class: whether a query has no match in it.

    It has one if its score is least_z deviations above the other classes, unless its
    posterior is among the lowest third or its support is under the classes' mean.
    """
    stats = classes.agg(F.avg(score).alias("__a"), F.stddev_pop(score).alias("__d"), F.percentile(posterior, 1 / 3).alias("__p"), F.avg(support).alias("__s"))
    own = classes.crossJoin(F.broadcast(stats))
    outlier = (F.col(score) - F.col("__a")) / (F.col("__d") + 1e-12) >= least_z
    dead = F.col(posterior) < F.col("__p")
    return own.select(name, (~outlier | dead | (F.col(support) < F.col("__s"))).alias("no_match"))


def top_mean(df: DataFrame, by: list[str], score: str, k: int = 5) -> DataFrame:
    """The mean of the k largest scores of each group."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc())
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).groupBy(*by).agg(F.avg(score).alias("score"))


def variants(scores: DataFrame, term: str, recording: str, score: str, base: str, most: int = 3) -> DataFrame:
    """The base term and, of its variants, those whose mean of the five best scores is higher: at most `most`, best first."""
    means = top_mean(scores, [term], score)
    own = means.where(F.col(term) == base).select(F.col("score").alias("__b"))
    better = means.where(F.col(term) != base).crossJoin(F.broadcast(own)).where(F.col("score") > F.col("__b")).drop("__b").orderBy(F.col("score").desc(), term).limit(most)
    return means.where(F.col(term) == base).unionByName(better)


def first_of_each(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def even_stride(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """n rows of each group at evenly spaced places (rounded half to even), each once."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("__k", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / F.lit(float(max(n - 1, 1)))).cast("long"))
    return ranked.where(F.array_contains(places, F.col("__k").cast("long"))).drop("__k", "__n")


def box_pairs(tracks: DataFrame, bucket: int, key: str = "track", disjoint: bool = True, same: float = 0.9) -> DataFrame:
    """Pairs of tracks whose times overlap and whose boxes do not touch (never the same thing), or coincide (surely the same).

    tracks: key, ts, t1, x0, y0, x1, y1.  A pair of rows is met once, so pairs are
    made unique only where keys are repeated.
    """
    columns = [key, "ts", "t1", "x0", "y0", "x1", "y1"]
    tracks = tracks.select(*columns)
    pairs = overlap_pairs(tracks, key, bucket)
    value = iou(["x0", "y0", "x1", "y1"], ["r_x0", "r_y0", "r_x1", "r_y1"])
    found = pairs.where(value == 0 if disjoint else value >= same).select(F.col(key).alias("a"), F.col(f"r_{key}").alias("b"))
    repeated = tracks.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return found.distinct() if repeated else found


def handoffs(tracks: DataFrame, gap: int, key: str = "track", least: float = 0.3) -> DataFrame:
    """Pairs of tracks of which one starts within `gap` after the other ends, at an overlapping box."""
    ends = tracks.select(F.col(key).alias("a"), F.col("t1").alias("ts"), (F.col("t1") + gap).alias("t1"), "x0", "y0", "x1", "y1")
    starts = tracks.select(F.col(key).alias("b"), F.col("ts").alias("r_ts"), F.col("ts").alias("r_t1"), *(F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")))
    pairs = overlap_join(ends, starts, max(gap, 1)).where((F.col("a") != F.col("b")) & (F.col("r_ts") > F.col("ts")))
    return pairs.where(iou(["x0", "y0", "x1", "y1"], ["r_x0", "r_y0", "r_x1", "r_y1"]) >= least).select("a", "b")


def identity_cut(same: list[float], different: list[float], fewest: int = 20, default: float = 0.75) -> float:
    """The similarity, of 201 between 0.5 and 0.95, that separates pairs of the same from pairs of different things best; a default with too few of the latter."""
    if len(different) < fewest:
        return default
    grid = np.linspace(0.5, 0.95, 201)
    if not len(same):
        return float(np.clip(np.percentile(different, 99), 0.5, 0.95))
    hit = (np.asarray(same)[None] >= grid[:, None]).mean(1) - (np.asarray(different)[None] >= grid[:, None]).mean(1)
    return float(grid[int(hit.argmax())])


def open_cells(cells: DataFrame, cell: str, similarity: str, rows: str, mass: float = 0.25) -> DataFrame:
    """Cells by falling similarity until they hold `mass` of all rows and the next is more than a deviation below the best."""
    stats = cells.agg(F.max(similarity).alias("__x"), F.stddev_pop(similarity).alias("__d"), F.sum(rows).alias("__t"))
    w = Window.orderBy(F.col(similarity).desc(), cell).rowsBetween(Window.unboundedPreceding, -1)  # a row a cell
    own = cells.withColumn("__before", F.coalesce(F.sum(rows).over(w), F.lit(0))).crossJoin(F.broadcast(stats))
    return own.where((F.col("__before") < mass * F.col("__t")) | (F.col(similarity) >= F.col("__x") - F.col("__d"))).select(*cells.columns)


def byte_table_score(code: Column, query: list[float]) -> Column:
    """The dot product of a query with a vector of signs packed into bytes (8 a byte, lowest bit first; 1 is +1), by a table of 256 sums a byte."""
    q = np.asarray(query, dtype=float).reshape(-1, 8)
    bits = ((np.arange(256)[:, None] >> np.arange(8)[None]) & 1) * 2.0 - 1
    table = (q @ bits.T).ravel().tolist()
    lookup = constant(table)
    return F.aggregate(F.transform(code, lambda b, i: F.get(lookup, i * 256 + b)), F.lit(0.0), lambda s, x: s + x)


def rank_norm_blend(df: DataFrame, key: str, first: str, second: str, head: int, alpha: float = 0.5) -> DataFrame:
    """The `head` best rows by one score ordered by alpha x the rank fraction of a second plus the rest of the first's; the tail keeps its order."""
    best = df.orderBy(F.col(first).desc(), key).limit(head)
    both = rank_fraction(rank_fraction(best, first, key, "__a"), second, key, "__b")
    placed = both.withColumn("rank", F.row_number().over(Window.orderBy(F.round(alpha * F.col("__b") + (1 - alpha) * F.col("__a"), 12).desc(), key)).cast("long")).drop("__a", "__b")
    tail = df.join(best.select(key), key, "left_anti")
    rest = global_order(tail, [F.col(first).desc(), F.col(key).asc()], "rank").withColumn("rank", F.col("rank") + head + 1)
    return placed.unionByName(rest.select(*placed.columns))


def collapse_spans(df: DataFrame, media: str, start: str, end: str, score: str) -> DataFrame:
    """By falling score, a span joins the first kept span of its media that it overlaps, which grows to hold both."""
    names = [media, start, end, score]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        for m, a, b, s in pdf.sort_values([score, start], ascending=[False, True])[names].itertuples(index=False):
            for k in kept:
                if a <= k[2] and k[1] <= b:
                    k[1], k[2] = min(k[1], a), max(k[2], b)
                    break
            else:
                kept.append([m, a, b, s])
        return pd.DataFrame(kept, columns=names)

    own = df.select(*names)
    return own.groupBy(media).applyInPandas(run, own.schema)


def neighbour_density(neighbours: DataFrame, ranked: DataFrame, key: str, k: int, least: int = 20) -> DataFrame:
    """The share of each row's neighbours (key, neighbour) that are among the max(k, least) best of the ranking (key, rank)."""
    top = ranked.where(F.col("rank") <= max(k, least)).select(F.col(key).alias("neighbour"), F.lit(1).alias("__in"))
    return neighbours.join(top, "neighbour", "left").groupBy(key).agg(F.avg(F.coalesce("__in", F.lit(0))).alias("density"))


def swap_contrast(df: DataFrame, vector: str, query: list[float], swapped: list[float]) -> DataFrame:
    """The score of a query minus that of its reverse."""
    return df.withColumn("contrast", dot(F.col(vector), constant(query)) - dot(F.col(vector), constant(swapped)))


def boost(df: DataFrame, score: str, weights: dict[str, float], factor: float = 8.0) -> DataFrame:
    """score + factor x (deviation of the scores) x the weighted sum of boosting columns, abstaining ones as 0."""
    spread = df.agg(F.stddev_pop(score).alias("__d"))
    total = reduce(lambda a, b: a + b, (F.lit(w) * F.coalesce(abstain(c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return df.crossJoin(F.broadcast(spread)).withColumn(score, F.col(score) + factor * F.col("__d") * total).drop("__d")


def binding_audit(hits: DataFrame, key: str, present: str, moved: str, hue: str, near: str) -> DataFrame:
    """Hits with the reason for which each is struck out, if one is: absent, static, colour or landmark.

    A null abstains and keeps.  If more hits are absent than are present with
    confidence, absence strikes none out.
    """
    absent = F.col(present) < 0.5
    counts = hits.agg(F.count(F.when(absent, 1)).alias("__gone"), F.count(F.when(F.col(present) >= 0.5, 1)).alias("__there"))
    own = hits.crossJoin(F.broadcast(counts))
    reason = F.when(absent & (F.col("__there") >= F.col("__gone")), "absent").when(~F.col(moved), "static").when(F.col(hue) < 0.25, "colour").when(~F.col(near), "landmark")
    return own.withColumn("reason", reason).drop("__gone", "__there")


def transitions(df: DataFrame, by: list[str], order: str, box: list[str]) -> DataFrame:
    """Per stretch: how its box changes from first to last row: displacement, growth, direction, path over displacement."""
    x, y = (F.col(box[0]) + F.col(box[2])) / 2, (F.col(box[1]) + F.col(box[3])) / 2
    area = (F.col(box[2]) - F.col(box[0])) * (F.col(box[3]) - F.col(box[1]))
    w = Window.partitionBy(*by).orderBy(order)
    own = df.select(*by, order, x.alias("__x"), y.alias("__y"), area.alias("__a"))
    own = own.withColumn("__s", F.hypot(F.col("__x") - F.lag("__x").over(w), F.col("__y") - F.lag("__y").over(w)))
    ends = own.groupBy(*by).agg(F.min_by(F.struct("__x", "__y", "__a"), order).alias("p"), F.max_by(F.struct("__x", "__y", "__a"), order).alias("q"), F.coalesce(F.sum("__s"), F.lit(0.0)).alias("path"), F.count(F.lit(1)).alias("rows"))
    dx, dy = F.col("q.__x") - F.col("p.__x"), F.col("q.__y") - F.col("p.__y")
    far = F.hypot(dx, dy)
    return ends.select(*by, "rows", dx.alias("dx"), dy.alias("dy"), far.alias("displacement"), F.atan2(dy, dx).alias("direction"), F.log((F.col("q.__a") + 1.0) / (F.col("p.__a") + 1.0)).alias("growth"), (F.col("path") / (far + 1e-9)).alias("detour"))


def correspondence(score: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """The best partial one-to-one assignment of at most three nodes to others, unassigned ones counting 0: value and pairs."""
    rows, columns = score.shape
    if rows > 3:
        raise ValueError("at most three nodes")
    best: tuple[float, list[tuple[int, int]]] = (0.0, [])
    for chosen in permutations([*range(columns), *[-1] * rows], rows):
        pairs = [(i, j) for i, j in enumerate(chosen) if j >= 0]
        value = float(sum(score[i, j] for i, j in pairs))
        if value > best[0]:
            best = value, pairs
    return best


def self_similarity_shape(x: np.ndarray, n: int = 12) -> np.ndarray:
    """The upper triangle of the self-similarity of a sequence cut to n steps, standardised."""
    own = x[np.round(np.linspace(0, len(x) - 1, n)).astype(int)]
    own = own / (np.linalg.norm(own, axis=1, keepdims=True) + 1e-8)
    flat = (own @ own.T)[np.triu_indices(n, 1)]
    return (flat - flat.mean()) / (flat.std() + 1e-8)


def segment_count(x: np.ndarray, most: int = 12) -> int:
    """How many segments a sequence of unit vectors has, by the largest gap between eigenvalues of its normalised similarity."""
    s = np.maximum(x @ x.T, 0)
    d = s.sum(1)
    values = np.sort(np.linalg.eigvalsh(s / np.sqrt(np.outer(d, d) + 1e-12)))[::-1][: most + 1]
    return int(np.argmax(values[:-1] - values[1:])) + 1 if len(values) > 1 else 1


def best_rate(query: dict[float, np.ndarray], reference: dict[float, np.ndarray]) -> tuple[float, float]:
    """The pair of rates at which a query and a reference have the most similar lengths."""
    return min(((a, b) for a in query for b in reference), key=lambda p: (abs(np.log(len(query[p[0]]) / len(reference[p[1]]))), p))


def boundary_signal(series: dict[float, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Several scales' novelty (times, values), each standardised and interpolated to the finest grid, averaged."""
    grid = series[min(series)][0]
    z = [np.interp(grid, t, (v - v.mean()) / (v.std() + 1e-8)) for t, v in series.values()]
    return grid, np.mean(z, axis=0)


def linear_segments(keys: np.ndarray, epsilon: int = 64) -> list[tuple[int, int, float]]:
    """A learned index of sorted keys: (first key, its place, slope) of pieces that place every key within epsilon.

    Keys must ascend; of equal keys the first place counts.
    """
    keys = np.asarray(keys)
    if len(keys) and (np.diff(keys) < 0).any():
        raise ValueError("keys must be sorted")
    out: list[tuple[int, int, float]] = []
    start, low, high = 0, 0.0, np.inf
    for i in range(1, len(keys) + 1):
        if i < len(keys):
            dx = float(keys[i] - keys[start])
            if dx == 0 and i - start <= epsilon:
                continue
            if dx > 0:
                a, b = max(low, (i - start - epsilon) / dx), min(high, (i - start + epsilon) / dx)
                if a <= b:
                    low, high = a, b
                    continue
        out.append((int(keys[start]), start, low if high == np.inf else (low + high) / 2))
        start, low, high = i, 0.0, np.inf
    return out


def segment_bounds(segments: list[tuple[int, int, float]], key: int, n: int, epsilon: int = 64) -> tuple[int, int]:
    """The places between which a key must be."""
    at = max(0, int(np.searchsorted([s[0] for s in segments], key, side="right")) - 1)
    first, place, slope = segments[at]
    middle = place + slope * (key - first)
    return max(0, int(middle) - epsilon - 1), min(n, int(middle) + epsilon + 2)

"""Retrieval and separation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written


def retrieval(ranked: DataFrame, query: str, rank: str, truth: str, k: int, support: str | None = None) -> DataFrame:
    """Per query, of results with a rank from 1 and a truth of 0 or 1: precision and yield at k, reciprocal rank, average precision, nDCG.

    support: a column with the number of true items of the query; the true ones
    among the results, if not given.
    """
    w = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    t = F.col(truth).cast("double")
    own = ranked.withColumn("__hits", F.sum(t).over(w)).withColumn("__gain", t / F.log2(F.col(rank) + 1))
    found = F.max(support).alias("__n") if support else F.sum(t).alias("__n")
    out = own.groupBy(query).agg(
        (F.sum(F.when(F.col(rank) <= k, t)) / F.lit(float(k))).alias("precision"),
        F.sum(F.when(F.col(rank) <= k, t)).alias("__k"),
        F.coalesce(F.max(F.when(t > 0, 1.0 / F.col(rank))), F.lit(0.0)).alias("reciprocal_rank"),
        F.sum(t * F.col("__hits") / F.col(rank)).alias("__ap"),
        F.sum("__gain").alias("__dcg"),
        found,
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("__n"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    safe = lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    return out.select(query, "precision", safe(F.col("__k"), F.col("__n")).alias("yield"), "reciprocal_rank", safe(F.col("__ap"), F.col("__n")).alias("average_precision"), safe(F.col("__dcg"), ideal).alias("ndcg"))


def auc(df: DataFrame, score: str, truth: str, by: list[str] = ()) -> DataFrame:
    """The share of (true, false) pairs that the score puts in order, ties half, from counts per distinct score."""
    per = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(truth).cast("double")).alias("__t"), F.sum(1 - F.col(truth).cast("double")).alias("__f"))
    before = F.lit(0.0)
    if not by:  # scores are sorted by range, and a running sum of partitions goes ahead of that within each
        per = written(per.repartitionByRange(score).sortWithinPartitions(score).withColumn("__part", F.spark_partition_id()), "scores")
        parts = per.groupBy("__part").agg(F.sum("__f").alias("__p"))  # a row a partition
        ahead = F.coalesce(F.sum("__p").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        per, before = per.join(F.broadcast(parts.select("__part", ahead.alias("__ahead"))), "__part"), F.col("__ahead")
    w = Window.partitionBy(*(by or ["__part"]))
    below = before + F.coalesce(F.sum("__f").over(w.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    own = per.withColumn("__u", F.col("__t") * (below + F.col("__f") / 2))
    total = own.groupBy(*by).agg(F.sum("__u").alias("__u"), F.sum("__t").alias("__t"), F.sum("__f").alias("__f"))
    return total.select(*by, F.when(F.col("__t") * F.col("__f") > 0, F.col("__u") / (F.col("__t") * F.col("__f"))).alias("auc"))


def tail_concentration(df: DataFrame, score: str) -> DataFrame:
    """One row: (p99 - p50) / (p99 - p1)."""
    p = df.agg(F.percentile(score, [0.01, 0.5, 0.99]).alias("p"))
    return p.select(((F.col("p")[2] - F.col("p")[1]) / (F.col("p")[2] - F.col("p")[0])).alias("tail"))


def span_f1(predicted: list[tuple[float, float]], true: list[tuple[float, float]], least: float = 0.5) -> float:
    """F1 of spans matched one to one, best overlaps first, at an intersection over union of `least` or more."""
    scored = []
    for i, (a, b) in enumerate(predicted):
        for j, (c, d) in enumerate(true):
            inter = max(0.0, min(b, d) - max(a, c))
            union = max(b, d) - min(a, c) if inter else (b - a) + (d - c)
            if union > 0 and inter / union >= least:
                scored.append((inter / union, i, j))
    left, right, hits = set(), set(), 0
    for _, i, j in sorted(scored, reverse=True):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            hits += 1
    return 2 * hits / (len(predicted) + len(true)) if predicted or true else 1.0

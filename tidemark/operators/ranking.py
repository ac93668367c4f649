"""Ranks, rank fusion and calibrated cuts over long tables of scores.

Scores are columns; null means that a channel abstains, and NaN is made null.
Ranks over a whole table need its order: rank0 sorts by range and numbers the
partitions, so no single task sees all rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written


def abstain(c: str | Column) -> Column:
    """The score as a double, null where it is NaN."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def global_order(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """The rows with their place (from 0) in a total order, by range partitions and a running count of them."""
    own = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "ordered")
    counts = own.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", "__first", before.alias("__before"))  # a row a partition
    return own.join(F.broadcast(starts), "__part").withColumn(out, (F.col("__row") - F.col("__first") + F.col("__before")).cast("long")).drop("__part", "__row", "__first", "__before")


def rank0(df: DataFrame, score: str, tie: str, out: str) -> DataFrame:
    """Ranks from 0, best first, ties by the tie key; rows that abstain get the median rank, or 0 if all do."""
    s = abstain(score)
    live = global_order(df.where(s.isNotNull()), [s.desc(), F.col(tie).asc()], out).withColumn(out, F.col(out).cast("double"))
    middle = live.agg(F.coalesce(F.percentile(out, 0.5), F.lit(0.0)).alias("__m"))
    rest = df.where(s.isNull()).crossJoin(F.broadcast(middle)).withColumn(out, F.col("__m")).drop("__m")
    return live.unionByName(rest)


def rrf(df: DataFrame, channels: dict[str, float], key: str, constant: float = 60.0, out: str = "fused") -> DataFrame:
    """Reciprocal-rank fusion: the sum of weight / (constant + rank + 1) over channels of a weight other than 0; ranks as rank_<channel>."""
    live = {c: w for c, w in channels.items() if w}
    for c in live:
        df = rank0(df, c, key, f"rank_{c}")
    total = reduce(lambda a, b: a + b, (F.lit(w) / (F.lit(constant) + F.col(f"rank_{c}") + 1) for c, w in live.items())) if live else F.lit(0.0)
    return df.withColumn(out, total)


def explain_fusion(fused: DataFrame, channels: list[str], key: str, k: int, score: str = "fused") -> DataFrame:
    """The k best rows with their ranks from 1 in each channel."""
    return fused.orderBy(F.col(score).desc(), key).limit(k).select(key, score, *((F.col(f"rank_{c}") + 1).alias(f"place_{c}") for c in channels))


def rank_fraction(df: DataFrame, score: str, tie: str, out: str, empty: float | None = 0.5, single: float = 0.5) -> DataFrame:
    """Ascending rank over (rows that score - 1); abstaining rows get `empty`, a lone row `single`."""
    s = abstain(score)
    live = global_order(df.where(s.isNotNull()), [s.asc(), F.col(tie).asc()], "__p")
    n = live.agg((F.count(F.lit(1)) - 1).alias("__n"))
    share = live.crossJoin(F.broadcast(n)).withColumn(out, F.when(F.col("__n") > 0, F.col("__p") / F.col("__n")).otherwise(F.lit(single))).drop("__p", "__n")
    return share.unionByName(df.where(s.isNull()).withColumn(out, F.lit(empty).cast("double")))


def percentile_rank(df: DataFrame, score: str, tie: str, out: str) -> DataFrame:
    """Ascending rank over (rows that score - 1); abstaining rows stay null, a lone row gets 1."""
    return rank_fraction(df, score, tie, out, empty=None, single=1.0)


def z_score(df: DataFrame, score: str, out: str, epsilon: float = 1e-8) -> DataFrame:
    """(score - mean) / (population deviation + epsilon) over the rows that score."""
    s = abstain(score)
    stats = df.agg(F.avg(s).alias("__m"), F.stddev_pop(s).alias("__d"))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, (s - F.col("__m")) / (F.col("__d") + epsilon)).drop("__m", "__d")


def z_blend(df: DataFrame, a: str, b: str, alpha: float, out: str = "blend") -> DataFrame:
    """(1 - alpha) z(a) + alpha z(b)."""
    both = z_score(z_score(df, a, "__za"), b, "__zb")
    return both.withColumn(out, (1 - alpha) * F.col("__za") + alpha * F.col("__zb")).drop("__za", "__zb")


def unanimous(df: DataFrame, channels: list[str], key: str, q: float) -> DataFrame:
    """Drop the rows whose rank fraction is below q in every channel; channels without any score do not vote."""
    live = [c for c in channels if df.agg(F.count(abstain(c))).first()[0]]
    if q <= 0 or not live:
        return df
    out = df
    for c in live:
        out = rank_fraction(out, c, key, f"__f_{c}")
    best = F.greatest(*(F.col(f"__f_{c}") for c in live)) if len(live) > 1 else F.col(f"__f_{live[0]}")
    return out.where(best >= q).select(*df.columns)


def confidence_cut(scores: DataFrame, score: str, alpha: float, most: int) -> DataFrame:
    """One row, keep: how many of the best scores to return.

    The larger of the scores at alpha x the mean of the five best or more among
    the `most` best, and of mad_cut; mad_cut alone if alpha is not positive.
    """
    s = scores.select(abstain(score).alias("s")).where("s is not null")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    base = mad_cut(scores, score, most).withColumnRenamed("keep", "base")
    if alpha <= 0:
        return base.select(F.col("base").alias("keep"))
    top = s.orderBy(F.col("s").desc()).limit(5).agg(F.avg("s").alias("top"))
    head = s.crossJoin(F.broadcast(top)).agg(F.count(F.when(F.col("s") >= alpha * F.col("top"), 1)).alias("head"), F.max("top").alias("top"))
    whole = F.least(F.col("n"), F.lit(most))
    return head.crossJoin(base).crossJoin(n).select(F.when(F.col("n") == 0, 0).when(F.col("top") <= 0, whole).otherwise(F.greatest(F.least("head", whole), "base")).cast("long").alias("keep"))


def mad_cut(scores: DataFrame, score: str, most: int) -> DataFrame:
    """One row, keep: scores at the median + 3 x 1.4826 x the median absolute deviation or more, between 1 and `most`.

    Without deviation, scores above the median; of fewer than four scores all.
    """
    s = scores.select(abstain(score).alias("s")).where("s is not null")
    median = s.agg(F.percentile("s", 0.5).alias("m"), F.count(F.lit(1)).alias("n"))
    spread = s.crossJoin(F.broadcast(median)).agg(F.percentile(F.abs(F.col("s") - F.col("m")), 0.5).alias("d"), F.max("m").alias("m"), F.max("n").alias("n"))
    kept = s.crossJoin(F.broadcast(spread)).agg(F.count(F.when(F.col("d") > 0, F.when(F.col("s") >= F.col("m") + 3.0 * 1.4826 * F.col("d"), 1)).otherwise(F.when(F.col("s") > F.col("m"), 1))).alias("k"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    return kept.select(F.when(F.col("n") < 4, F.least(F.col("n"), F.lit(most))).otherwise(F.greatest(F.lit(1), F.least("k", F.col("n"), F.lit(most)))).cast("long").alias("keep"))


def _histogram(s: DataFrame, bins: int, low: float, high: float) -> np.ndarray:
    """Counts of equal bins over [low, high], the last one closed; at most `bins` rows reach the driver."""
    place = F.least(F.lit(bins - 1), F.floor((F.col("s") - low) * F.lit(bins / (high - low)))).cast("int")
    out = np.zeros(bins)
    for r in s.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def _otsu(hist: np.ndarray, values: np.ndarray) -> int:
    """The bin after which the variance between two classes is largest."""
    p = hist / max(hist.sum(), 1)
    w, m = np.cumsum(p), np.cumsum(p * values)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w - m) ** 2 / (w * (1 - w))
    between[~np.isfinite(between)] = -1
    return int(between.argmax())


def otsu_cut(scores: DataFrame, score: str, most: int) -> int:
    """How many of the best scores stand above the valley of a histogram of 64 bins of the head; all of `most` if there is none."""
    s = scores.select(abstain(score).alias("s")).where("s is not null")
    total = s.count()
    n = min(total, most)
    if n < 4:
        return n
    head = s.orderBy(F.col("s").desc()).limit(max(4 * n, 200))
    low, high = head.agg(F.min("s"), F.max("s")).first()
    if high - low < 1e-9:
        return n
    edges = np.linspace(low, high, 65)
    mids = (edges[:-1] + edges[1:]) / 2
    threshold = float(mids[_otsu(_histogram(head, 64, low, high), mids)])
    keep = s.orderBy(F.col("s").desc()).limit(n).where(F.col("s") >= threshold).count()
    return min(max(keep, 1), n) if keep else n


def loo_cut(ranks: list[int], most: int) -> int:
    """The deepest rank (from 0) of a held-out seed, corrected for a maximum of few, between 1 and `most`."""
    m = len(ranks)
    return max(1, min(int(round(max(ranks) * (m + 1) / m)), most)) if m else most


def fit_cut(df: DataFrame, value: str, mode: str = "knee", q: float = 99.0) -> dict | None:
    """A threshold from a column: its q-th percentile, the valley of its histogram, or the middle of the widest gap within 5 to 95 per cent.

    With it the separation of the means around it in deviations; None for fewer
    than eight values.
    """
    s = df.select(abstain(value).alias("s")).where("s is not null")
    n = s.count()
    if n < 8:
        return None
    if mode == "quantile":
        cut = s.agg(F.percentile("s", q / 100)).first()[0]
    elif mode == "otsu":
        bins = min(256, max(16, n // 8))
        low, high = s.agg(F.min("s"), F.max("s")).first()
        if high <= low:
            return {"n": n, "cut": low, "separation": 0.0}
        cut = low + (high - low) * (_otsu(_histogram(s, bins, low, high), np.arange(bins)) + 1) / bins
    else:
        placed = global_order(s, [F.col("s").asc()], "p").where(F.col("p").between(int(0.05 * n), int(0.95 * n) - 1))
        ahead = placed.select((F.col("p") - 1).alias("p"), F.col("s").alias("t"))
        widest = placed.join(ahead, "p").select((F.col("t") - F.col("s")).alias("g"), "p", ((F.col("s") + F.col("t")) / 2).alias("c")).orderBy(F.col("g").desc(), "p").limit(1).collect()
        cut = widest[0]["c"] if widest else s.agg(F.percentile("s", 0.5)).first()[0]
    r = s.agg(F.avg(F.when(F.col("s") <= cut, F.col("s"))), F.avg(F.when(F.col("s") > cut, F.col("s"))), F.stddev_pop("s")).first()
    gap = (r[1] - r[0]) / (r[2] + 1e-12) if r[0] is not None and r[1] is not None else 0.0
    return {"n": n, "cut": float(cut), "separation": float(gap)}


def abstention_cut(scores: list[float], rule: str, loo: list[float] = ()) -> int:
    """How many of a returned list of scores (descending) to keep: fullk, loo, loo_p25, gap or mad."""
    s = np.asarray(scores, dtype=float)
    if rule == "fullk" or not len(s):
        return len(s)
    if rule in ("loo", "loo_p25"):
        return max(int((s >= (min(loo) if rule == "loo" else np.percentile(loo, 25))).sum()), 1) if len(loo) else len(s)
    if rule == "gap":
        first = max(int(0.15 * len(s)), 2)
        return first + int(np.argmax((s[:-1] - s[1:])[first:])) + 1 if len(s) >= 4 else len(s)
    middle = np.median(s)
    return max(int((s >= middle + 3 * (np.median(np.abs(s - middle)) + 1e-12)).sum()), 1)


def score_cut(values: list[float], most: int = 8) -> float:
    """Otsu's threshold applied again to the upper part while it explains more of the variance and eight values remain."""
    s, best, cut = np.sort(np.asarray(values, dtype=float)), 0.0, -np.inf
    for _ in range(most):
        if len(s) < 8 or s[-1] - s[0] < 1e-12:
            break
        k = np.arange(1, len(s))
        low, high = np.cumsum(s)[:-1] / k, (s.sum() - np.cumsum(s)[:-1]) / (len(s) - k)
        between = k * (len(s) - k) / len(s) ** 2 * (high - low) ** 2
        at = int(between.argmax())
        share = float(between[at] / s.var())
        if share <= best:
            break
        best, cut, s = share, float(s[at + 1]), s[at + 1 :]
    return cut


def suppress(df: DataFrame, stream: str, position: str, score: str, radius: int) -> DataFrame:
    """Temporal suppression: by falling score, a row goes if one that stays lies within the radius in its stream; radius 0 keeps all.

    Suppression never crosses streams, so streams are independent; a stream is
    split further where neighbours are more than a radius apart, and such a
    stretch is what one task holds.
    """
    if radius <= 0:
        return df
    w = Window.partitionBy(stream).orderBy(position)
    runs = df.withColumn("__new", F.when(F.col(position) - F.lag(position).over(w) <= radius, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    names = df.columns

    def keep(pdf: object) -> object:
        """A row that stays strikes out its neighbours; a row has two such at most beside those at one place, so this is linear."""
        order = pdf[[score, position]].reset_index(drop=True).sort_values([score, position], ascending=[False, True], kind="stable").index.tolist()
        by = np.argsort(pdf[position].to_numpy(), kind="stable")
        place, at = np.empty(len(by), dtype=np.int64), pdf[position].to_numpy()[by].tolist()
        place[by] = np.arange(len(by))
        place, open_, chosen = place.tolist(), bytearray(b"\1") * len(by), []
        for k in order:
            i = place[k]
            if not open_[i]:
                continue
            chosen.append(k)
            j = i - 1
            while j >= 0 and at[i] - at[j] <= radius:
                open_[j] = 0
                j -= 1
            j = i + 1
            while j < len(at) and at[j] - at[i] <= radius:
                open_[j] = 0
                j += 1
        return pdf.iloc[chosen][names]

    return runs.groupBy(stream, "__run").applyInPandas(keep, df.schema)


def corroboration(df: DataFrame, channels: list[str]) -> dict[str, float]:
    """Weight 0 for channels whose z-scores run against the pooled z-scores of the others, else 1; all 1 if there are fewer than three."""
    if len(channels) < 3:
        return dict.fromkeys(channels, 1.0)
    z = df
    for c in channels:
        z = z_score(z, c, f"z_{c}")
    rest = {c: sum((F.coalesce(F.col(f"z_{d}"), F.lit(0.0)) for d in channels if d != c), F.lit(0.0)) for c in channels}
    r = z.agg(*(F.covar_pop(F.col(f"z_{c}"), rest[c]).alias(c) for c in channels)).first()  # of the correlation's sign
    return {c: 0.0 if r[c] is not None and r[c] < 0 else 1.0 for c in channels}


def informativeness(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: 1 - |Pearson correlation| of two columns."""
    return df.agg((1 - F.abs(F.corr(abstain(a), abstain(b)))).alias("informativeness"))


def rank_correlation(df: DataFrame, a: str, b: str, tie: str) -> DataFrame:
    """One row: the correlation of the ranks of two columns."""
    both = rank_fraction(rank_fraction(df, a, tie, "__a", None), b, tie, "__b", None)
    return both.agg(F.corr("__a", "__b").alias("spearman"))


def permute_head(df: DataFrame, key: str, score: str, again: str, head: int) -> DataFrame:
    """The `head` best rows put in the order of another score, keeping the sorted list of score values; other rows as they were."""
    best = df.orderBy(F.col(score).desc(), key).limit(head)
    values = best.select(F.row_number().over(Window.orderBy(F.col(score).desc(), key)).alias("__r"), F.col(score).alias("__v"))
    moved = best.withColumn("__r", F.row_number().over(Window.orderBy(F.col(again).desc_nulls_last(), key))).join(values, "__r").withColumn(score, F.col("__v")).drop("__r", "__v")
    return moved.select(*df.columns).unionByName(df.join(best.select(key), key, "left_anti").select(*df.columns))



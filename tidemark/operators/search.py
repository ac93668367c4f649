"""Composed searches: by example, by events, by metadata, and pipelines over score channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import constant, dot, log_likelihood, unit
from tidemark.operators import ranking
from tidemark.operators.vectors import mean_vector, top_k
from tidemark.session import written

#: Depths, as shares of the corpus, at which a held-out seed may come back.
LADDER = (1 / 80, 1 / 40, 1 / 20, 1 / 10, 1 / 5, 2 / 5)
#: Seeds of a query at most; every score is made for each of them.
MOST_SEEDS = 16


def _score(op: str, vector: str, seed: list[float]) -> Column:
    return log_likelihood(F.col(vector), constant(seed)) if op == "crossent" else dot(F.col(vector), constant(seed))


def seed_vectors(df: DataFrame, key: str, vector: str, seeds: list) -> dict:
    """The vectors of the seeds, a bounded number of rows."""
    if len(seeds) > MOST_SEEDS:
        raise ValueError(f"at most {MOST_SEEDS} seeds")
    return {r[key]: list(map(float, r[vector])) for r in df.where(F.col(key).isin(seeds)).select(key, vector).collect()}


def loo_quality(df: DataFrame, key: str, vector: str, seeds: list, op: str = "cosine") -> float:
    """How well each seed finds each other one: the mean, over ordered pairs and a ladder of depths, of being within the depth.

    All pairs are counted in one pass.  0 for fewer than three seeds or a seed
    without a vector.
    """
    own = seed_vectors(df, key, vector, seeds)
    if len(seeds) < 3 or len(own) < len(set(seeds)):
        return 0.0
    n = df.count()
    depths = [max(2, round(f * n)) for f in LADDER]
    scored = df.select(key, *(_score(op, vector, own[j]).alias(f"s{b}") for b, j in enumerate(seeds)))
    held = {r[key]: r for r in scored.where(F.col(key).isin(seeds)).collect()}
    pairs = [(a, b) for a in range(len(seeds)) for b in range(len(seeds)) if a != b]
    above = lambda a, b: F.count(F.when(~F.col(key).isin([s for s in seeds if s != seeds[a]]) & (F.col(f"s{b}") > held[seeds[a]][f"s{b}"]), 1))
    ranks = scored.agg(*(above(a, b).alias(f"r{a}_{b}") for a, b in pairs)).first()
    return sum(sum(r < d for d in depths) / len(depths) for r in ranks) / len(pairs)


def coherence(df: DataFrame, key: str, vector: str, seeds: list, op: str = "cosine") -> float:
    """2 x (the chance that a pair of seeds scores above a seed and another row) - 1, at least 0; 0 for one seed or a corpus under ten rows."""
    own = seed_vectors(df, key, vector, seeds)
    if len(own) < 2:
        return 0.0
    names = [s for s in seeds if s in own]
    within = [r[0] for i, a in enumerate(names) for r in df.where(F.col(key) == names[i]).select(F.explode(F.array(*(_score(op, vector, own[b]) for b in names[i + 1 :])) if names[i + 1 :] else F.array().cast("array<double>"))).collect() if a]
    others = df.where(~F.col(key).isin(names)).select(F.explode(F.array(*(_score(op, vector, own[b]) for b in names))).alias("s"))
    counts = others.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col("s") < w, 1)).alias(f"w{k}") for k, w in enumerate(within))).first()
    if counts["n"] < 10 * len(names):
        return 0.0
    p = sum(counts[f"w{k}"] for k in range(len(within))) / (len(within) * counts["n"])
    return max(p - 0.5, 0.0) * 2


def _fused(channels: dict[str, tuple[DataFrame, str]], key: str, vector: str, groups: list[list], weights: dict[str, float]) -> DataFrame | None:
    """For each group of seeds the weighted sum over channels of z-scored similarity to their mean vector (s0, s1, ...), for rows that every voting channel scores.

    A channel is scored for all groups in one pass, and their means and deviations are one aggregate.
    """
    total = None
    for c, (df, op) in channels.items():
        own = seed_vectors(df, key, vector, groups[0]) if weights.get(c, 0) > 0 else {}
        if not own:
            continue
        means = []
        for group in groups:
            mine = [own[s] for s in group if s in own]
            mean = [sum(x) / max(len(mine), 1) for x in zip(*(mine or [[0.0] * len(next(iter(own.values())))]), strict=True)]
            if op != "crossent":
                length = sum(x * x for x in mean) ** 0.5 + 1e-8
                mean = [x / length for x in mean]
            means.append(mean)
        scored = df.select(key, *(_score(op, vector, m).alias(f"s{g}") for g, m in enumerate(means)))
        stats = scored.agg(*(f(F.col(f"s{g}")).alias(f"{n}{g}") for g in range(len(groups)) for n, f in (("m", F.avg), ("d", F.stddev_pop)))).first()
        z = lambda g: weights[c] * (F.col(f"s{g}") - F.lit(stats[f"m{g}"])) / F.nullif(F.lit(stats[f"d{g}"]), F.lit(0.0))  # noqa: B023, E731
        part = scored.select(key, *(z(g).alias(f"__{c}_{g}") for g in range(len(groups))))
        total = part if total is None else total.join(part, key)
    if total is None:
        return None
    sums = (reduce(lambda a, b: a + b, (F.col(n) for n in total.columns if n.endswith(f"_{g}"))).alias(f"s{g}") for g in range(len(groups)))
    return written(total.select(key, *sums), "fused")


def search_like(channels: dict[str, tuple[DataFrame, str]], key: str, vector: str, seeds: list, most: int, power: float = 8.0) -> tuple[DataFrame, dict[str, float]]:
    """Rows like the seeds, best first, as many as the seeds' own ranks vouch for, and the channels' qualities.

    channels: name -> (table of key and vector, "cosine" or "crossent").  Three
    seeds or more weigh channels by loo_quality, two by coherence, one equally;
    weights are (quality / best) ** power, equal ones if the best is 0.  The cut
    holds each seed out in turn; all of these are scored together and ranked in
    one aggregate.
    """
    if len(seeds) >= 3:
        quality = {c: loo_quality(df, key, vector, seeds, op) for c, (df, op) in channels.items()}
    elif len(seeds) == 2:
        quality = {c: coherence(df, key, vector, seeds, op) for c, (df, op) in channels.items()}
    else:
        quality = dict.fromkeys(channels, 1.0)
    best = max(quality.values(), default=0.0)
    if best <= 0:
        quality, best = dict.fromkeys(channels, 1.0), 1.0
    weights = {c: (q / best) ** power for c, q in quality.items()}
    held = list(seeds) if len(seeds) >= 3 else []
    fused = _fused(channels, key, vector, [list(seeds), *([x for x in seeds if x != s] for s in held)], weights)
    if fused is None:
        raise ValueError("no channel has the seeds")
    own = {r[key]: r for r in fused.where(F.col(key).isin(held)).collect()} if held else {}
    above = [F.count(F.when(~F.col(key).isin([x for x in seeds if x != s]) & (F.col(f"s{g + 1}") > own[s][f"s{g + 1}"]), 1)).alias(f"r{g}") for g, s in enumerate(held) if s in own]
    ranks = list(fused.agg(*above).first()) if above else []
    found = fused.where(~F.col(key).isin(list(seeds))).select(key, F.col("s0").alias("score"))
    keep = ranking.loo_cut(ranks, most) if ranks else ranking.otsu_cut(found, "score", most)
    return top_k(found, "score", keep, key), quality


def answer(events: DataFrame, wanted: list[tuple[str, dict[str, Column]]], episode: str = "episode", kind: str = "kind", key: str = "event_id", scene: DataFrame | None = None) -> DataFrame:
    """Episodes ranked by how well their events answer a query's events.

    wanted: (kind, {channel: score}) of each query event.  Per query event, each
    candidate event of the kind has the least of its channels' percentile ranks;
    an episode has the greatest of its events; the greatest within a kind and the
    least across kinds count, and 0 stands for none.  A scene table (episode,
    scene) in percentile ranks bounds the result from above.  `kinds` counts the
    query's kinds that the episode has.
    """
    parts = []
    for i, (name, channels) in enumerate(wanted):
        own = events.where(F.col(kind) == name)
        for c, score in channels.items():
            own = ranking.percentile_rank(own.withColumn(f"__c_{c}", score), f"__c_{c}", key, f"__p_{c}")
        least = F.least(*(F.col(f"__p_{c}") for c in channels)) if len(channels) > 1 else F.col(f"__p_{next(iter(channels))}")
        parts.append(own.groupBy(episode).agg(F.max(least).alias("s")).select(episode, F.lit(name).alias("__kind"), F.lit(i).alias("__i"), "s"))
    both = reduce(DataFrame.unionByName, parts)
    per_kind = both.groupBy(episode, "__kind").agg(F.max("s").alias("s"))
    per = per_kind.groupBy(episode).agg(F.coalesce(F.min("s"), F.lit(0.0)).alias("score"), F.count(F.lit(1)).alias("kinds"))
    if scene is not None:
        per = per.join(scene, episode, "left").withColumn("score", F.least("score", "scene")).drop("scene")
    return per


def plan(start: DataFrame, key: str, steps: list[tuple[str, DataFrame]]) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Candidates that every step's table has, cheap tables first, and how many each step kept."""
    kept = [("start", start.count())]
    out = start
    for name, table in steps:
        out = out.join(table.select(key).distinct(), key, "left_semi")
        kept.append((name, out.count()))
    return out, kept


def two_hops(links: DataFrame, item: str, group: str, seed: object) -> DataFrame:
    """Groups that share an item with a seed group, with how many, the seed left out."""
    mine = links.where(F.col(group) == F.lit(seed)).select(item).distinct()
    return links.join(mine, item, "left_semi").where(F.col(group) != F.lit(seed)).groupBy(group).agg(F.countDistinct(item).alias("shared"))


def feedback(df: DataFrame, key: str, vector: str, score: str, top: int = 25, out: str = "feedback") -> DataFrame:
    """The similarity of each row to the mean vector of the best rows so far: one more channel for fusion."""
    best = df.orderBy(F.col(score).desc(), key).limit(top)
    center = mean_vector(best.withColumn("__g", F.lit(0)), ["__g"], vector).select(F.col(vector).alias("__q"))
    return df.crossJoin(F.broadcast(center)).withColumn(out, dot(unit(F.col(vector)), F.col("__q"))).drop("__q")


def search_set(df: DataFrame, channels: dict[str, float], key: str, vector: str, stream: str, position: str, most: int, alpha: float = 0.0, q: float = 0.1, radius: int = 0, feedback_weight: float = 3.0) -> DataFrame:
    """Channels fused by reciprocal ranks, a feedback voter, a unanimous filter, suppression of neighbours, and a calibrated cut."""
    fused = written(ranking.rrf(df, channels, key, out="__first"), "first")
    voted = feedback(fused, key, vector, "__first")
    again = ranking.rrf(voted.drop("__first", *(f"rank_{c}" for c in channels)), {**channels, "feedback": feedback_weight}, key, out="score")
    kept = ranking.unanimous(written(again, "again"), list(channels), key, q)
    thin = written(ranking.suppress(kept, stream, position, "score", radius), "thin")
    cut = ranking.confidence_cut(thin, "score", alpha, most)
    ranked = thin.orderBy(F.col("score").desc(), key).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), key)))
    return ranked.crossJoin(F.broadcast(cut)).where(F.col("rank") <= F.col("keep")).drop("keep")


def best_per_group(df: DataFrame, group: str, score: str, tie: str, floor: float) -> DataFrame:
    """Per group, of rows scored at `floor` or more: the best row's tie key, its score, and the support."""
    return df.where(F.col(score) >= floor).groupBy(group).agg(F.max_by(tie, F.struct(F.col(score), (-F.col(tie)).alias("t"))).alias(tie), F.max(score).alias("best"), F.count(F.lit(1)).alias("support"))

"""Vector search: pooled vectors, exact and pruned nearest neighbours, codes, hubness correction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.vectors import add, constant, dot, hamming, scale, sign_lanes, unit
from tidemark.session import written

#: Bytes of a query or centroid matrix that may be broadcast.
BROADCAST_BYTES = 64 << 20


def mean_vector(df: DataFrame, by: list[str], vector: str, normalize: bool = True) -> DataFrame:
    """The element-wise mean of each group's vectors, of unit length if wanted.

    Elements are summed by (group, place) with partial sums, so a group of any
    size is spread over tasks.
    """
    flat = df.select(*by, F.posexplode(F.col(vector).cast("array<double>")).alias("__p", "__x"))
    means = flat.groupBy(*by, "__p").agg(F.avg("__x").alias("__m"))
    whole = means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__m"))), lambda s: s["__m"]).alias(vector))
    return whole.withColumn(vector, unit(F.col(vector))) if normalize else whole


def top_k(df: DataFrame, score: str, k: int, tie: str, by: list[str] = ()) -> DataFrame:
    """The k rows of the highest scores (of each group), with rank from 1; ties go to the smaller tie key."""
    order = [F.col(score).desc_nulls_last(), F.col(tie)]
    if by:
        ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        return ranked.where(F.col("rank") <= k)
    best = df.orderBy(*order).limit(k)  # a top-k of each task, then of those
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def knn(df: DataFrame, vector: str, query: list[float], k: int, key: str, where: object = None) -> DataFrame:
    """Exact nearest neighbours of one vector by dot product; a filter is applied before scores are made."""
    rows = df if where is None else df.where(where)
    return top_k(rows.withColumn("score", dot(F.col(vector), constant(query))), "score", k, key)


def compositional(df: DataFrame, vector: str, positive: list[list[float]], negative: list[list[float]], weight: float = 1.0) -> DataFrame:
    """Score: the least similarity to a positive query minus weight x the greatest to a negative one."""
    score = F.least(*(dot(F.col(vector), constant(q)) for q in positive)) if len(positive) > 1 else dot(F.col(vector), constant(positive[0]))
    if negative:
        worst = F.greatest(*(dot(F.col(vector), constant(q)) for q in negative)) if len(negative) > 1 else dot(F.col(vector), constant(negative[0]))
        score = score - weight * worst
    return df.withColumn("score", score)


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, query_key: str, key: str, vector: str = "embedding", block: int = 4096) -> DataFrame:
    """The k nearest rows of the corpus to every query (query key, key, score, rank), in blocks of queries.

    A block of queries is broadcast as a matrix; each batch of the corpus is
    multiplied with it and keeps its own k best, and those are merged by a
    grouped top-k.  The driver holds one block of queries at a time.
    """
    fields = [T.StructField(query_key, queries.schema[query_key].dataType), T.StructField(key, corpus.schema[key].dataType), T.StructField("score", T.DoubleType())]
    schema, spark = T.StructType(fields), queries.sparkSession
    blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(blocks):
        part = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b)).select(query_key, F.col(vector).cast("array<double>").alias(vector)).toPandas()
        shared = spark.sparkContext.broadcast((part[query_key].to_numpy(), np.stack(part[vector].to_numpy()) if len(part) else np.zeros((0, 1))))

        def run(batches: object, shared: object = shared) -> object:
            names, matrix = shared.value
            for pdf in batches:
                if not len(pdf) or not len(names):
                    continue
                keys = pdf[key].to_numpy()
                order = np.argsort(keys, kind="stable")
                keys, own = keys[order], np.stack(pdf[vector].to_numpy())[order].astype(float)
                for at in range(0, len(names), 256):
                    scores = matrix[at : at + 256] @ own.T
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    yield pd.DataFrame({query_key: np.repeat(names[at : at + 256], best.shape[1]), key: keys[best.ravel()], "score": np.take_along_axis(scores, best, 1).ravel()})

        found = corpus.select(key, F.col(vector).cast("array<double>").alias(vector)).mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return top_k(out, "score", k, key, [query_key])


def assign(df: DataFrame, centroids: DataFrame, vector: str, code: str = "code") -> DataFrame:
    """The nearest centroid of each vector and the margin to the second; centroids (code, vector) are broadcast if small enough."""
    rows = centroids.select(F.col(code), F.col(vector).cast("array<double>").alias("v")).collect() if centroids.count() * 8 * 2048 <= BROADCAST_BYTES else None
    if rows is None:
        raise ValueError("too many centroids for one table of them")
    options = F.array(*(F.struct(dot(F.col(vector), constant(r["v"])).alias("s"), (-F.lit(r[code])).alias("c")) for r in rows))
    best = F.sort_array(options, asc=False)
    second = F.try_element_at(best, F.lit(2))["s"]
    return df.withColumn("__best", best).withColumn(code, -F.col("__best")[0]["c"]).withColumn("margin", F.col("__best")[0]["s"] - F.coalesce(second, F.lit(-1.0))).drop("__best")


def ivf(df: DataFrame, centroids: DataFrame, vector: str, query: list[float], k: int, key: str, nprobe: int, cluster: str = "cluster") -> DataFrame:
    """Nearest neighbours in the nprobe cells whose centroids are nearest; rows of no cell (negative) are always looked at."""
    cells = top_k(centroids.withColumn("score", dot(F.col(vector), constant(query))), "score", nprobe, cluster).select(cluster)
    inside = df.join(F.broadcast(cells), cluster, "left_semi")
    return knn(inside.unionByName(df.where(F.col(cluster) < 0)), vector, query, k, key)


def probe_codes(df: DataFrame, centroids: DataFrame, vector: str, query: list[float], within: float = 0.05, code: str = "code") -> DataFrame:
    """Rows of the cells whose centroid's similarity to the query is within `within` of the best."""
    scored = centroids.withColumn("__s", dot(F.col(vector), constant(query)))
    best = scored.agg(F.max("__s").alias("__b"))
    cells = scored.crossJoin(F.broadcast(best)).where(F.col("__s") >= F.col("__b") - within).select(code)
    return df.join(F.broadcast(cells), code, "left_semi")


def sign_code_search(df: DataFrame, vector: str, query: list[float], k: int, key: str, shortlist: int) -> DataFrame:
    """A shortlist by Hamming distance of sign codes, then the exact k best of it."""
    dim = len(query)
    coded = df.withColumn("__h", hamming(sign_lanes(F.col(vector), dim), sign_lanes(constant(query), dim)))
    near = coded.orderBy("__h", key).limit(shortlist).drop("__h")
    return knn(near, vector, query, k, key)


def csls(df: DataFrame, vector: str, queries: list[list[float]], key: str, k: int, neighbours: int = 16, sample: DataFrame | None = None) -> DataFrame:
    """Hubness-corrected scores: 2 x the best similarity to a query, minus the row's and the queries' mean similarity to their nearest neighbours.

    The neighbours are those among all rows (or in a sample, if one is given),
    found block by block; keys are unique.
    """
    base = (sample if sample is not None else df).select(F.col(key).alias("__n"), vector)

    def hubs(rows: DataFrame) -> DataFrame:
        return knn_join(rows, base, neighbours, "__k", "__n", vector).groupBy("__k").agg(F.avg("score").alias("__hub"))

    asked = df.sparkSession.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(queries)], f"__k long, {vector} array<double>")
    own = hubs(asked).agg(F.avg("__hub")).first()[0]
    if own is None:
        own = 0.0  # there are no rows
    scored = df.join(hubs(df.select(F.col(key).alias("__k"), vector)), F.col(key) == F.col("__k")).drop("__k")
    best = F.greatest(*(dot(F.col(vector), constant(x)) for x in queries)) if len(queries) > 1 else dot(F.col(vector), constant(queries[0]))
    return top_k(scored.withColumn("score", 2 * best - F.col("__hub") - F.lit(own)).drop("__hub"), "score", k, key)


def clip_query(df: DataFrame, vector: str, probe: object, k: int, key: str) -> DataFrame:
    """Nearest neighbours of the mean of the probe rows (a filter), themselves left out."""
    mean = mean_vector(df.where(probe).withColumn("__g", F.lit(0)), ["__g"], vector).select(F.col(vector).alias("__q"))
    rest = df.where(~probe).crossJoin(F.broadcast(mean))
    return top_k(rest.withColumn("score", dot(F.col(vector), F.col("__q"))).drop("__q"), "score", k, key)


def opposites(df: DataFrame, vector: str, key: str, most: float = -0.25) -> DataFrame:
    """Unordered pairs of keys of which one is the other's most opposed after the mean is taken out, at a cosine of `most` or less.

    For vocabularies: the matrix of all vectors is broadcast, and its size is checked.
    """
    rows = df.select(key, F.col(vector).cast("array<double>").alias("v")).orderBy(key)
    n = rows.count()
    if n * 8 * 2048 > BROADCAST_BYTES:
        raise ValueError("too many vectors to compare each with each")
    pdf = rows.toPandas()
    x = np.stack(pdf["v"].to_numpy())
    x = x - x.mean(0)
    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    s = x @ x.T
    worst = s.argmin(1)
    names = pdf[key].tolist()
    pairs = sorted({(min(names[i], names[j]), max(names[i], names[j]), round(float(s[i, j]), 9)) for i, j in enumerate(worst.tolist()) if s[i, j] <= most})
    return df.sparkSession.createDataFrame(pairs, T.StructType([T.StructField("a", df.schema[key].dataType), T.StructField("b", df.schema[key].dataType), T.StructField("cosine", T.DoubleType())]))


def covariance(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, population covariance and rows: partial sums of each task, of a size that the dimension sets."""

    def run(batches: object) -> object:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                yield pd.DataFrame({"g": [0], "n": [len(x)], "s": [x.sum(0).tolist()], "c": [(x.T @ x).ravel().tolist()]})

    parts = df.select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(run, "g int, n long, s array<double>, c array<double>")
    sums = parts.select("n", F.posexplode(F.concat("s", "c")).alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("p").collect()  # dim + dim^2 rows
    if not sums:
        raise ValueError("there are no vectors")
    n = sums[0]["n"]
    flat = np.array([r["x"] for r in sums])
    dim = int((-1 + (1 + 4 * len(flat)) ** 0.5) / 2)
    mean = flat[:dim] / n
    return mean, flat[dim:].reshape(dim, dim) / n - np.outer(mean, mean), n


def whiten(df: DataFrame, vector: str, out: str = "white", drop: int = 0, keep: int | None = None) -> DataFrame:
    """Vectors in principal axes scaled to unit variance, the first `drop` left out and at most `keep` kept."""
    mean, cov, _ = covariance(df, vector)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[drop:][:keep]
    basis = axes[:, order] / np.sqrt(np.maximum(values[order], 1e-12))
    shared = df.sparkSession.sparkContext.broadcast((mean, basis))

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        m, b = shared.value
        return pd.Series(list((np.stack(v.to_numpy()).astype(float) - m) @ b))

    return df.withColumn(out, project(F.col(vector).cast("array<double>")))


def effective_rank(df: DataFrame, vector: str) -> tuple[float, float]:
    """exp of the entropy of the covariance's normalised eigenvalues, and the participation ratio."""
    _, cov, _ = covariance(df, vector)
    values = np.maximum(np.linalg.eigvalsh(cov), 0)
    p = values / values.sum()
    return float(np.exp(-(p[p > 0] * np.log(p[p > 0])).sum())), float(values.sum() ** 2 / (values**2).sum())


def product_codes(df: DataFrame, vector: str, m: int, codes: int, seed: int = 0, sample: int = 20_000, out: str = "pq") -> tuple[DataFrame, np.ndarray]:
    """Product-quantized codes (m bytes) and the codebooks, fitted by k-means on at most `sample` rows of the smallest hashes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(F.col(vector).cast("array<double>").alias("v"))
    fit = rows.orderBy(F.xxhash64("v")).limit(sample)
    dim = len(fit.first()["v"])
    step, books = dim // m, []
    for k in range(m):
        part = fit.select(array_to_vector(F.slice("v", k * step + 1, step)).alias("features"))
        model = KMeans(k=codes, seed=seed, maxIter=10).fit(part)
        books.append(np.stack(model.clusterCenters()))
    width = max(len(b) for b in books)
    table = np.full((m, width, step), np.inf)
    for k, b in enumerate(books):
        table[k, : len(b)] = b
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<int>")
    def encode(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float).reshape(len(v), shared.value.shape[0], -1)
        d = ((x[:, :, None, :] - np.where(np.isinf(shared.value), 1e9, shared.value)[None]) ** 2).sum(-1)
        return pd.Series(list(d.argmin(-1).astype(np.int32)))

    return df.withColumn(out, encode(F.col(vector).cast("array<double>"))), table


def adc_search(coded: DataFrame, books: np.ndarray, vector: str, query: list[float], k: int, key: str, rerank: int = 4, codes: str = "pq") -> DataFrame:
    """Scores by table lookups of the codes, the rerank x k best of which are scored exactly."""
    m, width, step = books.shape
    q = np.asarray(query, dtype=float).reshape(m, step)
    table = np.where(np.isinf(books).any(-1), -1e9, (np.where(np.isinf(books), 0, books) * q[:, None, :]).sum(-1))
    lookup = constant(table.ravel().tolist())
    rough = F.aggregate(F.transform(F.col(codes), lambda c, i: F.get(lookup, i * width + c)), F.lit(0.0), lambda s, x: s + x)
    near = top_k(coded.withColumn("__r", rough), "__r", rerank * k, key).drop("__r", "rank")
    return knn(near, vector, query, k, key)


def _code_batches(queries: DataFrame, query_key: str, vector: str, block: int) -> object:
    """Blocks of the queries as (names, vectors, signs), each held by the driver in turn; a query costs a row of two matrices."""
    blocks = max(1, -(-queries.count() // block))
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b)
        part = own.select(query_key, F.col(vector).cast("array<double>").alias(vector)).toPandas()
        if len(part):
            matrix = np.stack(part[vector].to_numpy())
            yield part[query_key].to_numpy(), matrix, np.where(matrix >= 0, 1, -1).astype(np.float32)


def _distances(signs: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Signs in which each query's code differs from each row's."""
    return ((own.shape[1] - signs @ np.where(own >= 0, 1, -1).astype(np.float32).T) / 2).astype(np.int64)


def code_depths(queries: DataFrame, corpus: DataFrame, k: int, query_key: str, key: str, vector: str = "embedding", block: int = 1024) -> np.ndarray:
    """For each of the true k nearest rows of each query, how many rows the codes put before it (ties by key).

    For a sample of queries; a pass over the corpus counts for all of them at once.
    """
    spark = queries.sparkSession
    exact = knn_join(queries, corpus, k, query_key, key, vector).select(query_key, key)
    true = exact.join(corpus.select(key, F.col(vector).cast("array<double>").alias(vector)), key).toPandas()
    found = []
    for names, _, signs in _code_batches(queries, query_key, vector, block):
        place = {n: i for i, n in enumerate(names.tolist())}
        mine = true[true[query_key].isin(place.keys())]
        if not len(mine):
            continue
        at = np.array([place[n] for n in mine[query_key].tolist()])
        far = ((signs.shape[1] - (signs[at] * np.where(np.stack(mine[vector].to_numpy()) >= 0, 1, -1)).sum(1)) / 2).astype(np.int64)
        shared = spark.sparkContext.broadcast((signs, at, far, mine[key].to_numpy()))

        def run(batches: object, shared: object = shared) -> object:
            signs, at, far, keys = shared.value
            total = np.zeros(len(at), dtype=np.int64)
            for pdf in batches:
                if len(pdf):
                    own, names = _distances(signs, np.stack(pdf[vector].to_numpy())), pdf[key].to_numpy()
                    for i in range(len(at)):
                        row = own[at[i]]
                        total[i] += int(((row < far[i]) | ((row == far[i]) & (names < keys[i]))).sum())
            yield pd.DataFrame({"i": np.arange(len(at)), "n": total})

        counts = corpus.select(key, F.col(vector).cast("array<double>").alias(vector)).mapInPandas(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
        found += [r["n"] for r in counts.collect()]
    return np.array(found, dtype=np.int64)


def sign_code_join(queries: DataFrame, corpus: DataFrame, k: int, query_key: str, key: str, shortlist: int, vector: str = "embedding", recall: float | None = None, sample: int = 256, block: int = 1024) -> DataFrame:
    """The k nearest rows to every query among the `shortlist` whose signs differ least, as sign_code_search() finds them for one.

    A shortlist of a fixed length loses neighbours as the corpus grows.  With
    recall, it is lengthened until it holds that share of the true neighbours of
    `sample` queries (by a hash of the key), which are found by brute force.
    Codes and vectors are compared in blocks of queries: a pass counts distances
    for the cuts, another gives scores of the rows within them.
    """
    fields = [T.StructField(query_key, queries.schema[query_key].dataType), T.StructField(key, corpus.schema[key].dataType), T.StructField("__h", T.LongType()), T.StructField("score", T.DoubleType())]
    schema, spark = T.StructType(fields), queries.sparkSession
    if recall is not None:
        some = written(queries.orderBy(F.xxhash64(query_key), query_key).limit(sample), "sample")
        depths = np.sort(code_depths(some, corpus, k, query_key, key, vector))
        if len(depths):
            shortlist = max(shortlist, int(depths[min(len(depths) - 1, int(np.ceil(recall * len(depths))))]) + 1)
    rows, out = corpus.select(key, F.col(vector).cast("array<double>").alias(vector)), None
    for names, matrix, signs in _code_batches(queries, query_key, vector, block):
        codes = spark.sparkContext.broadcast(signs)

        def count(batches: object, codes: object = codes) -> object:
            signs = codes.value
            bins = signs.shape[1] + 1
            total = np.zeros(len(signs) * bins, dtype=np.int64)
            for pdf in batches:
                if len(pdf):
                    own = _distances(signs, np.stack(pdf[vector].to_numpy()))
                    total += np.bincount((own + np.arange(len(signs))[:, None] * bins).ravel(), minlength=len(total))
            some = np.flatnonzero(total)
            yield pd.DataFrame({"i": some, "n": total[some]})

        bins = signs.shape[1] + 1
        total = np.zeros(len(signs) * bins, dtype=np.int64)
        for r in rows.mapInPandas(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # a number for each query and distance
            total[r["i"]] = r["n"]
        reach = np.cumsum(total.reshape(len(signs), bins), axis=1)
        cuts = np.minimum((reach < shortlist).sum(1), bins - 1)
        shared = spark.sparkContext.broadcast((names, matrix, signs, cuts))

        def run(batches: object, shared: object = shared) -> object:
            names, matrix, signs, cuts = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                keys, own = pdf[key].to_numpy(), np.stack(pdf[vector].to_numpy())
                far = _distances(signs, own)
                q, x = np.nonzero(far <= cuts[:, None])
                yield pd.DataFrame({query_key: names[q], key: keys[x], "__h": far[q, x], "score": np.einsum("nd,nd->n", matrix[q], own[x])})

        found = rows.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    near = out.withColumn("__r", F.row_number().over(Window.partitionBy(query_key).orderBy("__h", key))).where(F.col("__r") <= shortlist)
    return top_k(near.select(query_key, key, "score"), "score", k, key, [query_key])


def diffuse(df: DataFrame, key: str, vector: str, seeds: list, neighbours: int = 10, alpha: float = 0.9, rounds: int = 20) -> DataFrame:
    """Scores spread from seeds over the graph of mutual nearest neighbours: alpha S y + (1 - alpha) y0, so many times."""
    edges = knn_join(df.select(F.col(key).alias("a"), vector), df.select(F.col(key).alias("b"), vector), neighbours + 1, "a", "b", vector).where("a <> b").select("a", "b", F.greatest("score", F.lit(0.0)).alias("w"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.max("w").alias("w"))
    degree = both.groupBy("a").agg(F.sum("w").alias("d"))
    normal = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b").select("a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("e") + 1e-12)).alias("w"))
    normal = written(normal, "affinity")
    start = df.select(F.col(key).alias("a"), F.col(key).isin(seeds).cast("double").alias("y0"))
    state = start.withColumn("y", F.col("y0"))
    for _ in range(rounds):
        spread = normal.join(state.select(F.col("a").alias("b"), "y"), "b").groupBy("a").agg(F.sum(F.col("w") * F.col("y")).alias("s"))
        state = written(start.join(spread, "a", "left").select("a", "y0", (alpha * F.coalesce("s", F.lit(0.0)) + (1 - alpha) * F.col("y0")).alias("y")), "diffusion")
    return state.select(F.col("a").alias(key), F.col("y").alias("score"))


def rank_pool(df: DataFrame, by: list[str], order: str, vector: str) -> DataFrame:
    """The sum over each sequence of (2t - T - 1) times vector t."""
    w = Window.partitionBy(*by)
    own = df.withColumn("__t", F.row_number().over(w.orderBy(order))).withColumn("__n", F.count(F.lit(1)).over(w))
    flat = own.select(*by, (2 * F.col("__t") - F.col("__n") - 1).alias("__w"), F.posexplode(F.col(vector).cast("array<double>")).alias("__p", "__x"))
    sums = flat.groupBy(*by, "__p").agg(F.sum(F.col("__w") * F.col("__x")).alias("__s"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__s"))), lambda s: s["__s"]).alias(vector))


def interpolate(a: object, b: object, share: object) -> object:
    """(1 - share) a + share b of two vectors."""
    return add(scale(a, 1 - share), scale(b, share))

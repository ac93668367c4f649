"""Language identification: multinomial naive Bayes over hashed character n-grams.

Each n-gram of one to three lower-case characters falls in one of a fixed number
of buckets.  Training counts buckets by language on a bounded sample of labelled
rows; the matrix of log-probabilities, languages by buckets, is broadcast, and
batches of whole texts are scored in numpy by gathering and summing rows.
A score is the posterior of the language, which for long texts is close to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._bytes import mix, text_batches, windows

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled rows that training reads about at most, drawn by a hash of their text.
SAMPLE_ROWS = 20_000
SMOOTHING = 0.25
UNKNOWN = "und"
_PARTS = 8
_SALT = mix(np.arange(1, 4, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def buckets(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order of n-grams: the bucket of each n-gram of all texts, and how many each text has."""
    clean = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    size = np.fromiter(map(len, clean), dtype=np.int64, count=len(clean))
    stops = np.cumsum(size)
    spread = points * np.uint64(0x9E3779B97F4A7C15)
    state = np.zeros(len(points), dtype=np.uint64)
    for order in range(1, max(ORDERS) + 1):
        n = len(points) - order + 1
        if n <= 0:
            yield np.zeros(0, dtype=np.int64), np.zeros(len(clean), dtype=np.int64)
            continue
        state = (state[:n] ^ (spread[order - 1 :] + _SALT[order - 1])) * np.uint64(0xBF58476D1CE4E5B9)
        own = (mix(state) >> np.uint64(48)).astype(np.int64) % BUCKETS
        keep = np.maximum(size - order + 1, 0)
        if order > 1:  # n-grams that reach into the next text are none
            inside = np.ones(n, dtype=bool)
            for back in range(1, order):
                at = stops[:-1] - back
                at = at[(at >= 0) & (at < n)]
                inside[at] = False
            own = own[inside]
            keep_total = int(keep.sum())
            if len(own) != keep_total:  # texts shorter than the order
                owner = np.repeat(np.arange(len(clean)), size)[:n][inside]
                keep = np.bincount(owner, minlength=len(clean))
        yield own, keep


@dataclass
class Model:
    """Languages in order, log-probabilities (buckets by languages) and log-priors."""

    languages: list[str]
    weights: np.ndarray
    priors: np.ndarray
    #: If given, the likelihood of a longer text counts as that of so many n-grams; a tempered score is no posterior.
    evidence: int | None = None

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Posterior of each language for each text."""
        total, grams = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for own, count in buckets(texts):
            grams += count
            has = count > 0
            if has.any():
                first = np.r_[0, np.cumsum(count)][:-1][has]
                total[has] += np.add.reduceat(self.weights[own], first, axis=0)
        if self.evidence is not None:
            total *= np.minimum(1.0, self.evidence / np.maximum(grams, 1))[:, None]
        logits = self.priors + total
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def train(df: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE_ROWS, evidence: int | None = None) -> Model | None:
    """Fit on rows with a text and a label; None without any.

    Texts are counted once with each label, however often they are repeated; of a
    table of more rows about `sample` of them are read, drawn by a hash of the
    text.  Priors are the shares of all labelled rows.  evidence: see Model.  The
    driver holds a count per language and a matrix of counts.
    """
    rows = df.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where("text is not null and label is not null")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not counts:
        return None
    languages = sorted(counts)
    total = sum(counts.values())
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    rows = rows.groupBy(F.xxhash64("text").alias("hash"), "label").agg(F.first("text").alias("text")).select("text", "label")
    number = {c: i for i, c in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(number), BUCKETS), dtype=np.int64)
        for batch in batches:
            for part in windows(batch, "text"):
                kind = np.array([number[c] for c in part.column("label").to_pylist()])
                for own, count in buckets(part.column("text").to_pylist()):
                    table += np.bincount(np.repeat(kind, count) * BUCKETS + own, minlength=table.size).reshape(table.shape)
        yield pa.RecordBatch.from_pydict({"counts": [table.astype("<f4").tobytes()]}, schema=pa.schema([("counts", pa.binary())]))

    parts = rows.repartition(_PARTS).mapInArrow(run, "counts binary").collect()  # so many matrices
    table = sum(np.frombuffer(r["counts"], "<f4").reshape(len(languages), BUCKETS).astype(float) for r in parts)
    smooth = table + SMOOTHING
    weights = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T
    priors = np.log(np.array([counts[c] for c in languages], dtype=float) / total)
    return Model(languages, np.ascontiguousarray(weights, dtype=np.float32), priors, evidence)


def predict(df: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all, unless given), lang_pred and score; columns of these two names are replaced.

    lang_pred is "und", with score 0, for null, empty and letterless texts, and
    for all if there is no model.  Whole texts count, in windows of bounded
    size; rows are independent, so repeated rows get equal predictions.
    """
    text_batches(df.sparkSession)
    kept = [c for c in (keep if keep is not None else df.columns) if c not in ("lang_pred", "score")]
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return df.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    source = df.select(*kept, F.when(lettered, F.col(text)).alias("__text"))
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for part in windows(batch, "__text"):
                posterior = own.score(part.column("__text").to_pylist())
                best = posterior.argmax(axis=1)
                none = part.column("__text").is_null().to_numpy(zero_copy_only=False)
                score = np.where(none, 0.0, posterior.max(axis=1))
                names_of = names[np.where(none, len(own.languages), best)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(names_of, pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 2 when divided by 4; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2

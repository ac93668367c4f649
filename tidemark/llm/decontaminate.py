"""Benchmark decontamination with an FM-index of each shard of the training text.

A shard is a stretch of a partition's documents.  Its words become numbers of
the benchmark's vocabulary; words that no benchmark item has cannot be part of a
match, so only stretches of known words enter the index, each ended by a
separator.  The index is the Burrows-Wheeler transform of these numbers in a
wavelet matrix, with suffix positions sampled.  All windows of the benchmark are
searched backwards at once, a wavelet rank for each word; occurrences are located
by walking to the next sampled suffix, and their spans are merged.

The benchmark's vocabulary is broadcast, and its windows in blocks of bounded
size.  Documents pass once, without a shuffle: a shard is indexed once and the
blocks are searched in it one after the other, each held only for its turn.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._bytes import LOWER, hash_runs, ragged, text_batches, utf8, windows, words

#: Words in a window.
WINDOW = 10
#: Bytes of benchmark text in a block that is broadcast, and of training text in a shard.
BLOCK_BYTES, SHARD_BYTES = 16 << 20, 8 << 20
#: Every so many suffix positions are kept.
SAMPLED = 8
#: Words are letters a-z after lower-casing, digits, and every character beyond ASCII.
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector for each bit of the alphabet."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        own = sequence.astype(np.int32)
        for level in range(self.bits - 1, -1, -1):
            bit = (own >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)].astype(np.int32))
            self.zeros.append(len(own) - int(self.ones[-1][-1]))
            own = np.r_[own[bit == 0], own[bit == 1]]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            set_ = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(set_, zeros + a, low - a), np.where(set_, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            out = out << 1 | bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling prefixes; zeros are separators, each different and smaller than all other symbols, in the order of place."""
    n = len(text)
    separators = text == 0
    rank = np.where(separators, np.cumsum(separators), text + int(separators.sum())).astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[:-step] = rank[step:] if step < n else 0
        key = rank * (int(rank.max()) + 1 if n else 1) + np.where(separators, 0, second)
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.r_[1, np.diff(key[order]) != 0])
        if n == 0 or int(new.max()) == n:
            return order
        rank, step = new, step * 2


class FMIndex:
    """Backward search and locate over a text of numbers with separators (0); the last symbol is a separator."""

    def __init__(self, text: np.ndarray, symbols: int, sampled: int = SAMPLED):
        suffixes = suffix_array(text)
        self.n = len(text)
        bwt = text[suffixes - 1]
        self.matrix = WaveletMatrix(bwt, symbols)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))].astype(np.int64)
        # a walk ends at every sampled position, and at those after a separator
        kept = (suffixes % sampled == 0) | (bwt == 0)
        self.kept = np.r_[0, np.cumsum(kept)]
        self.places = suffixes[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern, a row each, filled up with zeros."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        alive = np.arange(len(patterns))
        for back in range(1, patterns.shape[1] + 1 if len(patterns) else 1):
            alive = alive[low[alive] < high[alive]]
            mine = alive[lengths[alive] >= back]
            if not len(mine):
                break
            symbol = patterns[mine, lengths[mine] - back]
            low[mine] = self.before[symbol] + self.matrix.rank(symbol, low[mine])
            high[mine] = self.before[symbol] + self.matrix.rank(symbol, high[mine])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position in the text of each suffix."""
        at, steps, out = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
        left = np.arange(len(rows))
        while len(left):
            here = at[left]
            done = self.kept[here + 1] > self.kept[here]
            out[left[done]] = self.places[self.kept[here[done]]] + steps[left[done]]
            left, here = left[~done], here[~done]
            symbol = self.matrix.access(here)
            at[left] = self.before[symbol] + self.matrix.rank(symbol, here)
            steps[left] += 1
        return out


@dataclass
class Windows:
    """The different windows of a block of items, as rows of numbers of a vocabulary from 1, and the items of each."""

    patterns: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all rows, and the words before each row (one entry more)."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, before = words(data, offsets, _WORD)
    return hash_runs(data, starts, ends), before


def item_windows(ids: list[str], texts: pa.Array, vocabulary: np.ndarray, window: int = WINDOW) -> Windows:
    """The windows of items whose words all are in the vocabulary (hashes in order)."""
    hashes, before = word_hashes(texts)
    numbers = np.searchsorted(vocabulary, hashes) + 1
    found: dict[bytes, set[str]] = {}
    for k, item in enumerate(ids):
        own = numbers[before[k] : before[k + 1]].astype(np.int64)
        for i in range(max(1, len(own) - window + 1) if len(own) else 0):
            found.setdefault(own[i : i + window].tobytes(), set()).add(item)
    patterns = np.zeros((len(found), window), dtype=np.int64)
    lengths = np.zeros(len(found), dtype=np.int64)
    for k, raw in enumerate(found):
        row = np.frombuffer(raw, dtype=np.int64)
        patterns[k, : len(row)], lengths[k] = row, len(row)
    return Windows(patterns, lengths, [sorted(x) for x in found.values()])


class Shard:
    """Rows of text and the FM-index of their stretches of known words."""

    def __init__(self, texts: pa.Array, vocabulary: np.ndarray, shortest: int = 1):
        """shortest: words of the shortest window; stretches of fewer cannot hold one."""
        hashes, self.before = word_hashes(texts)
        self.n_words, self.words = np.diff(self.before), len(hashes)
        self.index = None
        if not len(vocabulary) or not len(hashes):
            return
        at = np.searchsorted(vocabulary, hashes)
        at[at == len(vocabulary)] = 0
        known = vocabulary[at] == hashes
        begin, end = known.copy(), known.copy()
        begin[1:] &= ~known[:-1]
        end[:-1] &= ~known[1:]
        edges = self.before[1:-1]
        edges = edges[(edges > 0) & (edges < len(known))]
        begin[edges], end[edges - 1] = known[edges], known[edges - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        long = ends - starts >= shortest
        starts, size = starts[long], (ends - starts)[long]
        if not len(starts):
            return
        place = ragged(starts, size)  # the word of each symbol, separators left out
        stops = np.cumsum(size + 1)
        text = np.zeros(int(stops[-1]), dtype=np.int64)
        slots = ragged(stops - size - 1, size)
        text[slots] = at[place] + 1
        self.word_of = np.zeros(len(text), dtype=np.int64)
        self.word_of[slots] = place
        self.index = FMIndex(text, len(vocabulary) + 1)

    def search(self, blocks: Iterable[Windows]) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
        """For each row the merged spans of words hit by a window of any block, and the items that occur."""
        rows = len(self.n_words)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
        items: list[set[str]] = [set() for _ in range(rows)]
        change, hit_rows = None, set()
        for block in blocks if self.index is not None else ():
            if not len(block.patterns):
                continue
            low, high = self.index.search(block.patterns, block.lengths)
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            times = high[hit] - low[hit]
            first = self.word_of[self.index.locate(ragged(low[hit], times))]
            which = np.repeat(hit, times)
            row = np.searchsorted(self.before, first, side="right") - 1
            if change is None:
                change = np.zeros(self.words + 1, dtype=np.int64)
            np.add.at(change, first, 1)
            np.add.at(change, first + block.lengths[which], -1)
            hit_rows.update(np.unique(row).tolist())
            for k, p in set(zip(row.tolist(), which.tolist(), strict=True)):
                items[k].update(block.items[p])
        if change is not None:
            covered = np.cumsum(change[:-1]) > 0
            for k in hit_rows:
                edge = np.flatnonzero(np.diff(np.r_[0, covered[self.before[k] : self.before[k + 1]].astype(np.int8), 0]))
                spans[k] = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        return spans, [sorted(x) for x in items]


def _released(shared: list) -> Iterator[Windows]:
    """The values of broadcasts one after the other; a worker lets each go before it loads the next."""
    for one in shared:
        yield one.value
        if len(shared) > 1:
            vars(one).pop("_value", None)


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns `keep` (all, unless given), n_words, spans (of hit words, from 0, end exclusive) and items (ids as text, sorted).

    A word is hit inside any occurrence of `window` consecutive words of an
    item, or of a whole shorter item.  Null and empty texts have no words, items
    without words no windows; a null item id is the empty text; repeated items
    and rows are as good as single ones.  Texts of any length are searched whole;
    an empty table gives an empty one, an empty benchmark hits nothing.  Input
    columns named like the new ones are replaced.  The driver holds the benchmark
    while it plans; tasks hold its vocabulary and one block of windows.
    """
    text_batches(df.sparkSession)
    new = ("n_words", "spans", "items")
    kept = [c for c in (keep if keep is not None else df.columns) if c not in new]
    given = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text")).where("text is not null")
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    vocabulary, parts = np.zeros(0, dtype=np.uint64), []
    for b in range(n):
        chosen = given if n == 1 else given.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
        rows = chosen.toArrow()  # a block's items
        parts.append((rows.column("id").to_pylist(), pa.array(rows.column("text").to_pylist(), pa.string())))
        vocabulary = np.union1d(vocabulary, word_hashes(parts[-1][1])[0])
    context = df.sparkSession.sparkContext
    known, shared, shortest = context.broadcast(vocabulary), [], window
    while parts:
        block = item_windows(*parts.pop(), vocabulary, window)
        shortest = min(shortest, int(block.lengths.min(initial=window)))
        shared.append(context.broadcast(block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in windows(batch, "__text", SHARD_BYTES):
                shard = Shard(part.column("__text"), known.value, shortest)
                spans, items = shard.search(_released(shared))
                got = pa.array([[{"start": a, "end": e} for a, e in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(shard.n_words.astype(np.int64)), got, pa.array(items, pa.list_(pa.string()))], names=[*kept, *new])

    source = df.select(*kept, F.col(text).alias("__text"))
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    return source.mapInArrow(run, schema)


def n_hit(spans: str = "spans") -> Column:
    """Hit words of a row."""
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))

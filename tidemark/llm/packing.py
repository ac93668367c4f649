"""Packing of tokenized documents into sequences of fixed capacity: the cutting-stock problem by column generation.

A document of n ids fills n // capacity sequences by itself; its rest, one of
capacity - 1 lengths, shares one.  The histogram of rests is the demand of a
cutting-stock problem.  Lengths are first merged into CLASSES sizes, each rounded
up to the largest of its class, so that rounding wastes least.  The linear
program over patterns (how many rests of each size make a sequence) is solved by
column generation: a knapsack dynamic program over capacity finds patterns with
the best price under the current duals.  Patterns are rounded down, then up where
demand allows, and what demand is left makes patterns by first fit.  The
documents of a size, ranked by length and then by place, fill their slots in
order; since the histogram tells the length at each rank, a pattern falls apart
into some patterns of exact lengths, whose gaps are known.

The most wasteful sequences are then taken apart until their documents, laid end
to end and cut where a gap ends, fill the gaps of all others; so only one
sequence of all is not full, and few documents are cut.

The driver holds the histogram and the patterns: at most capacity - 1 lengths
and some times as many patterns, whatever the corpus.  Ranks come from counters
inside tasks plus a running sum over tasks, so a length that a third of all
documents share is no hot key.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._bytes import text_batches, windows
from tidemark.llm.tokenize import encoder
from tidemark.session import written

#: The linear program stops when its value is within this part of a lower bound; what it leaves open costs cuts, not padding.
GAP = 0.002
#: Sizes that the linear program tells apart, and patterns that one dynamic program yields at most.
CLASSES, COLUMNS = 128, 12
#: Documents whose pieces a task makes at once.
STEP = 1000
#: Rows of the table of rank offsets that may be broadcast (24 bytes each); a shuffled join serves beyond.
BROADCAST_ROWS = 2_000_000


class Knapsack:
    """Best values of items of some sizes, each as often as wanted, within every capacity up to one."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.names = np.flatnonzero(values > 1e-12)
        self.names = self.names[np.argsort(sizes[self.names], kind="stable")]
        v, s = values[self.names], sizes[self.names]
        self.best, self.choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        reach = np.searchsorted(s, np.arange(capacity + 1), side="right").tolist()
        for w in range(1, capacity + 1):
            value, pick = self.best[w - 1], -1
            if k := reach[w]:
                total = self.best[w - s[:k]] + v[:k]
                top = int(total.argmax())
                if total[top] > value + 1e-12:
                    value, pick = total[top], top
            self.best[w], self.choice[w] = value, pick

    def pattern(self, first: int | None = None) -> np.ndarray:
        """How often each item is taken, `first` once at least."""
        taken, w = np.zeros(len(self.sizes)), self.capacity
        if first is not None:
            taken[first] += 1
            w -= int(self.sizes[first])
        while w > 0:
            if self.choice[w] < 0:
                w -= 1
            else:
                item = self.names[self.choice[w]]
                taken[item] += 1
                w -= int(self.sizes[item])
        return taken


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best total value of items of the sizes (each as often as wanted) within the capacity, and how often each is taken."""
    own = Knapsack(values, sizes, capacity)
    return float(own.best[capacity]), own.pattern()


def _first_fit(left: np.ndarray, sizes: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns that take all of a demand: each the largest sizes that fit, as often as it can be used."""
    out, left = [], left.copy()
    while left.any():
        own, room = np.zeros_like(left), capacity
        for k in np.flatnonzero(left)[::-1]:
            own[k] = min(left[k], room // sizes[k])
            room -= own[k] * sizes[k]
        n = int((left[own > 0] // own[own > 0]).min())
        out.append((own, n))
        left = left - own * n
    return out


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a column) and how often each is used: a basis of the linear program, of a value within the gap of the best or after so many dynamic programs for each size.

    All patterns found are kept, and the program over them is solved anew by
    simplex steps before the next dynamic program.  That prices by a mean of the
    current duals and those of the best bound so far, which jump about less.
    """
    m = len(sizes)
    fits = capacity // sizes
    pool = np.concatenate([np.diag(fits).astype(float), *(own[:, None] for own, _ in _first_fit(demand.astype(np.int64), sizes, capacity))], axis=1)
    basis = np.arange(m)
    shifted = demand + 1e-3 * np.arange(1, m + 1) / m  # no two sizes run out at once, so simplex steps do not go in circles
    bound, steady = max(float(demand @ sizes) / capacity, 1e-9), sizes / capacity  # no packing has fewer sequences than its ids fill
    for _ in range(rounds * m + 50):
        inverse = np.linalg.inv(pool[:, basis])
        used = np.maximum(np.einsum("ij,j->i", inverse, shifted), 0)
        for _ in range(20 * m):
            duals = inverse.sum(axis=0)
            prices = np.einsum("k,kp->p", duals, pool)  # not by threads, which cost more than so small a product
            enter = int(prices.argmax())
            if prices[enter] <= 1 + 1e-9:
                break
            step = np.einsum("ij,j->i", inverse, pool[:, enter])
            ratio = np.full(m, np.inf)
            up = step > 1e-9
            ratio[up] = used[up] / step[up]
            leave = int(ratio.argmin())
            used = np.maximum(used - ratio[leave] * step, 0)
            used[leave] = ratio[leave]
            pivot = inverse[leave] / step[leave]
            inverse -= np.outer(step, pivot)
            inverse[leave] = pivot
            basis[leave] = enter
        duals = np.maximum(inverse.sum(axis=0), 0)
        if used.sum() <= bound * (1 + gap):
            break
        new: list[np.ndarray] = []
        for trial in ((duals + steady) / 2, duals):
            own = Knapsack(trial, sizes, capacity)
            value = float(trial @ demand) / max(own.best[capacity], 1)  # Farley's
            if value > bound:
                bound, steady = value, trial / max(own.best[capacity], 1)
            # the best pattern of all, and the best ones with an item of each of the best sizes
            with_one = trial + own.best[capacity - sizes]
            found = [own.pattern(), *(own.pattern(int(k)) for k in np.argsort(-with_one, kind="stable")[:COLUMNS])]
            new = [c for c in found if duals @ c > 1 + 1e-9]
            if new:
                break
        if not new or used.sum() <= bound * (1 + gap):
            break
        pool = np.concatenate([pool, *(c[:, None] for c in new)], axis=1)
    return pool[:, basis].astype(np.int64), np.maximum(np.linalg.solve(pool[:, basis], demand), 0)


def merge_lengths(lengths: np.ndarray, counts: np.ndarray, most: int = CLASSES) -> list[tuple[int, int]]:
    """At most so many stretches (first, end) of the lengths, ascending; neighbours are merged where rounding the lower one up wastes least."""
    after = list(range(1, len(lengths) + 1))
    before = list(range(-1, len(lengths) - 1))
    top, weight, alive = lengths.tolist(), counts.tolist(), len(lengths)
    gone = [False] * alive
    cost = lambda k: weight[k] * (top[after[k]] - top[k])
    heap = [(cost(k), k) for k in range(alive - 1)]
    heapify(heap)
    while alive > most:
        price, k = heappop(heap)
        if gone[k] or after[k] >= len(top) or price != cost(k):
            continue
        other = after[k]  # k goes into the stretch above it
        weight[other] += weight[k]
        gone[k] = True
        before[other] = before[k]
        if before[k] >= 0:
            after[before[k]] = other
            heappush(heap, (cost(before[k]), before[k]))
        if after[other] < len(top):
            heappush(heap, (cost(other), other))
        alive -= 1
    ends = [k + 1 for k in range(len(top)) if not gone[k]]
    return list(zip([0, *ends[:-1]], ends, strict=True))


@dataclass
class Layout:
    """Where the rest of each rank within its length goes.

    slots[length]: (first rank, ranks, first sequence, offset), one rank a sequence, ascending.
    loose[length]: (first rank, first position in the stream of loose ids); they are a length's last ranks.
    gaps: (first position in the stream, width, gaps, first sequence, offset), ascending.
    """

    capacity: int
    sequences: int = 0
    slots: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    loose: dict[int, tuple[int, int]] = field(default_factory=dict)
    gaps: list[tuple[int, int, int, int, int]] = field(default_factory=list)

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start within the rest, length, sequence, offset) of each piece of a rest."""
        first, begin = self.loose.get(length, (None, 0))
        if first is None or rank < first:
            own = self.slots[length]
            first, _, sequence, offset = own[bisect_right(own, rank, key=itemgetter(0)) - 1]
            return [(0, length, sequence + rank - first, offset)]
        at, out, done = begin + (rank - first) * length, [], 0
        k = bisect_right(self.gaps, at, key=itemgetter(0)) - 1
        while done < length:
            start, width, n, sequence, offset = self.gaps[k]
            turn, place = divmod(at + done - start, width)
            if turn >= n:
                k += 1
                continue
            take = min(length - done, width - place)
            out.append((done, take, sequence + turn, offset + place))
            done += take
        return out

    def share_in_slots(self, histogram: dict[int, int]) -> float:
        """The part of all rests that lie whole in a slot of a pattern."""
        total = sum(n for k, n in histogram.items() if k)
        return 1 - sum(histogram[k] - first for k, (first, _) in self.loose.items()) / total if total else 1.0


def _rounded(patterns: np.ndarray, used: np.ndarray, sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that take all demand: used ones rounded down, then up where demand allows, then first fit."""
    times = np.floor(used + 1e-9).astype(np.int64)
    left = left - patterns @ times
    while (left < 0).any():  # floating-point error only
        k = int(np.flatnonzero(left < 0)[0])
        p = int(np.flatnonzero((patterns[k] > 0) & (times > 0))[0])
        times[p] -= 1
        left += patterns[:, p]
    for p in np.argsort(-(used - np.floor(used)), kind="stable"):
        while patterns[:, p].any() and (patterns[:, p] <= left).all() and patterns[:, p] @ sizes >= capacity * 0.98:
            times[p] += 1
            left = left - patterns[:, p]
    return [*((patterns[:, p], int(times[p])) for p in np.flatnonzero(times)), *_first_fit(left, sizes, capacity)]


def plan_layout(histogram: dict[int, int], capacity: int, gap: float = GAP, classes: int = CLASSES) -> Layout:
    """The layout of so many rests of each length (1 to capacity - 1)."""
    layout = Layout(capacity)
    lengths = np.array(sorted(k for k, n in histogram.items() if n and k), dtype=np.int64)
    if not len(lengths):
        return layout
    counts = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    stretches = merge_lengths(lengths, counts, classes)
    sizes = np.array([lengths[b - 1] for _, b in stretches])
    demand = np.array([counts[a:b].sum() for a, b in stretches])
    whole = _rounded(*column_generation(sizes, demand.astype(float), capacity, gap), sizes, demand, capacity)
    # sequences that are taken apart, those of the emptiest patterns first, are as many as all gaps would fill
    waste = sum(n for _, n in whole) * capacity - int(counts @ lengths)
    spare = -(-waste // capacity)
    kept = []
    for own, n in sorted(whole, key=lambda x: (int(x[0] @ sizes), x[0].tolist())):
        apart = min(n, spare)
        spare -= apart
        if n > apart:
            kept.append((own, n - apart))
    # each slot of a pattern takes the next documents of its size, shortest first
    steps = [np.cumsum(np.r_[0, counts[a:b]]) for a, b in stretches]
    taken, wide = np.zeros(len(sizes), dtype=np.int64), []
    for own, n in kept:
        slots = []
        for k in np.flatnonzero(own)[::-1]:
            for _ in range(int(own[k])):
                slots.append((int(k), int(taken[k])))
                taken[k] += n
        turn = 0
        while turn < n:  # as long as no slot's length changes it is a pattern of exact lengths
            run, offset = n - turn, 0
            at = [int(np.searchsorted(steps[k], first + turn, side="right")) - 1 for k, first in slots]
            run = min(run, *(int(steps[k][i + 1]) - first - turn for (k, first), i in zip(slots, at, strict=True)))
            for (k, first), i in zip(slots, at, strict=True):
                length = int(lengths[stretches[k][0] + i])
                layout.slots.setdefault(length, []).append((first + turn - int(steps[k][i]), run, layout.sequences, offset))
                offset += length
            if offset < capacity:
                wide.append((capacity - offset, run, layout.sequences, offset))
            layout.sequences += run
            turn += run
    for own in layout.slots.values():
        own.sort()
    stream = 0
    for k in range(len(sizes) - 1, -1, -1):
        for i in range(len(steps[k]) - 2, -1, -1):
            first = max(0, int(taken[k] - steps[k][i]))
            count, length = int(steps[k][i + 1] - steps[k][i]), int(lengths[stretches[k][0] + i])
            if first < count:
                layout.loose[length] = (first, stream)
                stream += (count - first) * length
    at = 0
    for width, n, sequence, offset in sorted(wide, reverse=True):
        if at < stream:
            layout.gaps.append((at, width, n, sequence, offset))
            at += width * n
    if at < stream:
        fresh = -(-(stream - at) // capacity)
        layout.gaps.append((at, capacity, fresh, layout.sequences, 0))
        layout.sequences += fresh
    return layout


def tokenized(df: DataFrame, path: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table of the ids of each row (4 bytes each, little-endian, end id last), its task, and its ranks within the task."""
    text_batches(df.sparkSession)
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {source.schema['key'].dataType.simpleString()}, task int, n long, rest int, rank long, full long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = encoder(path), TaskContext.get().partitionId()
        seen, full = np.zeros(capacity, dtype=np.int64), 0
        for batch in batches:
            for part in windows(batch, "text"):
                flat, at = own.encode(part.column("text"))
                n = np.diff(at) + 1
                flat = np.insert(flat, at[1:], np.uint32(end_id)).astype("<u4")
                stops = np.cumsum(n)
                rest = n % capacity
                ranks, before = np.empty(len(n), dtype=np.int64), np.empty(len(n), dtype=np.int64)
                for k, r in enumerate(rest.tolist()):
                    ranks[k] = seen[r]
                    seen[r] += 1
                fulls = n // capacity
                before[:] = full + np.cumsum(fulls) - fulls
                full += int(fulls.sum())
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((np.r_[0, stops] * 4).astype(np.int64)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.full(len(n), task, dtype=np.int32)), pa.array(n), pa.array(rest.astype(np.int32)), pa.array(ranks), pa.array(before), ids.cast(pa.binary())], names=["key", "task", "n", "rest", "rank", "full", "ids"])

    return written(source.mapInArrow(run, schema), "ids")


def pack(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, doc_tokens, sequence_id, offset, ids (little-endian, 4 bytes each).

    Every id of every document, its end id included, lies in exactly one piece;
    pieces of a sequence have offsets without gaps from 0.  Null and empty texts
    are the end id alone.  Repeated rows and keys, and null keys, are packed as
    documents of their own.  An empty table gives no rows.
    """
    rows = tokenized(df, path, capacity, end_id, key, text)
    counts = rows.groupBy("task", "rest").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    layout = plan_layout(histogram, capacity)
    fulls = {r["task"]: r["full"] for r in rows.groupBy("task").agg(F.sum((F.col("n") / capacity).cast("long")).alias("full")).collect()}  # a row a task
    base, at = {}, layout.sequences
    for task in sorted(fulls):
        base[task] = at
        at += fulls[task]
    running = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "rest", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("ranked"))
    if len(fulls) * capacity <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    ranked = rows.join(offsets, ["task", "rest"], "left").select("key", "task", "n", "rest", (F.col("rank") + F.coalesce("ranked", F.lit(0))).alias("rank"), "full", "ids")
    kind = rows.schema["key"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast((layout, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, first = shared.value
        for batch in (whole.slice(k, STEP) for whole in batches for k in range(0, whole.num_rows, STEP)):
            columns = {c: batch.column(c).to_pylist() for c in ("task", "n", "rest", "rank", "full")}
            row, start, length, sequence, offset, ids = [], [], [], [], [], []
            for k, (task, n, rest, rank, full, raw) in enumerate(zip(*columns.values(), batch.column("ids"), strict=True)):
                data, whole = raw.as_buffer(), n // capacity
                places = [(j * capacity, capacity, first[task] + full + j, 0) for j in range(whole)]
                if rest:
                    places += [(whole * capacity + a, b, c, d) for a, b, c, d in plan.pieces(rest, rank)]
                for a, b, c, d in places:
                    row.append(k)
                    start.append(a)
                    length.append(b)
                    sequence.append(c)
                    offset.append(d)
                    ids.append(data.slice(4 * a, 4 * b).to_pybytes())
            take = pa.array(row, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(take), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(zlib_all(ids), pa.int64()), batch.column("n").take(take), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(ids, pa.binary())], names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return ranked.mapInArrow(run, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def zlib_all(chunks: list[bytes]) -> list[int]:
    """The unsigned crc32 of each chunk."""
    return [zlib.crc32(x) for x in chunks]

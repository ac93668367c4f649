"""Vectorised byte kernels shared by the text operators.

Text arrives in Arrow batches; these helpers look at the UTF-8 bytes of many
documents at once, so the cost of a word is some numpy passes and not a Python
object.  Word hashes are 64-bit, the same in every process and on every host.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text handled at once: the passes below hold about fifty bytes for each.
WINDOW_BYTES = 2 << 20

#: Rows of a batch between Spark and Python, where the session has Spark's default of ten times as many: texts are long.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Let a session hand texts over in smaller batches, unless it has a size of its own."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ROOT = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: A fixed 64-bit value for each byte.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ROOT))
_POWERS = np.array([1], dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << max(8, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _ROOT, dtype=np.uint64)])
    return _POWERS


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run data[start:end] of one byte or more, whatever lies around it."""
    out = np.empty(len(starts), dtype=np.uint64)
    lengths = ends - starts
    stops = np.cumsum(lengths)
    at = 0
    while at < len(starts):
        base = stops[at] - lengths[at]
        to = max(at + 1, int(np.searchsorted(stops, base + WINDOW_BYTES, side="right")))
        n = lengths[at:to]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        place = within + np.repeat(starts[at:to], n)
        terms = _BYTE[data[place]] * _powers(int(n.max()))[within]
        out[at:to] = mix(np.add.reduceat(terms, first) + n.astype(np.uint64))
        at = to
    return out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row starts (one entry more); null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def windows(batch: pa.RecordBatch, column: str, most: int = WINDOW_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `most` bytes of a text column, one row at least."""
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of a class, never across rows, and the number of runs before each row.

    member: a boolean for each of the 256 bytes.
    """
    inside = member[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


#: ASCII lower case, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)

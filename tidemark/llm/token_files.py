"""Token ids in binary shards: documents compressed one by one with a shared zstandard dictionary.

A shard file is, in this order and little-endian:

    magic "TDMKIDS1", SHA-256 of the dictionary (32 bytes; zeros without one),
    the frames, one a document, of its ids as unsigned 32-bit integers,
    the index: for each document its key (int64), whether it is null (uint8),
    the place of its frame (uint64) and its ids (uint64), column by column,
    documents (uint64), place of the index (uint64).

The dictionary, trained on the serialized ids of a bounded sample of documents,
lies beside the shards.  Any document is read by its index row and one frame.
Shards are ranges of the key, so they are written by independent tasks; the
manifest, a row per shard, gives where each shard's ids start in the whole.
A task that is run again writes the same file under its own name and moves it
into place, so lost executors leave no half shards.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._bytes import text_batches, windows
from tidemark.llm.tokenize import encoder
from tidemark.session import new_folder

MAGIC = b"TDMKIDS1"
#: Documents (drawn by hash) and ids of each that train the dictionary, and its size.
SAMPLE_DOCUMENTS, SAMPLE_IDS, DICTIONARY_BYTES = 2000, 2048, 64 << 10
#: Bytes of frames that a reader holds at once.
READ_BYTES = 4 << 20
_LEVEL = 3


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of the samples; their own bytes where there are too few to train one, empty where there are none."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> object | None:
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


class Shard:
    """Random access to one shard file."""

    def __init__(self, path: str, dictionary: bytes):
        import zstandard

        fs, at = _file_system(path)
        self.file = fs.open_input_file(at)
        head = self.file.read_at(40, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is no shard of token ids")
        if head[8:40] != dictionary_hash(dictionary):
            raise ValueError(f"{path} was written with another dictionary")
        size = self.file.size()
        self.n, index = struct.unpack("<QQ", self.file.read_at(16, size - 16))
        raw, n = self.file.read_at(size - 16 - index, index), self.n
        self.keys = np.frombuffer(raw, "<i8", n)
        self.null = np.frombuffer(raw, "u1", n, 8 * n).astype(bool)
        self.places = np.r_[np.frombuffer(raw, "<u8", n, 9 * n), np.uint64(index)].astype(np.int64)
        self.counts = np.frombuffer(raw, "<u8", n, 17 * n).astype(np.int64)
        self.zstd = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def document(self, k: int) -> np.ndarray:
        """The ids of document k of the shard; only its frame is read."""
        a, b = int(self.places[k]), int(self.places[k + 1])
        return np.frombuffer(self.zstd.decompress(self.file.read_at(b - a, a), max_output_size=int(self.counts[k]) * 4), "<u4")

    def documents(self) -> Iterator[tuple[int, bytes]]:
        """Every document's position and ids in bytes, a block of frames at a time."""
        k = 0
        while k < self.n:
            to = max(k + 1, int(np.searchsorted(self.places, self.places[k] + READ_BYTES)) - 1)
            block, base = self.file.read_at(int(self.places[to] - self.places[k]), int(self.places[k])), int(self.places[k])
            for i in range(k, to):
                yield i, self.zstd.decompress(block[int(self.places[i]) - base : int(self.places[i + 1]) - base], max_output_size=int(self.counts[i]) * 4)
            k = to


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest() if dictionary else bytes(32)


@dataclass
class TokenFiles:
    """A written corpus: its folder, dictionary and manifest, one (shard, documents, ids, ids of the shards before) a shard."""

    folder: str
    dictionary: bytes
    manifest: list[tuple[int, int, int, int]]

    def path(self, shard: int) -> str:
        return f"{self.folder}/shard-{shard:06d}.ids"

    def open(self, shard: int) -> Shard:
        return Shard(self.path(shard), self.dictionary)


def sample_of(source: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """About so many different rows of (key, text), twice as many at most, by a threshold of their hash: no task gets more than these.

    Beginnings of texts suffice, since only so many ids of each are used.
    """
    n = source.count()
    rows = source.select("key", F.substring("text", 1, 8 * SAMPLE_IDS).alias("text"), F.xxhash64("key", "text").alias("hash"))
    if n > documents:
        rows = rows.where(F.pmod("hash", F.lit(1 << 40)) < int(documents / n * (1 << 40)))
    # rows that are repeated have one hash, so all of them or none are drawn; they are one before they are counted
    return rows.dropDuplicates(["hash"]).limit(2 * documents).orderBy("hash").select("key", "text")


def write(df: DataFrame, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text", folder: str | None = None) -> TokenFiles:
    """Encode all texts and write them in ascending order of an integer key, nulls first.

    Null and empty texts are the end id alone.  Rows with equal keys stand
    together, ordered by a hash of their text.  An empty table gives no shards.
    The driver holds the manifest, a row per shard, and the dictionary.
    """
    text_batches(df.sparkSession)
    spark = df.sparkSession
    folder = folder or new_folder(spark, "token-files")
    source = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    sample = sample_of(source).toArrow()
    flat, at = encoder(path).encode(sample.column("text").combine_chunks()) if sample.num_rows else (np.zeros(0), [0])
    dictionary = train([np.append(flat[a : min(b, a + SAMPLE_IDS)], end_id).astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])
    fs, root = _file_system(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary") as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own, shard = encoder(path), TaskContext.get().partitionId()
        given = _dictionary(shared.value)
        zstd = zstandard.ZstdCompressor(level=_LEVEL, dict_data=given) if given else zstandard.ZstdCompressor(level=_LEVEL)
        files, into = _file_system(folder)
        name, temporary = f"{into}/shard-{shard:06d}.ids", f"{into}/.{uuid.uuid4().hex}"
        keys, null, places, counts, out, place = [], [], [], [], None, 40
        for batch in batches:
            for part in windows(batch, "text"):
                if out is None:
                    out = files.open_output_stream(temporary)
                    out.write(MAGIC + dictionary_hash(shared.value))
                flat, at = own.encode(part.column("text"))
                flat = np.insert(flat, at[1:], np.uint32(end_id)).astype("<u4")
                stops = at + np.arange(len(at))
                frames = [zstd.compress(flat[a:b].tobytes()) for a, b in zip(stops[:-1], stops[1:], strict=True)]
                sizes = np.fromiter(map(len, frames), dtype=np.int64, count=len(frames))
                out.write(b"".join(frames))
                keys.append(part.column("key").fill_null(0).to_numpy(zero_copy_only=False))
                null.append(part.column("key").is_null().to_numpy(zero_copy_only=False))
                places.append(place + np.cumsum(sizes) - sizes)
                counts.append(np.diff(stops))
                place += int(sizes.sum())
        if out is None:
            return
        n = sum(map(len, keys))
        for column, kind in ((keys, "<i8"), (null, "u1"), (places, "<u8"), (counts, "<u8")):
            out.write(np.concatenate(column).astype(kind).tobytes())
        out.write(struct.pack("<QQ", n, place))
        out.close()
        files.move(temporary, name)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "documents": [n], "ids": [int(sum(c.sum() for c in counts))]}, schema=pa.schema([("shard", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64())]))

    # the order within equal keys is by a hash, which also spreads a key that very many rows share
    placed = source.withColumn("tie", F.xxhash64("text")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    rows = sorted(tuple(r) for r in placed.mapInArrow(run, "shard int, documents long, ids long").collect())  # a row a shard
    manifest, start = [], 0
    for shard, documents, ids in rows:
        manifest.append((shard, documents, ids, start))
        start += ids
    with fs.open_output_stream(f"{root}/manifest") as out:
        out.write("".join(f"{a}\t{b}\t{c}\t{d}\n" for a, b, c, d in manifest).encode())
    return TokenFiles(folder, dictionary, manifest)


def open_files(folder: str) -> TokenFiles:
    """A corpus that was written before."""
    fs, root = _file_system(folder)
    with fs.open_input_stream(f"{root}/dictionary") as f:
        dictionary = f.read()
    with fs.open_input_stream(f"{root}/manifest") as f:
        manifest = [tuple(map(int, line.split("\t"))) for line in f.read().decode().splitlines()]
    return TokenFiles(folder, dictionary, manifest)


def read(spark: SparkSession, files: TokenFiles, ids: bool = True) -> DataFrame:
    """A row per document from the shards: key, start (ids of all documents before), n_tokens, ids_crc32 and, if wanted, ids in bytes.

    Repeated and null keys have a row for each document that was written; a corpus
    without shards has none.  A long document is one frame and is held whole.
    """
    schema = "key long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    if not files.manifest:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame([(s, b) for s, _, _, b in files.manifest], "shard int, base long").repartition(len(files.manifest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                own = files.open(shard)
                start = base + np.cumsum(own.counts) - own.counts
                first, crc, raw, size = 0, [], [], 0
                for k, data in own.documents():
                    crc.append(zlib.crc32(data))
                    if ids:
                        raw.append(data)
                        size += len(data)
                    if k + 1 == own.n or len(crc) >= 4096 or size >= READ_BYTES:
                        span = slice(first, k + 1)
                        columns = [pa.array(own.keys[span], mask=own.null[span]), pa.array(start[span]), pa.array(own.counts[span]), pa.array(crc, pa.int64())]
                        yield pa.RecordBatch.from_arrays([*columns, *([pa.array(raw, pa.binary())] if ids else [])], names=["key", "start", "n_tokens", "ids_crc32", *["ids"] * ids])
                        first, crc, raw, size = k + 1, [], [], 0

    return shards.mapInArrow(run, schema)

"""WARC archives: a Spark data source with pushed header predicates, and a writer with revisit records.

Reading: files (.warc.gz and .warc) are listed and cut into partitions on the
driver, by the sidecar index of record offsets where a file has one; index() makes
them.  A reader holds a chunk of a file at a time and one decompressor a gzip
member.  Headers are parsed first.  Of records that fail a pushed predicate, and
of payloads that the schema does not ask for, nothing is decoded: with an index
the reader goes on to the next offset, without one the bytes of a member run
through the decompressor to find its end and are let go.

Writing: records with equal payloads of MIN_REVISIT bytes or more become one
response, that of the largest id, and revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith

from tidemark.llm._bytes import text_batches
from tidemark.session import new_folder, written

#: Payloads of fewer bytes are written each time.
MIN_REVISIT = 1000
#: Rows of the table of repeated payloads that may be broadcast (about 60 bytes each); a shuffled join serves beyond.
BROADCAST_ROWS = 500_000
#: Bytes of an archive that one partition reads, where an index allows.
SPLIT_BYTES = 128 << 20
#: Bytes that are inflated at once, and read from a file at once.
CHUNK, READ_AHEAD = 64 << 10, 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns of the source; payload_bytes is the length of the full payload, also of revisits.
SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, content_type string, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: The header of each column that is one.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


def identifier(key: object) -> str:
    """The record id of a key."""
    return f"<urn:record:{quote(str(key), safe='')}>"


def key_of(record_id: str | None) -> str | None:
    """The key of a record id that identifier() made, else the id itself."""
    if record_id is None or not record_id.startswith("<urn:record:"):
        return record_id
    return unquote(record_id[12:-1])


def record(kind: str, record_id: str, uri: str | None, digest: bytes, length: int, payload: bytes | None, refers_to: str | None = None, refers_uri: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One gzip member; a revisit has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {quote(uri, safe=_URI)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that Spark names, and the path in it; Hadoop's names of object stores are pyarrow's."""
    for own, known in (("s3a://", "s3://"), ("s3n://", "s3://"), ("gs://", "gs://")):
        if path.startswith(own):
            path = known + path[len(own) :]
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def archives(folder: str) -> list[tuple[str, int, str | None]]:
    """(path, bytes, path of the index or None) of each archive of a folder, or of the one file."""
    fs, root = file_system(folder)
    info = fs.get_file_info(root)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    names = {f.path for f in found}
    out = []
    for f in sorted(found, key=lambda f: f.path):
        if f.is_file and f.path.endswith((".warc.gz", ".warc")):
            index = f.path.removesuffix(".gz").removesuffix(".warc") + ".idx"
            out.append((f.path, f.size, index if index in names else None))
    return out


def ahead(f: object, end: int) -> object:
    """Read a file in chunks: what a reader asks for next mostly lies in the chunk that it has."""
    chunk, start = b"", 0

    def read(n: int, at: int) -> bytes:
        nonlocal chunk, start
        if not start <= at < start + len(chunk):
            chunk, start = f.read_at(min(READ_AHEAD, end - at), at), at
        return chunk[at - start : at - start + n]

    return read


_URI = "".join(map(chr, range(33, 127)))


@dataclass
class Part(InputPartition):
    """A stretch of an archive, and where its records start in the file if an index tells."""

    path: str
    start: int
    end: int
    offsets: list[int] | None


class Stream:
    """The bytes of records end to end, a chunk at a time: inflated from gzip members, or as they stand."""

    def __init__(self, read: object, start: int, end: int, packed: bool):
        """read(bytes, at): a piece of the file."""
        self.source, self.at, self.end, self.packed = read, start, end, packed
        self.raw = b""  # read, not yet inflated
        self.have = bytearray()  # inflated, not yet taken
        self.inflater = None

    def _more(self) -> bool:
        """Inflate a little more of the member (or read on); False at its end."""
        if not self.packed:
            piece = self._next_raw()
            self.have += piece
            return bool(piece)
        if self.inflater is None:
            self.raw = self.raw or self._next_raw()
            if not self.raw:
                return False
            self.inflater = zlib.decompressobj(31)
        while not self.inflater.eof:
            self.raw = self.raw or self._next_raw()
            if not self.raw:
                return False  # a file that ends inside a member
            piece = self.inflater.decompress(self.raw, CHUNK)
            self.raw = self.inflater.unconsumed_tail if not self.inflater.eof else self.inflater.unused_data
            if piece:
                self.have += piece
                return True
        return False

    def _next_raw(self) -> bytes:
        n = min(CHUNK, self.end - self.at)
        piece = self.source(n, self.at) if n > 0 else b""
        self.at += len(piece)
        return piece

    def until(self, mark: bytes) -> bytes | None:
        """What stands before a mark, which is taken too; None if the member ends before it."""
        looked = 0
        while (k := self.have.find(mark, looked)) < 0:
            looked = max(0, len(self.have) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.have[:k])
        del self.have[: k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.have) < n and self._more():
            pass
        out = bytes(self.have[:n])
        del self.have[:n]
        return out

    def skip(self, n: int) -> None:
        """Let so many bytes go, a chunk at a time."""
        while n > len(self.have):
            n -= len(self.have)
            self.have.clear()
            if not self.packed:  # bytes as they stand need not even be read
                jump = max(0, min(n, self.end - self.at))
                self.at += jump
                return
            if not self._more():
                return
        del self.have[:n]

    def close_member(self) -> bool:
        """Go to the next member; False at the end of the stretch."""
        self.have.clear()
        if self.packed:
            while self.inflater is not None and self._more():
                self.have.clear()
            self.have.clear()
            self.inflater = None
        return bool(self.raw) or self.at < self.end


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def _hexadecimal(digest: str | None) -> str | None:
    """A digest header as bare lower-case hexadecimal, if it is SHA-1 in base 32; else as it stands."""
    if digest is None or not digest.startswith("sha1:"):
        return digest
    value = digest[5:]
    return base64.b32decode(value).hex() if len(value) == 32 else value.lower()


def record_at(stream: Stream, wanted: list[str], tests: list[tuple[str, str, object]], verify: bool = False) -> tuple[tuple | None, int] | None:
    """The wanted columns of the record that begins here (None if a test on its headers fails) and the bytes of its block that are left; None at the end."""
    head = stream.until(b"\r\n\r\n")
    if head is None or not head.lstrip().startswith(b"WARC/"):
        return None
    fields = _fields(head.lstrip())
    values: dict[str, object] = {c: fields.get(h) for c, h in HEADERS.items()}
    values["payload_digest"] = _hexadecimal(values["payload_digest"])
    left = int(fields.get("content-length", "0"))
    for column, op, value in tests:
        own = values[column]
        if not (own == value if op == "=" else own in value if op == "in" else own is not None and own.startswith(value) if op == "starts" else (own is None) == value):
            return None, left
    if "payload_bytes" in wanted or "payload" in wanted or verify:
        length = None
        if (fields.get("content-type") or "").startswith("application/http"):
            inner = stream.until(b"\r\n\r\n") or b""
            left -= len(inner) + 4
            length = _fields(inner).get("content-length")
        revisit = values["record_type"] == "revisit"
        values["payload_bytes"] = int(length) if length is not None and revisit else left
        values["payload"] = None
        if ("payload" in wanted or verify) and not revisit:
            values["payload"] = body = stream.take(left)
            left = 0
            if verify and len(str(values["payload_digest"])) == 40 and hashlib.sha1(body).hexdigest() != values["payload_digest"]:
                raise ValueError(f"the payload of {values['record_id']} does not have its digest")
    return tuple(values[c] for c in wanted), left


def records(read: object, part: Part, wanted: list[str], tests: list[tuple[str, str, object]], verify: bool = False) -> Iterator[tuple]:
    """The records of a stretch that pass the tests."""
    packed = part.path.endswith(".gz")
    if part.offsets is not None:
        for a, b in zip(part.offsets, [*part.offsets[1:], part.end], strict=True):
            found = record_at(Stream(read, a, b, packed), wanted, tests, verify)
            if found is not None and found[0] is not None:
                yield found[0]
        return
    stream = Stream(read, part.start, part.end, packed)
    while True:
        found = record_at(stream, wanted, tests, verify)
        if found is not None and found[0] is not None:
            yield found[0]
        if packed:
            if not stream.close_member():
                return
        elif found is None:
            return
        else:
            stream.skip(found[1] + 4)


class WarcReader(DataSourceReader):
    """Plans files as partitions and reads records, headers first."""

    def __init__(self, schema: object, options: dict):
        self.wanted = list(schema.fieldNames())
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality, membership, prefixes and null tests on header columns; Spark keeps the others."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((column, "=", f.value))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", set(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif column in HEADERS and isinstance(f, (IsNull, IsNotNull)):
                self.tests.append((column, "null", isinstance(f, IsNull)))
            else:
                yield f

    def partitions(self) -> list[Part]:
        parts = []
        for path, size, index in archives(self.path):
            if index is None:
                parts.append(Part(path, 0, size, None))
                continue
            with file_system(self.path)[0].open_input_stream(index) as stream:
                offsets = [int(x) for x in stream.read().split()]
            at = 0
            while at < len(offsets):
                to = at + 1
                while to < len(offsets) and offsets[to] - offsets[at] < self.split:
                    to += 1
                parts.append(Part(path, offsets[at], offsets[to] if to < len(offsets) else size, offsets[at:to]))
                at = to
        return parts or [Part("", 0, 0, [])]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.path:
            return
        with file_system(self.path)[0].open_input_file(part.path) as f:
            yield from records(ahead(f, part.end), part, self.wanted, self.tests, self.verify)


class WarcSource(DataSource):
    """spark.read.format("warc").schema(columns of SCHEMA).load(folder); options splitBytes, verify."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WarcReader:
        return WarcReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let its filters be pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write(df: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", folder: str | None = None, min_revisit: int = MIN_REVISIT) -> str:
    """Write a record for every row and return the folder of the archives.

    The payload is the text in UTF-8; null is empty.  Of rows with equal
    payloads of min_revisit bytes or more, those with the largest key are
    responses and the others revisits of it; null keys are the smallest.  A
    row that is repeated is written as often.  An empty table gives an empty
    folder.
    """
    text_batches(df.sparkSession)
    spark = df.sparkSession
    folder = folder or new_folder(spark, "warc")
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), body.alias("payload"))
    long = F.octet_length("payload") >= min_revisit
    heads = written(rows.where(long).groupBy(F.sha1(F.col("payload").cast("binary")).alias("digest")).agg(F.max("key").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1 and head is not null").drop("n"), "payload-heads")
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads
    rows = rows.join(heads, (rows["digest"] == heads["digest"]) & long, "left").select("key", "uri", "payload", rows["digest"], F.when(~F.col("key").eqNullSafe(F.col("head")), F.col("head")).alias("refers"))
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, into = file_system(folder)
        part, out, at, offsets = TaskContext.get().partitionId(), None, 0, []
        temporary = f"{into}/.{uuid.uuid4().hex}"
        for batch in batches:
            for k, u, text, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    out = files.open_output_stream(temporary)
                raw = text.encode("utf-8", "surrogatepass")
                name = identifier("" if k is None else k)
                if refers is None:
                    data = record("response", name, u, bytes.fromhex(digest), len(raw), raw)
                else:
                    data = record("revisit", name, u, bytes.fromhex(digest), len(raw), None, identifier(refers))
                out.write(data)
                offsets.append(at)
                at += len(data)
        if out is None:
            return
        out.close()
        with files.open_output_stream(f"{into}/archive-{part:06d}.idx") as index:
            index.write("\n".join(map(str, offsets)).encode())
        files.move(temporary, f"{into}/archive-{part:06d}.warc.gz")
        yield pa.RecordBatch.from_pydict({"part": [part], "records": [len(offsets)]}, schema=pa.schema([("part", pa.int32()), ("records", pa.int64())]))

    rows.mapInArrow(run, "part int, records long").collect()  # a row an archive
    return folder


def index(spark: SparkSession, folder: str) -> int:
    """Write the index of record offsets of every archive in a folder that has none, a task an archive; how many were written.

    Large archives of other writers are read by many tasks afterwards.
    """
    todo = [(path, size) for path, size, own in archives(folder) if own is None]
    if not todo:
        return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                offsets, packed = [], path.endswith(".gz")
                with fs.open_input_file(path) as f:
                    stream, more = Stream(ahead(f, size), 0, size, packed), size > 0
                    while more:
                        start = stream.at - len(stream.raw) - (0 if packed else len(stream.have))
                        found = record_at(stream, ["record_type"], [])
                        if found is not None:
                            offsets.append(start)
                        if packed:
                            more = stream.close_member()
                        elif found is not None:
                            stream.skip(found[1] + 4)
                            more = len(stream.have) > 0 or stream.at < size
                        else:
                            more = False
                base = path.removesuffix(".gz").removesuffix(".warc")
                temporary = f"{base}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(temporary) as out:
                    out.write("\n".join(map(str, offsets)).encode())
                fs.move(temporary, f"{base}.idx")
            yield batch

    spark.createDataFrame(todo, "path string, size long").repartition(len(todo), "path").mapInArrow(run, "path string, size long").collect()  # a row an archive
    return len(todo)


def read(spark: SparkSession, folder: str, columns: str = SCHEMA, verify: bool = False) -> DataFrame:
    """The records of a folder of archives; only the columns of the given schema are decoded.

    Archives of any size are read in chunks; one payload at a time is held whole,
    if it is asked for.  Record ids may repeat, and a record without a header has
    null there.  An empty folder gives no rows.
    """
    register(spark)
    return spark.read.format("warc").schema(columns).option("verify", str(verify).lower()).load(folder)

"""Similarity join of documents on word n-gram sets, with prefix trees.

A document's set is its distinct n-grams (64-bit hashes) in one global order,
rare ones first.  Two sets of Jaccard similarity 3/4 or more share some n-grams in
their beginnings (a quarter of each set and SHARED - 1 members more), so:

1.  N-grams are counted by the upper half of their hashes, part by part, and
    frequent ones come last in the order.  Any order is right; a good one keeps
    n-grams of common passages out of the beginnings.  Counters are far more than
    n-grams, so that rare n-grams do not hide frequent ones in a large corpus.
2.  Beginnings are dealt by n-gram.  Sets that meet in n-grams that few sets have
    are tied if they meet SHARED times and their sizes and places allow a link;
    where many sets have an n-gram all are tied to the least of them.  The latter
    are combined inside tasks before they are dealt, so a very common n-gram
    costs a task no more than any other.
3.  The components of the ties are groups that no link leaves.  Each group's
    sets are stored in a prefix tree, in the global order, and every set of the
    group walks the tree: overlaps with shared beginnings are counted once, those
    of all sets that go on alone from one place together, subtrees are left when the lengths that remain cannot bring enough overlap,
    and when they hold nothing that is not in the walker's component already.
4.  Groups of more than GROUP_SETS sets are split.  All sets are compared with
    one of them; by the triangle inequality of Jaccard distances a set that is
    not linked with it can be linked only with sets at a similar distance.  Sets
    are cut into blocks by distance and pairs of blocks are joined, each by a
    tree of its own.

Equal sets are one set from the start.  Groups, blocks and their pairs are tables;
the driver gets a bounded number of frequent n-grams and some sums.  A side of a join is
broadcast where a sum of its bytes is small, and else dealt with salt, so a
group of any size is many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bytes import LOWER, hash_runs, mix, ragged, text_batches, utf8, windows, words
from tidemark.llm.components import components
from tidemark.session import written

#: Words in an n-gram; similarity at least NEED of OF.
WORDS, NEED, OF = 5, 75, 100
#: Counters (the upper 32 bits of a hash) are dealt in parts; an n-gram is frequent when its counter is RATIO times the mean and FEWEST at least.
BITS, PARTS = 32, 1024
RATIO, FEWEST = 1.75, 4
_SHIFT = np.uint64(64 - BITS)
#: Frequent n-grams that tasks know, the most frequent ones (5 bytes each), and n-grams that a task counts before it passes them on.
KNOWN, COUNTED = 4 << 20, 4 << 20
#: Sets that one prefix tree holds, and sets in a block of a larger group.
GROUP_SETS, BLOCK_SETS = 400, 200
#: Bytes of text whose first quarters are combined before they are dealt, and of dealt n-grams in a bucket.
COMBINED_BYTES, BUCKET_BYTES = 8 << 20, 1 << 20
#: Members of their beginnings that linked sets share at least, and sets of an n-gram up to which pairs are looked at one by one.
SHARED, SMALL_BLOCK = 3, 16
#: Bytes of a table that may be broadcast, and parts into which rows of one key are dealt beyond.
BROADCAST_BYTES, SALTS = 24 << 20, 32
#: Bytes of bit maps that a tree may hold.
MAP_BYTES = 16 << 20
#: Words are stretches of bytes that are no ASCII white space.
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def ngrams(column: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each row, ascending, rows end to end, and where each row starts (one entry more).

    Rows of fewer words than n have the whole sequence as their one n-gram; null
    rows and rows without words have none.
    """
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, before = words(data, offsets, _WORD)
    own = hash_runs(data, starts, ends)
    count = np.diff(before)
    full = np.zeros(max(0, len(own) - n + 1), dtype=np.uint64)
    for k in range(n):
        full += own[k : k + len(full)] * _PLACE[k]
    full = mix(full + np.uint64(n))
    out, sizes = [], np.zeros(len(count), dtype=np.int64)
    for r, (a, c) in enumerate(zip(before[:-1].tolist(), count.tolist(), strict=True)):
        if c >= n:
            got = np.unique(full[a : a + c - n + 1])
        elif c:
            got = mix((own[a : a + c] * _PLACE[:c]).sum(keepdims=True, dtype=np.uint64) + np.uint64(c))
        else:
            continue
        out.append(got)
        sizes[r] = len(got)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64), np.r_[0, np.cumsum(sizes)]


def set_ids(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit id of each row's set, as a signed number; sets are equal when ids are."""
    size = np.diff(at)
    has = size > 0
    out = np.zeros(len(size), dtype=np.uint64)
    if has.any():
        out[has] = np.add.reduceat(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][has])
    return mix(out + size.astype(np.uint64)).astype(np.int64)


def prefix_length(size: np.ndarray) -> np.ndarray:
    """Members of a set of which a linked set has one at least, in any common order."""
    return size - -(-size * NEED // OF) + 1


def needed(a: object, b: object) -> object:
    """The overlap of linked sets of these sizes: 100 x >= 75 (a + b - x)."""
    return -(-NEED * (a + b) // (OF + NEED))


def _in_order(grams: np.ndarray, at: np.ndarray, classes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The same sets, members in the global order: class of frequency first (0 for n-grams that are not known as frequent), then hash."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    known, level = classes
    if not len(known):
        return grams[np.lexsort((grams, row))]
    own = (grams >> _SHIFT).astype(np.uint32)
    place = np.minimum(np.searchsorted(known, own), len(known) - 1)
    return grams[np.lexsort((grams, np.where(known[place] == own, level[place], 0), row))]


def _frequency_classes(counts: np.ndarray, mean: float) -> np.ndarray:
    """0 for counters below what makes an n-gram frequent, else 1 and the logarithm of how often they are above it."""
    return np.floor(np.log2(np.maximum(counts / max(RATIO * mean, FEWEST), 0.5)) + 1).astype(np.uint8)


class Tree:
    """A prefix tree of sets (arrays of members in one order), in arrays: sets sorted, and nodes as ranges of them."""

    def __init__(self, sets: list[np.ndarray], names: np.ndarray):
        """names: of the members, each between 0 and their number, in the order of the sets' members."""
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[k] for k in self.order]
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.members = len(names)
        self.flat = np.concatenate([*self.sets, np.zeros(0, dtype=np.int64)])
        self.at = np.r_[0, np.cumsum(self.sizes)]
        #: Members of a set before its tail, the part that no other set shares in the tree.
        self.before = self.sizes.copy()
        # node: (first set, end, first member, end member, children, sets that go on alone below it)
        self.nodes: list[tuple[int, int, int, int, list[int], list[int]]] = []
        self.bounds: list[tuple[int, int]] = []
        self.roots, self.alone = self._build(0, len(sets), 0)
        self.maps = self._bits()

    def _bits(self) -> np.ndarray | None:
        """A bit map of each set's tail over the members that several sets have, if all of them are small."""
        shared = np.bincount(self.flat, minlength=self.members) > 1
        self.shared = np.flatnonzero(shared)
        lanes = len(self.shared) // 64 + 1
        if 8 * lanes * len(self.sets) > MAP_BYTES:
            return None
        column = np.cumsum(shared) - 1
        lengths = self.sizes - self.before
        row, member = np.repeat(np.arange(len(self.sets)), lengths), self.flat[ragged(self.at[:-1] + self.before, lengths)]
        row, own = row[shared[member]], column[member[shared[member]]]
        bits = np.zeros((len(self.sets), 64 * lanes), dtype=bool)
        bits[row, own] = True
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")

    def _build(self, first: int, end: int, depth: int) -> tuple[list[int], list[int]]:
        """Nodes of the sets first..end that agree in their first `depth` members, and those of them that share no more with another."""
        made: list[int] = []
        single: list[int] = []
        top: list[tuple[int, int, int, list[int], list[int]]] = [(first, end, depth, made, single)]
        while top:
            a, b, d, into, alone = top.pop()
            while a < b and len(self.sets[a]) == d:  # sets that end here have been counted by their parent
                a += 1
            while a < b:
                head = self.sets[a][d]
                to = a + 1
                while to < b and self.sets[to][d] == head:
                    to += 1
                if to - a == 1:
                    alone.append(a)
                    self.before[a] = d
                    a = to
                    continue
                x, y = self.sets[a], self.sets[to - 1]
                m = min(len(x), len(y), int(self.sizes[a:to].min()))
                differ = np.flatnonzero(x[d:m] != y[d:m])
                stop = d + int(differ[0]) if len(differ) else m
                children: list[int] = []
                below: list[int] = []
                into.append(len(self.nodes))
                self.nodes.append((a, to, d, stop, children, below))
                self.bounds.append((int(self.sizes[a:to].min()), int(self.sizes[a:to].max())))
                top.append((a, to, stop, children, below))
                a = to
        return made, single

    def _tails(self, walker: int, mark: np.ndarray, label: np.ndarray, alone: list[int], overlap: int, after: bool, others: np.ndarray | None) -> Iterator[int]:
        """Sets linked with set `walker` among those that go on alone from one place of the tree, where the overlap is known; all tails are counted together."""
        own = np.array(alone, dtype=np.int64)
        own = own[(own > walker if after else own != walker) & (label[own] != label[walker])]
        if others is not None:
            own = own[others[own]]
        size, sizes = self.sizes[walker], self.sizes[own]
        least, tail = needed(size, sizes), sizes - self.before[own]
        fits = (OF * np.minimum(size, sizes) >= NEED * np.maximum(size, sizes)) & (overlap + np.minimum(tail, size - overlap) >= least)
        own, least, tail = own[fits], least[fits], tail[fits]
        if not len(own):
            return
        if self.maps is not None:
            lanes = np.zeros(64 * self.maps.shape[1], dtype=bool)
            lanes[: len(self.shared)] = mark[self.shared]
            common = np.bitwise_count(self.maps[own] & np.packbits(lanes, bitorder="little").view("<u8")).sum(axis=1, dtype=np.int64)
        else:
            common = np.add.reduceat(mark[self.flat[ragged(self.at[own] + self.before[own], tail)]], np.cumsum(tail) - tail, dtype=np.int64)
        for s in own[overlap + common >= least].tolist():
            if label[s] != label[walker]:
                yield s

    def links(self, walker: int, label: np.ndarray, after: bool = True, others: np.ndarray | None = None) -> Iterator[int]:
        """Sets linked with set `walker`, each of another label at the time it is found; the caller may change labels meanwhile."""
        mine = self.sets[walker]
        size = len(mine)
        mark = np.zeros(self.members, dtype=bool)
        mark[mine] = True
        yield from self._tails(walker, mark, label, self.alone, 0, after, others)
        stack = [(k, 0) for k in self.roots]
        while stack:
            k, overlap = stack.pop()
            a, b, d, stop, children, alone = self.nodes[k]
            if after and b - 1 <= walker:
                continue
            low, high = self.bounds[k]
            least = needed(size, low)
            if OF * min(size, high) < NEED * max(size, low):
                continue
            if overlap + min(high - d, size - overlap) < least:
                continue
            if (label[a:b] == label[walker]).all():
                continue
            overlap += int(np.count_nonzero(mark[self.sets[a][d:stop]]))
            if overlap + min(high - stop, size - overlap) < least:
                continue
            s = a
            while s < b and self.sizes[s] == stop:
                if s != walker and label[s] != label[walker] and overlap >= needed(size, stop) and (others is None or others[s]):
                    yield s
                s += 1
            if alone:
                yield from self._tails(walker, mark, label, alone, overlap, after, others)
            stack += [(c, overlap) for c in children]


def _named(sets: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sets of hashes as sets of small numbers in an order of their own: rare members first, ties by hash."""
    flat = np.concatenate(sets)
    names, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(count, kind="stable")
    number = np.empty(len(names), dtype=np.int64)
    number[order] = np.arange(len(names))
    at = np.r_[0, np.cumsum([len(s) for s in sets])]
    mapped = number[inverse]
    return [np.sort(mapped[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], names


def join_group(sets: list[np.ndarray], label: np.ndarray | None = None, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets (arrays of hashes) that join their components: a spanning forest of all links.

    label: components known before.  sides: only links between different sides
    are looked for.
    """
    if len(sets) < 2:
        return []
    named, names = _named(sets)
    tree = Tree(named, names)
    label = np.arange(len(sets)) if label is None else label.copy()
    label = label[tree.order]
    side = None if sides is None else sides[tree.order]
    found = []
    for k in range(len(sets)):
        for s in tree.links(k, label, others=None if side is None else side != side[k]):
            if label[s] != label[k]:
                found.append((tree.order[k], tree.order[s]))
                label[label == label[s]] = label[k]
    return found


def _stats(df: DataFrame, text: str, keep: list[str], n: int) -> DataFrame:
    """A written table with a row per document (kept columns, text key, size, set id) and rows of compressed counters."""
    source = df.select(*keep, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__key"), F.col(text).alias("__text"))
    kinds = source.select(*keep, "__key").schema
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields), "__size long, __set long, __part int, __counts binary"])

    def counted(places: list[np.ndarray], kept: list[pa.Field]) -> pa.RecordBatch:
        place, times = np.unique(np.concatenate(places), return_counts=True)
        part = place >> np.uint32(BITS - PARTS.bit_length() + 1)
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        raw = [_packed(place[a:b], times[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(raw), f.type) for f in kept), pa.nulls(len(raw), pa.int64()), pa.nulls(len(raw), pa.int64()), pa.array(part[edge[:-1]].astype(np.int32)), pa.array(raw, pa.binary())], names=[*(f.name for f in kept), "__size", "__set", "__part", "__counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: list[np.ndarray] = []
        kept: list[pa.Field] = []
        for batch in batches:
            for part in windows(batch, "__text"):
                grams, at = ngrams(part.column("__text"), n)
                if len(grams):
                    places.append((grams >> _SHIFT).astype(np.uint32))
                size = np.diff(at)
                rows = part.num_rows
                kept = [part.schema.field(c) for c in [*keep, "__key"]]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(size), pa.array(set_ids(grams, at), mask=size == 0), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=[*(f.name for f in kept), "__size", "__set", "__part", "__counts"])
                if sum(map(len, places)) > COUNTED:
                    yield counted(places, kept)
                    places = []
        if places:
            yield counted(places, kept)

    return written(source.mapInArrow(run, fields), "sets")


def _packed(place: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending places and how often each came, by planes of the bytes of their differences."""
    planes = np.diff(place, prepend=place[:1]).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return np.uint32(place[0]).tobytes() + zlib.compress(planes.tobytes() + np.minimum(times, 65535).astype("<u2").tobytes(), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(raw[4:])
    n = len(data) // 6
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()
    return np.frombuffer(raw[:4], "<u4")[0] + np.cumsum(steps, dtype=np.uint32), np.frombuffer(data, "<u2", n, 4 * n).astype(np.int64)


def _classes(stats: DataFrame, members: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of frequent n-grams, ascending, and their classes; KNOWN at most, by whole classes from the most frequent on."""
    mean, width = members / 2.0**BITS, 1 << (BITS - PARTS.bit_length() + 1)

    def flush(part: int, found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        place, times = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        if len(place) < width // 16:
            place, at = np.unique(place, return_inverse=True)
            total = np.bincount(at, times)
        else:
            total = np.bincount(place - np.uint32(part * width), times, width)
            place = np.arange(part * width, (part + 1) * width, dtype=np.uint32)
        often = total >= max(RATIO * mean, FEWEST)
        place, level = place[often], _frequency_classes(total[often], mean)
        levels = np.unique(level).tolist()
        if levels:
            own = [place[level == x] for x in levels]
            yield pa.RecordBatch.from_arrays([pa.array(levels, pa.int32()), pa.array([len(x) for x in own], pa.int64()), pa.array([_packed(x, np.ones(len(x))) for x in own], pa.binary())], names=["level", "n", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now and found:
                    yield from flush(now, found)
                    found = []
                now = part
                found.append(_unpacked(raw.as_py()))
        if found:
            yield from flush(now, found)

    dealt = stats.where("__part is not null").select(F.col("__part").alias("part"), F.col("__counts").alias("counts")).repartition("part").sortWithinPartitions("part")
    often = written(dealt.mapInArrow(run, "level int, n long, places binary"), "frequent")
    least, room = 256, KNOWN
    for r in often.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():  # a row for a power of two
        if r["n"] > room:
            break
        least, room = r["level"], room - r["n"]
    rows = [(r["level"], _unpacked(r["places"])[0]) for r in often.where(F.col("level") >= least).select("level", "places").collect()]
    if not rows:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint8)
    place = np.concatenate([x for _, x in rows])
    level = np.repeat(np.array([k for k, _ in rows], dtype=np.uint8), [len(x) for _, x in rows])
    order = np.argsort(place)
    return place[order], level[order]


def _block_pairs(token: np.ndarray, owner: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b), a > b, of each block of equal n-grams (sorted by n-gram, then set) that can be linked, how often they met and the overlaps needed.

    Two linked sets have SHARED common members among those dealt out (or all that
    their overlap needs, if fewer), and what follows each of these in both sets
    makes up the rest of the overlap.
    """
    n = len(token)
    found = []
    for gap in range(1, SMALL_BLOCK):
        same = np.flatnonzero(token[: n - gap] == token[gap:]) if n > gap else np.zeros(0, dtype=np.int64)
        if not len(same):
            break
        other = same + gap
        least = needed(size[same], size[other])
        rest = np.minimum(size[same] - place[same], size[other] - place[other]) - 1
        fits = (owner[same] != owner[other]) & (SHARED + rest >= least) & (np.minimum(size[same], size[other]) >= least)
        x, y = owner[same[fits]], owner[other[fits]]
        found.append(np.stack([np.maximum(x, y), np.minimum(x, y), np.minimum(SHARED, least[fits])], axis=1))
    if not found:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    rows, times = np.unique(np.concatenate(found), axis=0, return_counts=True)
    return rows[:, 0], rows[:, 1], times, rows[:, 2]


def _ties(df: DataFrame, text: str, n: int, classes: object, buckets: int) -> DataFrame:
    """Written pairs (a, b), a > b, of set ids whose components no link leaves.

    Sets that meet in n-grams of few sets are tied if they meet often enough to
    be linked; sets of an n-gram that many have are all tied to the least one.
    """
    kinds = np.dtype([("token", "<u8"), ("owner", "<i8"), ("size", "<u4"), ("place", "<u4")])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in windows(batch, "text", COMBINED_BYTES):
                made = []
                for small in windows(part, "text"):
                    grams, at = ngrams(small.column("text"), n)
                    ids, size = set_ids(grams, at), np.diff(at)
                    has = size > 0
                    ordered = _in_order(grams, at, classes.value)
                    first = np.minimum(prefix_length(size[has]) + SHARED - 1, size[has])
                    total = np.cumsum(first)
                    within = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - first, first)
                    own = np.empty(len(within), dtype=kinds)
                    own["token"] = ordered[np.repeat(at[:-1][has], first) + within]
                    own["owner"] = np.repeat(ids[has], first)
                    own["size"] = np.repeat(size[has], first)
                    own["place"] = within
                    made.append(own)
                rows = np.concatenate(made)
                if not len(rows):
                    continue
                rows = rows[np.lexsort((rows["owner"], rows["token"]))]
                token, owner = rows["token"], rows["owner"]
                new = np.r_[True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])]  # copies of a set are one
                rows = rows[new]
                token, owner = rows["token"], rows["owner"]
                start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
                length = np.diff(np.r_[start, len(token)])
                many = np.repeat(length > SMALL_BLOCK, length)
                head = np.repeat(start, length)
                tied = many & (np.arange(len(token)) != head)
                pairs = np.unique(np.stack([owner[tied], owner[head][tied]], axis=1), axis=0) if tied.any() else np.zeros((0, 2), dtype=np.int64)
                rows["size"][many] = 0  # a set that stands for many
                rows = rows[~tied]
                bucket = ((rows["token"] >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, rows = bucket[order], rows[order]
                edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                blobs = [rows[x:y].tobytes() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                where = bucket[edge[:-1]].tolist()
                for x in range(0, len(pairs), 4096):  # ties found here travel along, spread over the buckets
                    blobs.append(pairs[x : x + 4096].tobytes())
                    where.append(-1 - int(pairs[x, 0]) % buckets)
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "data"])

    def rows_of(a: np.ndarray, b: np.ndarray, times: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x), pa.int64()) for x in (a, b, times, need)], names=["a", "b", "times", "need"])

    def flush(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        if bucket < 0:
            pairs = np.unique(np.concatenate([np.frombuffer(x, dtype=np.int64).reshape(-1, 2) for x in blobs]), axis=0)
            yield rows_of(pairs[:, 0], pairs[:, 1], np.ones(len(pairs)), np.ones(len(pairs)))
            return
        rows = np.frombuffer(b"".join(blobs), dtype=kinds)
        token, owner = rows["token"], rows["owner"]
        order = np.lexsort((owner, token))
        token, owner, size, place = token[order], owner[order], rows["size"][order].astype(np.int64), rows["place"][order].astype(np.int64)
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        length = np.diff(np.r_[start, len(token)])
        many = np.repeat((length > SMALL_BLOCK) | (np.minimum.reduceat(size, start) == 0), length)
        head = np.repeat(start, length)
        tied = many & (owner != owner[head])
        if tied.any():
            pairs = np.unique(np.stack([owner[tied], owner[head][tied]], axis=1), axis=0)
            yield rows_of(pairs[:, 0], pairs[:, 1], np.ones(len(pairs)), np.ones(len(pairs)))
        few = np.repeat(length > 1, length) & ~many
        if few.any():
            a, b, times, need = _block_pairs(token[few], owner[few], size[few], place[few])
            if len(a):
                yield rows_of(a, b, times, need)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for batch in batches:
            for k, raw in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if k != bucket:
                    if blobs:
                        yield from flush(bucket, blobs)
                    bucket, blobs = k, []
                blobs.append(raw)
        if blobs:
            yield from flush(bucket, blobs)

    dealt = df.select(F.col(text).alias("text")).mapInArrow(local, "bucket long, data binary").repartition("bucket").sortWithinPartitions("bucket")
    met = dealt.mapInArrow(meet, "a long, b long, times long, need long")
    return written(met.groupBy("a", "b").agg(F.sum("times").alias("times"), F.min("need").alias("need")).where("times >= need").select("a", "b"), "ties")


def _joined(rows: DataFrame, small: DataFrame, on: list[str], bytes_: int, salt: str) -> DataFrame:
    """Rows with the columns of a smaller table, which has a row for a key: broadcast if it has few bytes, else every key is dealt to SALTS tasks by a column of the rows."""
    if bytes_ <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), on)
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(copies, [*on, "__salt"]).drop("__salt")


def _set_rows(df: DataFrame, text: str, n: int, wanted: DataFrame) -> DataFrame:
    """Written rows (group, set, size, members in bytes) of the sets in wanted(key, set, group), each set once or some times.

    Where wanted is too large to be broadcast, a text is taken once from each task
    before it is dealt by its hash, so copies of one text are no hot key.
    """
    source = df.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))
    if wanted.count() * 24 <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    else:
        source = source.groupBy("key").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for k, s in enumerate(batch.column("set").to_pylist()):
                if s not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(s)
                    fresh.append(k)
            for part in windows(batch.take(pa.array(fresh, pa.int64())), "text"):
                grams, at = ngrams(part.column("text"), n)
                same = set_ids(grams, at) == part.column("set").to_numpy()
                data = [grams[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                rows = pa.RecordBatch.from_arrays([part.column("group"), part.column("set"), pa.array(np.diff(at)), pa.array(data, pa.binary())], names=["group", "set", "size", "members"])
                yield rows.filter(pa.array(same))

    return written(source.join(wanted, "key").mapInArrow(run, "group long, set long, size long, members binary"), "set-rows", codec="snappy")


def _grouped(rows: DataFrame, by: list[str], run_group: object, schema: str) -> DataFrame:
    """run_group(list of rows as dictionaries) for the rows of each group, one group after another in a task."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            for values in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                row = dict(zip(names, values, strict=True))
                now = tuple(row[c] for c in by)
                if now != key and own:
                    yield from run_group(own)
                    own = []
                key = now
                own.append(row)
        if own:
            yield from run_group(own)

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _once(rows: list[dict]) -> list[dict]:
    """Rows of different sets; tasks may have made the same one."""
    return list({r["set"]: r for r in rows}.values())


def _members(rows: list[dict]) -> list[np.ndarray]:
    return [np.frombuffer(r["members"], dtype=np.uint64) for r in rows]


def _small_groups(rows: DataFrame) -> DataFrame:
    def run(own: list[dict]) -> Iterator[pa.RecordBatch]:
        own = _once(own)
        found = join_group(_members(own))
        if found:
            yield _pairs([own[i]["set"] for i, _ in found], [own[j]["set"] for _, j in found])

    return _grouped(rows, ["group"], run, "a long, b long")


def _large_groups(rows: DataFrame, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Links of groups of any size: with a first set, then between blocks of similar distance from it."""
    rows = written(rows.dropDuplicates(["set"]), "large-groups", codec="snappy")
    heads = rows.groupBy("group").agg(F.min("set").alias("set"))
    pivots = written(rows.join(heads, ["group", "set"]).select("group", F.col("set").alias("head"), F.col("members").alias("theirs")), "pivots", codec="snappy")
    size = pivots.agg(F.sum(F.octet_length("theirs") + 32)).first()[0] or 0

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zone, linked = [], []
            for own, theirs in zip(batch.column("members").to_pylist(), batch.column("theirs").to_pylist(), strict=True):
                common = len(np.intersect1d(np.frombuffer(own, dtype=np.uint64), np.frombuffer(theirs, dtype=np.uint64), assume_unique=True))
                union = (len(own) + len(theirs)) // 8 - common
                linked.append(OF * common >= NEED * union)
                zone.append(int(20 * (union - common) // union))
            kept = [c for c in batch.schema.names if c != "theirs"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(zone, pa.int32()), pa.array(linked, pa.bool_())], names=[*kept, "zone", "linked"])

    ready = _joined(rows, pivots, ["group"], size, "set").select("group", "set", "members", "head", "theirs")
    measured = written(ready.mapInArrow(measure, "group long, set long, members binary, head long, zone int, linked boolean"), "measured", codec="snappy")
    star = measured.where("linked and set <> head").select(F.col("set").alias("a"), F.col("head").alias("b"))
    # at most 42 rows a group
    zones = written(measured.groupBy("group", "zone", "linked").agg(F.ceil(F.count(F.lit(1)) / block_sets).cast("int").alias("blocks")), "zones")
    one, two = (zones.select("group", *(F.col(c).alias(f"{c}{k}") for c in ("zone", "linked", "blocks"))) for k in (1, 2))
    # twentieths of distance: linked sets differ by a quarter at most; sets linked with the first one are together already
    near = one.join(two, "group").where("not (linked1 and linked2) and abs(zone1 - zone2) <= 6 and (zone1 < zone2 or zone1 = zone2 and linked1 <= linked2)")
    near = near.withColumn("block1", F.explode(F.sequence(F.lit(0), F.col("blocks1") - 1)))
    same = (F.col("zone1") == F.col("zone2")) & (F.col("linked1") == F.col("linked2"))
    near = near.withColumn("block2", F.explode(F.sequence(F.when(same, F.col("block1")).otherwise(0), F.col("blocks2") - 1)))
    pairs = written(near.withColumn("alone", same & (F.col("block1") == F.col("block2"))).withColumn("pair", F.monotonically_increasing_id()), "block-pairs")
    side = lambda k: pairs.select("group", F.col(f"zone{k}").alias("zone"), F.col(f"linked{k}").alias("linked"), F.col(f"block{k}").alias("block"), "pair", F.lit(k).alias("side"), "alone")
    ends = side(1).unionByName(side(2).where("not alone")).select("group", "zone", "linked", "block", "pair", "side")
    placed = _joined(measured, zones, ["group", "zone", "linked"], 24 * zones.count(), "set").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    # a block has some hundred sets, so its key is none that many rows share
    ends = F.broadcast(ends) if 64 * pairs.count() <= BROADCAST_BYTES else ends
    both = placed.join(ends, ["group", "zone", "linked", "block"]).select("pair", "side", "set", "head", "linked", "members")

    def run(own: list[dict]) -> Iterator[pa.RecordBatch]:
        side = np.array([r["side"] for r in own])
        label = np.arange(len(own))
        label[[r["linked"] for r in own]] = len(own)
        found = join_group(_members(own), label, side if (side != side[0]).any() else None)
        if found:
            yield _pairs([own[i]["set"] for i, _ in found], [own[j]["set"] for _, j in found])

    return star.unionByName(_grouped(both, ["pair"], run, "a long, b long"))


def similar_documents(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, group_sets: int = GROUP_SETS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(key, n_shingles, component_id) for every row: the size of its set and the smallest key that links reach from it, itself included.

    Two rows are linked when 100 x intersection >= 75 x union.  Rows without
    words, and null texts, have empty sets, are linked with nothing and have
    their own key as component.  Rows with equal sets are linked; a null key is
    skipped when the smallest is taken unless all are null.  Repeated rows stay.
    """
    text_batches(df.sparkSession)
    stats = _stats(df, text, [key], n)
    docs = stats.where("__part is null").select(F.col(f"`{key}`").alias("key"), F.col("__key").alias("text_key"), F.col("__size").alias("size"), F.col("__set").alias("set"))
    total = docs.agg(F.sum("size")).first()[0] or 0
    classes = df.sparkSession.sparkContext.broadcast(_classes(stats, total))
    ties = _ties(df, text, n, classes, max(16, int(total * (1 - NEED / OF) * 24 / BUCKET_BYTES)))
    groups = written(components(ties).select(F.col("node").alias("set"), F.col("component").alias("group")), "groups")
    keys = docs.where("size > 0").groupBy("set").agg(F.min("text_key").alias("key"))
    wanted = written(keys.join(groups, "set").select("key", "set", "group"), "wanted")
    rows = _set_rows(df, text, n, wanted)
    sizes = wanted.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.where(F.col("n") > group_sets).select("group"), "large")
    links = _small_groups(rows.join(large, "group", "left_anti"))
    number = large.count()
    if number:
        links = links.unionByName(_large_groups(_joined(rows, large, ["group"], 16 * number, "set"), block_sets))
    final = components(written(links, "links"))
    least = docs.where("size > 0").groupBy("set").agg(F.min("key").alias("least"))
    named = least.join(final.withColumnRenamed("node", "set"), "set", "left").select("set", "least", F.coalesce("component", "set").alias("component"))
    named = written(named, "named")
    of = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    by_set = written(named.join(of, "component").select(F.col("set").alias("set_"), "component_id"), "set-components")
    return docs.join(by_set, docs["set"] == by_set["set_"], "left").select(docs["key"], docs["size"].alias("n_shingles"), F.coalesce("component_id", docs["key"]).alias("component_id"))

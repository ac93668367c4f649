"""Exact token ids of whole texts by the tokenizers library, each distinct piece of text encoded once.

A byte-level tokenizer first splits a text by its pattern and then merges bytes
within each part.  A single space or line feed between two characters that are
not white space always starts a new part (the line feed is one of its own), and
so does a stop or comma after a Latin letter; text cut there can be encoded
piece by piece.  Pieces repeat; a bounded cache keeps the ids of short ones and
the library encodes only new pieces, many in one string: pieces that start with
a space follow each other, and the byte lengths of the ids tell them apart.
Other kinds of tokenizers get whole texts.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from tidemark.llm._bytes import hash_runs, ragged, utf8

#: Longest piece that is kept, in bytes; longer ones are encoded each time.
CACHED_BYTES = 64
#: Pieces kept by a worker before it starts anew.
CACHED_PIECES = 600_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: First bytes of characters that may be white space beyond ASCII.
_MAYBE = np.zeros(256, dtype=bool)
_MAYBE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Marks that end the part before them, and letters (or second bytes of letters after 0xC3) that those may follow.
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
_LATIN = np.zeros(256, dtype=bool)
_LATIN[65:91] = _LATIN[97:123] = True
_SECOND = np.zeros(256, dtype=bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
#: Pieces that are encoded in one string.
_JOINED = 256


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the texts can be cut without a change of ids: row starts, and single spaces and line feeds between solid characters."""
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    if n > 2:
        solid = ~_SPACE[data]
        before = solid.copy()  # the character that ends here is surely no white space
        before[1:] &= ~((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0)))
        before[2:] &= ~(_MAYBE[data[:-2]] & (data[:-2] >= 0xE1))
        after = solid & ~_MAYBE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        alone = before[:-2] & after[2:] & ~edge[1 : n - 1] & ~edge[2:n]
        space, line = alone & (data[1:-1] == 32), alone & (data[1:-1] == 10)
        cut[1 : n - 1] = space | line
        cut[2:n] |= line
        letter = _LATIN[data]
        letter[1:] |= _SECOND[data[1:]] & (data[:-1] == 0xC3)
        cut[1:n] |= letter[:-1] & _STOP[data[1:]]
    cut[offsets] = True
    cut[n] = False
    return np.flatnonzero(cut)


class PieceEncoder:
    """Ids of whole texts for one tokenizer file, as its library gives them without added special tokens: sentencepiece for .model, else tokenizers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread; the library's own would multiply its memory
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            self.by_piece, self.model = False, SentencePieceProcessor(model_file=path)
            self._clear()
            return
        from tokenizers import Tokenizer

        self.model = None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pre = self.tokenizer.pre_tokenizer
        self.added = list(self.tokenizer.get_added_tokens_decoder().values())
        plain = all(t.content[:1] == "<" and not set(t.content) & set(" \n.,;:!?") and not t.lstrip and not t.rstrip for t in self.added)
        self.by_piece = self.tokenizer.normalizer is None and type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and plain
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.slots = np.zeros(0, dtype=np.int64)
        self.first = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and how many each has, straight from the library."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if self.model is None else self.model.encode(texts, num_threads=1)
        count = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        flat = np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=int(count.sum()))
        return flat, count

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces end to end, and how many each has."""
        n = len(starts)
        length = ends - starts
        head, last = data[starts], data[ends - 1]
        follows = (head == 32) & (length > 1) & (length <= CACHED_BYTES) & ~_SPACE[data[np.minimum(starts + 1, len(data) - 1)]] & ~_MAYBE[data[np.minimum(starts + 1, len(data) - 1)]] & (_LATIN[last] | _STOP[last])
        order = np.argsort(~follows, kind="stable")  # those that may follow each other first
        m = int(follows.sum())
        bounds = [*range(0, m, _JOINED), *range(m, n + 1)] if m < n else [*range(0, m, _JOINED), m]
        moved = data[ragged(starts[order], length[order])].tobytes()
        stops = np.r_[0, np.cumsum(length[order])]
        edges = stops[bounds].tolist()
        flat, each = self.library([moved[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)])
        until = np.cumsum(self.width[flat])
        per = np.zeros(n, dtype=np.int64)
        per[m:] = each[len(each) - (n - m) :]
        if m:
            per[:m] = np.diff(np.r_[0, np.searchsorted(until, stops[1 : m + 1], side="right")])
        begin = np.cumsum(per) - per
        count, first = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        count[order], first[order] = per, begin
        return flat[ragged(first, count)], count

    def slots_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot in first/count/flat of each piece; what is new is encoded."""
        if len(self.hashes) > CACHED_PIECES:
            self._clear()
        hashes = hash_runs(data, starts, ends)
        kinds, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, kinds)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == kinds[known]
        if not known.all():
            new = where[~known]
            flat, count = self.encode_pieces(data, starts[new], ends[new])
            slot = len(self.first) + np.arange(len(new))
            self.first = np.r_[self.first, len(self.flat) + np.cumsum(count) - count]
            self.count = np.r_[self.count, count]
            self.flat = np.r_[self.flat, flat]
            self.hashes = np.insert(self.hashes, at[~known], kinds[~known])
            self.slots = np.insert(self.slots, at[~known], slot)
            at = np.searchsorted(self.hashes, kinds)
        return self.slots[at][inverse]

    def pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Values (ids here) of the pieces end to end, how many each has, the pieces before each row, piece starts and ends."""
        data, offsets = utf8(column)
        starts = piece_starts(data, offsets)
        if len(starts):
            ends = np.r_[starts[1:], len(data)]
        else:
            ends = starts
        before = np.searchsorted(starts, offsets)
        short = ends - starts <= CACHED_BYTES
        slot = self.slots_of(data, starts[short], ends[short]) if short.any() else np.zeros(0, dtype=np.int64)
        count = np.zeros(len(starts), dtype=np.int64)
        count[short] = self.count[slot]
        far, far_count = self.encode_pieces(data, starts[~short], ends[~short]) if not short.all() else (self.flat[:0], count[:0])
        count[~short] = far_count
        flat = np.empty(int(count.sum()), dtype=self.flat.dtype)
        begin = np.cumsum(count) - count
        flat[ragged(begin[short], count[short])] = self.flat[ragged(self.first[slot], count[short])]
        flat[ragged(begin[~short], far_count)] = far
        return flat, count, before, starts, ends

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end and where each row starts in them (one entry more); null rows are empty."""
        if not self.by_piece:
            flat, count = self.library([x or "" for x in column.to_pylist()])
            return flat, np.r_[0, np.cumsum(count)]
        flat, count, before, _, _ = self.pieces(column)
        total = np.r_[0, np.cumsum(count)]
        return flat, total[before]


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """The encoder of this process for a tokenizer file."""
    return PieceEncoder(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file is; on a cluster every host has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)

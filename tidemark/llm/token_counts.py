"""Token counts of every prefix of a text, by dynamic programming over prefixes.

A byte-pair encoding is the only sequence of tokens whose neighbours are all
compatible: a pair (a, b) is compatible when the library encodes the text of
both as exactly [a, b].  So the last token of each prefix follows from the
prefixes before it: the last token of text[:i] is the token t that ends at i
and is compatible with the last token of text[:i - len(t)], and
count[i] = count[i - len(t)] + 1.  Counts of truncated texts, and the longest
prefix within a budget, are lookups afterwards; nothing is encoded again.

Tokenizers of other kinds give the counts of a word's prefixes themselves, each
different word once; a space between two plain letters or digits parts words.
A stretch without such a space is one word, and its cost grows with the square
of its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._bytes import text_batches, windows
from tidemark.llm.tokenize import CACHED_BYTES, PieceEncoder

#: Pairs of tokens whose compatibility a worker remembers before it starts anew.
PAIRS = 500_000
#: Where words part for tokenizers of other kinds, and prefixes that are encoded at once.
_BETWEEN, _PREFIXES = re.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z0-9])"), 256
#: White space by Unicode; Python and the regex module count four separators more.
_WHITE = r"[^\S\x1c-\x1f]"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: printable bytes are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter(PieceEncoder):
    """Counts of all prefixes, piece by piece: pieces() gives a count for each character of each piece.

    A piece is cut where the text before and after cannot change its ids, so the
    count of a prefix of a text is the ids of the pieces before plus the count of
    a prefix of one piece.
    """

    def __init__(self, path: str):
        import regex

        super().__init__(path)
        self.words: dict[str, list[int]] = {}
        if not self.by_piece:
            return
        alphabet = _byte_alphabet()
        special = {t.content for t in self.added}
        self.ids = {bytes(alphabet[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if token not in special}
        self.longest = max(map(len, self.ids), default=1)
        self.text_of = {i: b for b, i in self.ids.items()}
        self.special = sorted(special)
        self.parts = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?(?:[^\s\p{{L}}\p{{N}}]|[\x1c-\x1f])+|{_WHITE}+(?!\S|[\x1c-\x1f])|{_WHITE}+")
        self.single = regex.compile(r" ?(?:\p{L}+|\p{N}+|[.,;:!?]+)").fullmatch
        self.white = regex.compile(f"{_WHITE}+").fullmatch
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if special else None
        self.stand_in = {b: c for c, b in alphabet.items()}
        self.pair: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        known = self.pair.get(a << 32 | b)
        if known is None:
            if len(self.pair) > PAIRS:
                self.pair.clear()
            known = self.pair[a << 32 | b] = self._merge(self.text_of[a] + self.text_of[b]) == [a, b]
        return known

    def _merge(self, word: bytes) -> list[int]:
        """The library's ids of one part of a text."""
        return [t.id for t in self.tokenizer.model.tokenize("".join(self.stand_in[b] for b in word))]

    def extend(self, part: bytes, count: list[int], last: list[int]) -> None:
        """Carry counts and last tokens on to all prefixes of one part of a text; the lists hold those of a first stretch of it."""
        ids, longest, pair, compatible = self.ids, self.longest, self.pair, self.compatible
        for i in range(len(count), len(part) + 1):
            for j in range(max(0, i - longest), i):
                token = ids.get(part[j:i])
                if token is not None and (j == 0 or pair.get(last[j] << 32 | token) or compatible(last[j], token)):
                    count.append(count[j] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")

    def word(self, part: bytes) -> list[int]:
        """count[i] for i = 0..len(part): tokens of part[:i], itself one part of a text."""
        count, last = [0], [-1]
        self.extend(part, count, last)
        return count

    def plain(self, text: str) -> list[int]:
        """count[i] for i = 0..len(text) of a text without special tokens."""
        out, base, run, run_base = [0], 0, -1, 0  # base: tokens of the whole parts so far; run: where white space began
        for part in self.parts.findall(text):
            start = len(out) - 1
            counts = self.word(part.encode())
            at = _by_character(part, counts)
            if self.white(part):
                if run < 0:
                    run, run_base = start, base
                else:  # as long as a text ends in white space, all of it is one part
                    whole = text[run : start + len(part)]
                    at = [c + run_base - base for c in _by_character(whole, self.word(whole.encode()))[start - run :]]
                out += [base + c for c in at]
            else:
                if part in ("'re", "'ve", "'ll"):  # without its last letter it is two parts
                    at[1] = at[0] + self.word(part[1:2].encode())[-1]
                out += [base + c for c in at]
                if run >= 0 and part[0] == " ":
                    out[start + 1] = run_base + self.word(text[run : start + 1].encode())[-1]
                run = -1
            base += counts[-1]
        return out

    def prefixes(self, text: str) -> list[int]:
        """count[i] for i = 0..len(text): the tokens that the library gives for text[:i]."""
        if self.at_special is None or not self.at_special.search(text):
            return self.plain(text)
        out, before = [0], ""
        for piece in self.at_special.split(text):
            if piece in self.special:  # its own prefixes are ordinary text that joins what stands before
                base, after = out[len(out) - 1 - len(before)], out[-1]
                out += [base + c for c in self.plain(before + piece[:-1])[len(before) + 1 :]] + [after + 1]
                before = ""
            else:
                out += [out[-1] + c for c in self.plain(piece)[1:]]
                before = piece
        return out

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all prefixes of pieces end to end, and how many each has; in sorted order neighbours share first stretches."""
        whole = data.tobytes()
        raw = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        got: list[list[int]] = [[]] * len(raw)
        before, count, last = b"", [0], [-1]
        for k in sorted(range(len(raw)), key=raw.__getitem__):
            part = raw[k]
            text = part.decode("utf-8", "replace")
            if not self.single(text):
                got[k] = self.prefixes(text)[1:]
                continue
            same, most = 0, min(len(before), len(part))
            while same < most and before[same] == part[same]:
                same += 1
            del count[same + 1 :], last[same + 1 :]
            self.extend(part, count, last)
            before = part
            got[k] = _by_character(text, count)
        size = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        return np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=int(size.sum())), size

    def by_words(self, text: str) -> list[int]:
        """count[i] for i = 1..len(text), from counts of words; each but the first begins with its space and stands after a letter."""
        out, base = [], 0
        for k, word in enumerate(_BETWEEN.split(text)):
            known = self.words.get(word) if k else None
            if known is None:
                lead = "x" if k else ""
                least = int(self.library([lead])[1][0]) if k else 0
                known = []
                for a in range(0, len(word), _PREFIXES):
                    known += (self.library([lead + word[: i + 1] for i in range(a, min(len(word), a + _PREFIXES))])[1] - least).tolist()
                if k and len(word) <= CACHED_BYTES:
                    if len(self.words) > PAIRS:
                        self.words.clear()
                    self.words[word] = known
            out += [base + c for c in known]
            base = out[-1] if out else 0
        return out

    def prefix_counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all non-empty prefixes, rows end to end, and where each row starts (one entry more); null rows are empty."""
        if not self.by_piece:
            texts = [x or "" for x in column.to_pylist()]
            got = [self.by_words(x) for x in texts]
            return np.fromiter(chain.from_iterable(got), dtype=np.int64), np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64)
        flat, size, before, _, _ = self.pieces(column)
        stops = np.cumsum(size)
        total = flat[stops - 1].astype(np.int64) if len(size) else stops  # a piece has one character at least
        done = np.cumsum(total) - total
        rows = np.diff(before)
        first = np.r_[done, total.sum()][before[:-1]]
        base = done - np.repeat(first, rows)
        return flat.astype(np.int64) + np.repeat(base, size), np.r_[0, stops][before]


def _by_character(part: str, counts: list[int]) -> list[int]:
    """From counts by bytes of a text to counts after each character."""
    if len(counts) == len(part) + 1:
        return counts[1:]
    at, b = [], 0
    for ch in part:
        b += len(ch.encode())
        at.append(counts[b])
    return at


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """The counter of this process for a tokenizer file."""
    return PrefixCounter(path)


def token_counts(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, counts: str = "prefix_counts") -> DataFrame:
    """The columns `keep` (all but the text, unless given) and an array of counts: element i (from 1) is the tokens of the first i characters.

    Whole texts, any length, one pass, no shuffle; a worker holds a window of
    texts and a bounded cache.  Null and empty texts have an empty array.  An
    input column named like `counts` is replaced.  Rows are neither joined nor
    grouped, so repeated rows and ids are no special case.
    """
    text_batches(df.sparkSession)
    kept = [c for c in (keep if keep is not None else [c for c in df.columns if c != text]) if c != counts]
    source = df.select(*kept, F.col(text).alias("__text"))
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(counts, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for part in windows(batch, "__text"):
                flat, offsets = own.prefix_counts(part.column("__text"))
                got = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(flat, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), got], names=[*kept, counts])

    return source.mapInArrow(run, schema)


def n_tokens(counts: str = "prefix_counts") -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.try_element_at(F.col(counts), F.lit(-1)), F.lit(0)).cast("long")


def tokens_of_prefix(characters: Column, counts: str = "prefix_counts") -> Column:
    """Tokens of the text cut to so many characters (or of the whole text, if it is shorter)."""
    at = F.least(characters.cast("int"), F.size(F.col(counts)))
    return F.when(at > 0, F.try_element_at(F.col(counts), at)).otherwise(F.lit(0)).cast("long")


def longest_prefix(budget: Column, counts: str = "prefix_counts") -> Column:
    """Characters of the longest prefix that costs at most the budget."""
    fits = F.transform(F.col(counts), lambda c, i: F.when(c <= budget, i + 1).otherwise(F.lit(0)))
    return F.coalesce(F.array_max(fits), F.lit(0)).cast("long")

"""Vectorised word and n-gram hashing over Arrow string batches.

Words are maximal runs of bytes other than space and 0x09-0x0D. A batch is cut into chunks of a few
megabytes of whole documents, so that memory follows the chunk (or one document, if that is longer) and
never the batch. All hashes are 64-bit polynomial prefix hashes, finished by an avalanche step; they depend
on content only, so every executor and every rerun agrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard

CHUNK_BYTES = 1 << 20
U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What stands between runs of letters: every ASCII byte that isn't one.
NOT_LETTER = np.arange(256) < 128
NOT_LETTER[65:91] = NOT_LETTER[97:123] = False


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Avalanche of 64-bit values (the SplitMix64 finaliser)."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(n, b, U)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=U))

    def prefix(self, x: np.ndarray) -> np.ndarray:
        """Prefix sums of x[j] * base**j, with a leading zero."""
        self.grow(len(x) + 1)
        out = np.zeros(len(x) + 1, U)
        np.cumsum(x * self.up[: len(x)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of x[start:end], whatever stands before it."""
        return (prefix[end] - prefix[start]) * self.down[start]


_BYTES, _WORDS = Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)
_BYTES2, _WORDS2 = Powers(0x9FB21C651E98DF25), Powers(0xE7037ED1A0B428DB)
_BYTE_CODE, _BYTE_CODE2 = mix(np.arange(256, dtype=U), 7), mix(np.arange(256, dtype=U), 8)


@dataclass
class Chunk:
    """Some whole documents of a batch: their bytes, and where each document begins."""

    first: int
    data: np.ndarray
    docs: np.ndarray = field(repr=False)  # byte offsets, one more than there are documents
    between: np.ndarray = field(default_factory=lambda: _IS_SPACE, repr=False)  # which bytes stand between words

    @property
    def n(self) -> int:
        return len(self.docs) - 1

    @cached_property
    def _bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word = ~self.between[self.data]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        edge = self.docs[:-1][np.diff(self.docs) > 0]
        opens[edge] = word[edge]
        last = self.docs[1:][np.diff(self.docs) > 0] - 1
        closes[last] = word[last]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        return start, end, np.searchsorted(start, self.docs)

    @property
    def start(self) -> np.ndarray:
        return self._bounds[0]

    @property
    def end(self) -> np.ndarray:
        return self._bounds[1]

    @property
    def word_offsets(self) -> np.ndarray:
        """Index of each document's first word, and the number of words at the end."""
        return self._bounds[2]

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        data = _LOWER[self.data] if lower else self.data
        prefix = _BYTES.prefix(_BYTE_CODE[data])
        return mix(_BYTES.span(prefix, self.start, self.end) + (self.end - self.start).astype(U))

    def other_hashes(self) -> np.ndarray:
        """Hashes of the words that are independent of ``word_hashes``."""
        prefix = _BYTES2.prefix(_BYTE_CODE2[self.data])
        return mix(_BYTES2.span(prefix, self.start, self.end) + (self.end - self.start).astype(U), 4)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield Chunk(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def packed(column: pa.Array) -> pa.Array:
    """The texts one by one as zstd frames, for shuffles and tables; nulls stay."""
    pack = zstandard.ZstdCompressor(level=1).compress
    return pa.array([None if t is None else pack(t) for t in column.cast(pa.binary()).to_pylist()], pa.binary())


def unpacked(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first, texts): what ``packed`` packed, for neighbouring rows of about ``limit`` bytes (or one row, if that is longer)."""
    unpack = zstandard.ZstdDecompressor().decompress
    first, texts, size = 0, [], 0
    for i, x in enumerate(column):
        data = None if not x.is_valid else unpack(x.as_buffer())
        if texts and size + len(data or b"") > limit:
            yield first, pa.array(texts, pa.binary()).cast(pa.string())
            first, texts, size = i, [], 0
        texts.append(data)
        size += len(data or b"")
    if texts:
        yield first, pa.array(texts, pa.binary()).cast(pa.string())


class Sequences:
    """Hashes of runs of words of one chunk."""

    def __init__(self, words: np.ndarray, others: np.ndarray | None = None):
        self.words, self.others = words, others
        self.p1 = _WORDS.prefix(words)

    @cached_property
    def p2(self) -> np.ndarray:
        return _WORDS2.prefix(self.others)

    def first(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(_WORDS.span(self.p1, start, end) + (end - start).astype(U), 1)

    def second(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Made from the words' other hashes, so independent of the first: together they identify a run by 128 bits."""
        self.p2  # grows the powers
        return mix(_WORDS2.span(self.p2, start, end) + (end - start).astype(U), 2)


def windows(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and document of every run of ``width`` words within a document."""
    count = np.maximum(np.diff(offsets) - width + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - offsets[:-1], count), doc


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, have = x, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out

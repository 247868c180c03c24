"""Words of many texts at once, as arrays: byte spans, hashes, numbers, and the document of each word."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Spans that are looked up at a time, hashes remembered, and bytes of a remembered word.
PIECE, REMEMBERED, KEPT = 1 << 18, 200_000, 64
_P = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's last step)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one text after the other, and where each starts; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(starts: np.ndarray, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text each, and one row at least."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def solid(data: np.ndarray) -> np.ndarray:
    """True for bytes of words."""
    return ~_SPACE[data]


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of each word [^\\x20\\x09-\\x0D]+, and the first word of each text."""
    full = solid(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before, after = np.empty_like(full), np.empty_like(full)
    if len(full):
        before[0], before[1:] = False, full[:-1]
        after[-1], after[:-1] = False, full[1:]
    first = np.flatnonzero(full & (~before | edge[:-1]))
    last = np.flatnonzero(full & (~after | edge[1:])) + 1
    return first, last, np.searchsorted(first, starts)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class _Hashes(dict):
    """64 bits of BLAKE2b for each word: no texts are known, or feasible to find, that it takes for one another."""

    def __missing__(self, word: bytes) -> int:
        out = int.from_bytes(blake2b(word, digest_size=8, person=b"word").digest(), "little")
        if len(word) <= KEPT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = out
        return out


_hashes = _Hashes()


def _each(function, data: np.ndarray, first: np.ndarray, last: np.ndarray, kind: type) -> np.ndarray:
    """function of each span's bytes."""
    out = np.empty(len(first), kind)
    for lo in range(0, len(first), PIECE):
        i, j = first[lo : lo + PIECE], last[lo : lo + PIECE]
        base = int(i[0])
        raw = data[base : int(j[-1])].tobytes()
        out[lo : lo + PIECE] = np.fromiter((function(raw[x:y]) for x, y in zip((i - base).tolist(), (j - base).tolist())), kind, len(i))
    return out


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands. Spans are in order and don't overlap."""
    return _each(_hashes.__getitem__, data, first, last, np.uint64)


def span_numbers(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A number for each span, the same for equal bytes and no others. Spans are in order and don't overlap."""
    known: dict[bytes, int] = {}
    return _each(lambda span: known.setdefault(span, len(known)), data, first, last, np.int64)


def shingles(hashes: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row, and the first shingle of each text; fewer words make one shingle of all."""
    counts = np.diff(of)
    out_counts = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    of_shingle = np.concatenate([[0], np.cumsum(out_counts)])
    doc = np.repeat(np.arange(len(counts)), out_counts)
    at = of[:-1][doc] + np.arange(of_shingle[-1]) - of_shingle[:-1][doc]
    width = np.minimum(counts, k)[doc]
    out = width.astype(np.uint64)
    for i in range(k):
        use = width > i
        out = np.where(use, mix(out * np.uint64(_P) + hashes[np.where(use, at + i, 0)]) if len(hashes) else out, out)
    return out, of_shingle

"""Vectorised words, hashes and shingles over Arrow text columns.

Texts are handled as the UTF-8 bytes that Arrow already holds: a batch is cut
into slices of a few MB, words are found with byte masks and hashed with a
prefix polynomial, so no Python string per word is made.  Null texts have no
words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, grown to the longest slice met."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            def powers(b: int) -> np.ndarray:
                out = np.full(size, b, np.uint64)
                out[0] = 1
                return np.cumprod(out, dtype=np.uint64)
            self.up, self.down = powers(int(_BASE)), powers(_inverse(int(_BASE)))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


@dataclass(frozen=True)
class Alphabet:
    """How bytes make words: ``sep`` marks separators, ``fold`` maps bytes before hashing."""
    sep: np.ndarray
    fold: np.ndarray
    value: np.ndarray


def _alphabet(seps: list[int], lower: bool) -> Alphabet:
    sep = np.zeros(256, bool)
    sep[seps] = True
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[ord("A"):ord("Z") + 1] += 32
    value = mix64(np.arange(1, 257, dtype=np.uint64))[fold]
    return Alphabet(sep, fold, value)


_BLANKS = [0x20, *range(0x09, 0x0E)]
_NON_ALNUM = [b for b in range(128) if not chr(b).isalnum()]

#: Words [^\x20\x09-\x0D]+, unchanged.
BLANK_WORDS = _alphabet(_BLANKS, lower=False)
#: The same words after A-Z became a-z.
BLANK_WORDS_LOWER = _alphabet(_BLANKS, lower=True)
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z.
ALNUM_WORDS_LOWER = _alphabet([b for b in _NON_ALNUM], lower=True)


@dataclass
class Words:
    """Words of a slice of rows.

    ``start``/``end`` are byte positions in ``buf``; row ``i`` owns the words
    ``row[i]:row[i + 1]`` and the bytes ``at[i]:at[i + 1]``.
    """
    buf: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    alphabet: Alphabet

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row)

    @property
    def owner(self) -> np.ndarray:
        """Row of every word."""
        return np.repeat(np.arange(len(self.row) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word's (folded) bytes."""
        up, down = _POWERS.get(len(self.buf) + 1)
        pre = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(self.alphabet.value[self.buf] * up[:-1], out=pre[1:])
        h = (pre[self.end] - pre[self.start]) * down[self.start]
        return mix64(h + (self.end - self.start).astype(np.uint64))

    def room(self, k: int) -> np.ndarray:
        """Mask over words: a run of k words starts here within its row."""
        last = np.repeat(self.row[1:], self.counts)
        return np.arange(len(self.start)) + k <= last


def slices(texts: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of at most ``most`` bytes (one row at least).

    Yields (first row, end row, bytes, offsets); null rows have no bytes.
    """
    arr = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    n = len(arr)
    if not n:
        return
    arr = arr.cast(pa.large_string()).fill_null("")
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset:arr.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def words(buf: np.ndarray, at: np.ndarray, alphabet: Alphabet) -> Words:
    """Find the words of the rows ``at[i]:at[i + 1]`` of ``buf``."""
    n = len(buf)
    inside = np.zeros(n + 1, bool)
    np.logical_not(alphabet.sep[buf], out=inside[:n])
    begins = inside[:n].copy()
    begins[1:] &= ~inside[:n - 1]
    ends = inside[:n].copy()
    ends[:-1] &= ~inside[1:n]
    edge = np.unique(at)
    first = edge[edge < n]
    begins[first] = inside[first]
    last = edge[edge > 0] - 1
    ends[last] = inside[last]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return Words(buf, at, start, end, np.searchsorted(start, at).astype(np.int64), alphabet)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k hashes (n - k + 1 of them, none if fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _GRAM
        out += h[j:j + n]
    return mix64(out)


def whole(h: np.ndarray) -> np.uint64:
    """Hash of one whole run of hashes, equal to ``grams(h, len(h))[0]``."""
    return grams(h, len(h))[0]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the (leftmost) minimum of every run of w values."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = x[:n].copy(), np.arange(n)
    for j in range(1, w):
        less = x[j:j + n] < best
        np.copyto(best, x[j:j + n], where=less)
        at[less] = np.flatnonzero(less) + j
    return at

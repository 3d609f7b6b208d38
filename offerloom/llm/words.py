"""Words of whole Arrow string columns, found and hashed without a loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import offsets_of

_U = np.uint64
#: Bytes whose words are hashed in one vectorised step.
HASH_BYTES = 1 << 18
#: Words whose windows are hashed in one vectorised step.
WINDOW_WORDS = 1 << 16


def _table(separators, lower: bool) -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    out[list(separators)] = 32
    return out


#: Words of `[^\x20\x09-\x0D]+`, as they are or with A-Z in lower case.
SPACED = _table(range(9, 14), lower=False)
SPACED_LOWER = _table(range(9, 14), lower=True)
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM_LOWER = _table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)


@dataclass
class Words:
    """buf: the mapped bytes of all texts; start, end: of each word in buf; doc: its row; first: the first word of each row,
    with the total at the end.
    """

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of random byte values, mixed. Made in blocks of bounded bytes, for what is
        needed meanwhile is many times a block (one longer word is still taken whole).
        """
        out = np.empty(len(self.start), _U)
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(self.end, self.start[lo] + HASH_BYTES, side="right")))
            out[lo:hi] = self._hashed(self.start[lo:hi], self.end[lo:hi])
            lo = hi
        return out

    def _hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Those of consecutive words."""
        buf = self.buf[start[0] : end[-1]]
        inside = np.flatnonzero(buf != 32)
        sizes = end - start
        begins = np.cumsum(sizes) - sizes
        at = np.arange(len(inside)) - np.repeat(begins, sizes)
        terms = _BYTES[buf[inside]]
        terms *= powers(int(sizes.max()))[at]
        return mixed(np.add.reduceat(terms, begins) + sizes.astype(_U) * _U(0x9E3779B97F4A7C15))


def words(texts: pa.Array, table: np.ndarray) -> Words:
    ends = offsets_of(texts)
    n = len(texts)
    data = texts.buffers()[2] if n else None
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    buf = table[raw]
    word = buf != 32
    begins, stops = word.copy(), word.copy()
    if len(buf):
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        edge = np.unique(ends[(ends > 0) & (ends < len(buf))])
        begins[edge] |= word[edge]
        stops[edge - 1] |= word[edge - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(stops) + 1
    first = np.searchsorted(start, ends)
    doc = np.repeat(np.arange(n), np.diff(first)) if n else np.zeros(0, np.int64)
    return Words(buf, start, end, doc, first)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def powers(n: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """base to the powers 0 .. n - 1, modulo 2 to the 64."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[_U(1)], np.full(max(n - 1, 0), _U(base))]), dtype=_U)


_BYTES = mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def window_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp: (starts, hashes) of every `width` consecutive words within one row.

    A prefix sum of hash times inverse power gives each window by one subtraction and one
    multiplication, modulo 2 to the 64; the base is odd, so it has an inverse. Powers cancel but for those within the window,
    so rows are taken in blocks of bounded words (one longer row whole) and give what they gave together.
    """
    room = np.maximum(np.diff(first) - width + 1, 0)
    edge = np.concatenate([[0], np.cumsum(room)])
    starts, out = np.empty(edge[-1], np.int64), np.empty(edge[-1], _U)
    lo = 0
    while lo < len(room):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + WINDOW_WORDS, side="right")) - 1)
        a, b = edge[lo], edge[hi]
        if b > a:
            here = np.arange(a, b) - np.repeat(edge[lo:hi] - (first[lo:hi] - first[lo]), room[lo:hi])
            starts[a:b] = here + first[lo]
            out[a:b] = _windows(hashes[first[lo] : first[hi]], here, width)
        lo = hi
    return starts, out


def _windows(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    n = len(hashes)
    base = 0xD1342543DE82EF95
    with np.errstate(over="ignore"):
        sums = np.concatenate([[_U(0)], np.cumsum(hashes * powers(n, pow(base, -1, 1 << 64)), dtype=_U)])
        return mixed((sums[starts + width] - sums[starts]) * powers(n, base)[starts])

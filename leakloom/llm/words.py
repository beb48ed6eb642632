"""Vectorised words and hashes of Arrow text columns, for kernels that run inside Spark tasks.

Words are maximal runs of bytes outside a separator set. All separator sets used here are ASCII, so
splitting the UTF-8 bytes gives the same words as splitting the characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is handled alone, whole.
SLICE_BYTES = 1 << 20
_U = np.uint64
# Multipliers of two independent polynomial hashes of a word's bytes, and of the hash of consecutive words.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_STEP = _U(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is False for bytes in the ranges (ends included) and True for word bytes."""
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Words between white space: everything but space and U+0009 to U+000D.
SPACED = separators((0x20, 0x20), (0x09, 0x0D))
#: Words of ASCII letters and digits and of all other characters beyond ASCII.
ALNUM = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser after which all bits of a 64-bit hash depend on all others."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, modulo 2 ** 64."""
    if base not in _powers or len(_powers[base][0]) < n:
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            grown = np.full(max(n, 1 << 16), x, _U)
            grown[0] = 1
            both.append(np.multiply.accumulate(grown))
        _powers[base] = tuple(both)
    return _powers[base][0][:n], _powers[base][1][:n]


@dataclass
class Words:
    """The words of some texts: bytes, where each word starts and ends, and where each text's words do."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # text i has words bounds[i]:bounds[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self, second: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; the second one is independent of the first."""
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, _U)
        power, inverse = _power(n + 1, _BASES[second])
        total = np.zeros(n + 1, _U)
        np.cumsum((self.data.astype(_U) + _U(1)) * power[:n], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * inverse[self.starts]
        return mix(h ^ ((self.ends - self.starts).astype(_U) << _U(40)))

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")

    def text(self, first: int, last: int) -> list[str]:
        """Words first to last - 1."""
        return [self.word(i) for i in range(first, last)]


def slices(column: pa.Array, table: np.ndarray, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) for consecutive rows of about SLICE_BYTES; a null text has no words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, "right")) - 1)
        part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        yield low, high, _split(_LOWER[part] if lower else part, at, table)
        low = high


def _split(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> Words:
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(data, empty, empty, np.zeros(len(at), np.int64))
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < n]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = at[1:][at[1:] > 0] - 1
    last[edge] = inside[edge]
    starts = np.flatnonzero(first)
    return Words(data, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at))


def grams(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words at each word, and which of them lie within one text."""
    n = len(h)
    out, inside = np.zeros(n, _U), np.zeros(n, bool)
    if n >= k:
        total = np.zeros(n - k + 1, _U)
        for j in range(k):
            total = total * _STEP + h[j : n - k + 1 + j]
        out[: n - k + 1] = mix(total)
        room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
        inside = room >= k
    return out, inside


def whole(h: np.ndarray, first: int, last: int) -> np.uint64:
    """The hash that grams() gives for exactly the words first to last - 1."""
    total = np.zeros(1, _U)
    for x in h[first:last]:
        total = total * _STEP + x
    return mix(total)[0]

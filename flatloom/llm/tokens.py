"""Words of whole texts as numpy arrays, straight from Arrow's bytes.

A batch of texts is one byte array, so lower-casing, splitting and hashing are array
operations over all of them; there is no Python loop over words or documents. Slices of
about a megabyte keep the working memory small whatever the batch size; a longer text is a
slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
HASH_BYTES = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_table(separators: set[int]) -> np.ndarray:
    """Code of each byte: 0 for separators, else the byte with A-Z lowered, plus one."""
    codes = np.arange(256, dtype=np.uint16)
    codes[65:91] += 32
    codes += 1
    codes[list(separators)] = 0
    return codes


#: Words are runs of anything but the space and the bytes 09 to 0D.
SPACED = byte_table({0x20, *range(0x09, 0x0E)})
#: Words are runs of ASCII digits, letters and non-ASCII characters.
ALNUM = byte_table({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, HASH_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, base, dtype=_U)
            factors[0] = 1
            _tables[name] = np.multiply.accumulate(factors)
    return _tables["up"], _tables["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


@dataclass
class Words:
    """Words of the texts `lo` to `hi` of a batch.

    `first[i]` is the number of the first word of text `lo + i`, `first[-1]` the number of words;
    `start` and `end` are byte places in `data`, `hash` 64 bits of each lowered word.
    """

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    codes: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))

    def normal(self, a: int, b: int) -> bytes:
        """Lowered words a to b, joined by one space."""
        parts = [(self.codes[self.data[self.start[i] : self.end[i]]] - 1).astype(np.uint8).tobytes() for i in range(a, b)]
        return b" ".join(parts)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the place of each text; null is empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32) if places else np.zeros(1, np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def _hashes(data: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), dtype=_U)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + HASH_BYTES, side="right")))
        base, stop = start[a], end[b - 1]
        up, down = _powers(int(stop - base))
        products = codes[data[base:stop]] * up[: stop - base]
        local = start[a:b] - base
        out[a:b] = np.add.reduceat(products, local) * down[local]
        a = b
    return mix(out + (end - start).astype(_U))


def word_slices(column: pa.Array, codes: np.ndarray) -> Iterator[Words]:
    """The words of all texts of a column, in slices of about a megabyte."""
    data, offsets = utf8(column)
    n, lo = len(column), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1)
        hi = min(hi, n)
        begin, stop = offsets[lo], offsets[hi]
        own = data[begin:stop]
        places = offsets[lo : hi + 1] - begin
        inside = codes[own] > 0
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        heads = places[:-1][places[:-1] < places[1:]]
        opens[heads] = inside[heads]
        tails = places[1:][places[:-1] < places[1:]] - 1
        closes[tails] = inside[tails]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        first = np.searchsorted(start, places)
        wide = codes.astype(_U)
        yield Words(lo, hi, own, places, first, start, end, _hashes(own, wide, start, end), codes)
        lo = hi


_STEP = _U(0x9FB21C651E98DF25)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """64 bits for each run of n words, whatever text they lie in."""
    if len(hashes) < n:
        return np.zeros(0, dtype=_U)
    out = np.zeros(len(hashes) - n + 1, dtype=_U)
    for i in range(n):
        out = out * _STEP + hashes[i : len(hashes) - n + 1 + i]
    return mix(out + _U(n))


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Word numbers at which a run of n words lies within one text."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    if not counts.sum():
        return np.zeros(0, dtype=np.int64)
    skipped = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(int(counts.sum())) + skipped

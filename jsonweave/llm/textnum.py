"""Words of whole text columns as NumPy arrays: boundaries and 64-bit hashes, many documents at a time.

A column's bytes are taken in slices of about a quarter of a megabyte (or one document, if longer), so memory is
bounded by the longest document. A word's hash is a polynomial over its bytes modulo 2**64 (its
byte values taken from a random table), read off prefix sums; both are seeded by constants.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
U = np.uint64
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(0, 2**64, 256, dtype=U)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_MUL, _STEP = U(0x9E3779B97F4A7C15), _rng.integers(0, 2**64, 64, dtype=U) | U(1)
_INV = U(pow(int(_MUL), -1, 2**64))
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        for k, base in enumerate((_MUL, _INV)):
            steps = np.full(size, base, U)
            steps[0] = U(1)
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of documents ``first`` to ``first + len(cut) - 2`` of a column.

    ``cut[i]:cut[i + 1]`` are document i's words; ``start``/``end`` are byte places in ``data``, and
    ``doc_at[i]`` is where document i begins there; ``hash`` has the words' hashes.
    """

    first: int
    data: np.ndarray
    doc_at: np.ndarray
    cut: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words that begin at each word; the last n - 1 places of a document are no grams."""
        if len(self.hash) < n:
            return np.zeros(0, U)
        size = len(self.hash) - n + 1
        out = np.zeros(size, U)
        for k in range(n):
            out += self.hash[k : k + size] * _STEP[k]
        return mix(out)


def column_words(column: pa.Array, fold: bool = False) -> Iterator[Words]:
    """Words of a string column; null is an empty text. ``fold``: A-Z count as a-z."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    whole = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        data, at = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        blank = BLANK[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        ink = ~blank
        start = np.flatnonzero(ink & (np.concatenate(([True], blank[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
        end = np.flatnonzero(ink & (np.concatenate((blank[1:], [True])) | edge[1:])) + 1 if len(data) else start
        power, inverse = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, U)
        np.cumsum((_FOLD if fold else _BYTE)[data] * power[: len(data)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U))
        yield Words(i, data, at, np.searchsorted(start, at), start, end, h)
        i = j

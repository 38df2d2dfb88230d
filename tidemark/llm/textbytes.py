"""Vectorised work on the UTF-8 bytes of a text column, one bounded slice at a time.

A slice holds whole texts, concatenated.  A null text is an empty text.  A slice ends
once it has ``SLICE`` bytes or ``MOST_TEXTS`` texts, so a text longer than that is a slice of its own and the
memory of a task is bounded by the longest text, not by the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
MOST_TEXTS = 1 << 15
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_powers = np.ones(1, dtype=U64)
_inverse = np.ones(1, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Numbers of bytes: as they are, with A-Z lower-cased, and another choice for a second hash.
CODES = {"as is": BYTE_CODE, "lower": BYTE_CODE[LOWER], "second": mix(BYTE_CODE ^ U64(0x2545F4914F6CDD1D))}
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of [^\x20\x09-\x0D]: everything but blanks.
NOT_SPACE = ~SPACE
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, SLICE + 1)
        steps = np.full(size, U64(_BASE))
        back = np.full(size, U64(pow(_BASE, -1, 1 << 64)))
        steps[0] = back[0] = 1
        _powers, _inverse = np.cumprod(steps, dtype=U64), np.cumprod(back, dtype=U64)
    return _powers[:n], _inverse[:n]


class Texts:
    """A slice: its bytes, and where each text begins and ends in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1
        self._sums: dict[str, np.ndarray] = {}

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def sums(self, codes: str = "as is") -> np.ndarray:
        """Prefix sums that ``span_hash`` takes differences of."""
        if codes not in self._sums:
            powers, _ = _power_tables(len(self.data) + 1)
            out = np.zeros(len(self.data) + 1, dtype=U64)
            np.cumsum(CODES[codes][self.data] * powers[:-1], out=out[1:])
            self._sums[codes] = out
        return self._sums[codes]

    def span_hash(self, start: np.ndarray, end: np.ndarray, codes: str = "as is") -> np.ndarray:
        """64-bit hashes of byte spans, a function of their content alone."""
        sums = self.sums(codes)
        _, inverse = _power_tables(len(self.data) + 1)
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64))

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes marked in ``inside`` (a table by byte): starts, ends, runs per text."""
        if not len(self.data):
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(self.n, dtype=np.int64)
        mask = inside[self.data]
        edge = self.offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(mask))]
        begins = mask.copy()
        begins[1:] &= ~mask[:-1]
        begins[edge] = mask[edge]
        ends = mask.copy()
        ends[:-1] &= ~mask[1:]
        ends[edge - 1] = mask[edge - 1]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(starts, self.offsets))


def string_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(column, limit: int = SLICE) -> Iterator[Texts]:
    """Cut an Arrow string column into slices of whole texts."""
    data, offsets = string_parts(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), n, low + MOST_TEXTS)
        yield Texts(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], low)
        low = high


def owners(counts: np.ndarray) -> np.ndarray:
    """The index of the owner of each item, for so many items each."""
    return np.repeat(np.arange(len(counts)), counts)


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each ``n`` codes in a row."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=U64)
    out = codes[:size].copy()
    for k in range(1, n):
        out *= U64(_BASE)
        out += codes[k:k + size]
    return mix(out)


def grams_at(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``grams(codes, n)[at]``, computed there only."""
    out = codes[at]
    for k in range(1, n):
        out = out * U64(_BASE) + codes[at + k]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def depth(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the spans cover each of ``n`` places."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(step[:n])

"""Vectorised helpers on UTF-8 texts inside Spark tasks: one byte array per Arrow batch, no Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial hash modulo 2**64, and its inverse.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text handled at once in a task; a longer single text is handled alone. Arrays on it take some fifty times as much.
SLICE_BYTES = 1 << 20
#: Powers that a worker keeps: those for the largest blocks of texts that are hashed again and again.
POWERS = 4 << 20
#: Bytes whose words are hashed at once.
HASHED = 1 << 17

_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _table(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


#: Letters, digits and every byte above ASCII.
WORD = _table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Everything but white space of ASCII.
NONSPACE = _table(lambda b: not (b == 32 or 9 <= b <= 13))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; as many as a block of texts needs are kept by the worker."""
    have = _powers.get(int(base))
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16) if n >= POWERS else max(1 << n.bit_length(), 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= POWERS:
            _powers[int(base)] = have
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any ranges of a sequence of integers, each in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, max(n - 1, 0))[:n], out=self.sums[1:])
        self.back = powers(INVERSE, n)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Of all windows of that width, by their start; empty if the sequence is shorter."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.back[:n] + np.uint64(width))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rolling's hashes of ranges that follow each other, over HASHED bytes at a time, whole ranges at least, so that sums and powers stay in the cache."""
    out, at = np.zeros(len(start), dtype=np.uint64), 0
    while at < len(start):
        upto = int(np.searchsorted(start, start[at] + HASHED))
        own = slice(at, upto)
        out[own] = Rolling(data[start[at] : end[upto - 1]]).ranges(start[own] - start[at], end[own] - start[at])
        at = upto
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (null: empty) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Table, text: str, limit: int = SLICE_BYTES) -> Iterator:
    """The batch in runs of rows with about `limit` bytes of text, at least one row each."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def tokens(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of a kind within rows, and each row's first token (with a last entry)."""
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = kind[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:]
    end = np.zeros(n + 1, dtype=bool)
    end[1:] = inside[:-1] & (~inside[1:] | cut[1:])
    starts, ends = np.flatnonzero(start[:n]), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, offsets)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from each row's first item (with a last entry)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by its start."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def lookup(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted values among sorted distinct ones, -1 where absent."""
    if not len(sorted_values):
        return np.full(len(wanted), -1)
    at = np.searchsorted(sorted_values, wanted)
    at[at == len(sorted_values)] = 0
    return np.where(sorted_values[at] == wanted, at, -1)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i] .. first[i] + count[i] - 1 for every i, one after another."""
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count, count) + np.repeat(first, count)

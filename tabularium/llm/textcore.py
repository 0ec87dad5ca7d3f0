"""Vectorised text kernels shared by the corpus operators.

Everything here works on the UTF-8 bytes of an Arrow string column, a slice of
documents at a time, so that a task's memory is bounded by ``SLICE_BYTES`` (or
by one document, if that is longer) and no Python object is made per word.

Words are maximal runs of bytes other than ASCII white space (space, tab to
carriage return); A-Z is lower-cased before hashing.  Nulls count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_RNG = np.random.default_rng(0x7AB1)
_BASE = np.uint64(0x9E3779B97F4A7C13 // 8 * 8 + 3)  # 3 mod 8: few trailing zeros in BASE**d - 1
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))

WS = np.zeros(256, bool)
WS[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EXACT = _VALUE.copy()
_VALUE = _VALUE[LOWER]
_VALUE[WS] = 0

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 8 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


_held: list[tuple[Hashable, Any]] = []


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker process keeps between tasks, one thing at most: that of another key is let go first."""
    if not _held or _held[0][0] != key:
        release()
        _held.append((key, make()))
    return _held[0][1]


def release() -> None:
    """For tasks that keep nothing: lets go what earlier ones of this process have kept."""
    if _held:
        _held.clear()
        trim()


def trim() -> None:
    """Gives memory that is free within this process back to the machine."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a worker process that stays for other tasks: it keeps no free memory at the end of one."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with full avalanche, in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets within those bytes) of consecutive rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of all words, and each row's first word's number (one more than rows)."""
    inside = ~WS[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    starts[cut] = inside[cut]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = inside
    ends[1:-1] &= starts[1:] | ~inside[1:]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word, and each row's first word's number (one more than rows)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends, first = word_bounds(data, offsets)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_VALUE[data], _power("up", _BASE, len(data)), out=sums[1:])
    np.cumsum(sums, out=sums)
    return mix64((sums[ends] - sums[starts]) * _power("down", _INV, len(data))[starts]), first


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, as they are."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_EXACT[data], _power("up", _BASE, len(data)), out=sums[1:])
    np.cumsum(sums, out=sums)
    return mix64((sums[ends] - sums[starts]) * _power("down", _INV, len(data))[starts])


def shingles(words: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's sorted distinct n-word shingles as hashes, and the row offsets; a row with fewer words has one, of all its words."""
    rows, total = len(first) - 1, len(words)
    rolled = np.zeros(total, np.uint64)
    for j in range(n):
        factor = np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
        if total > j:
            rolled[: total - j] += words[j:] * factor
    mix64(rolled)
    counts = np.diff(first)
    keep = np.ones(total, bool)
    for i in np.flatnonzero(counts < n):
        a, b = int(first[i]), int(first[i + 1])
        if b > a:
            value = np.uint64(b - a)
            for h in words[a:b]:
                value = mix64(np.array([(int(value) * 0xD6E8FEB86659FD93 + int(h)) & (1 << 64) - 1], np.uint64))[0]
            rolled[a] = value
            keep[a + 1 : b] = False
    long = first[1:][counts >= n]
    for j in range(1, n):
        keep[long - j] = False
    rolled = rolled[keep]
    size = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.zeros(rows + 1, np.int64)
    np.cumsum(size, out=at[1:])
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a > 1:
            rolled[a:b].sort()
    fresh = np.ones(len(rolled), bool)
    fresh[1:] = rolled[1:] != rolled[:-1]
    fresh[at[:-1][size > 0]] = True
    out = np.zeros(rows + 1, np.int64)
    summed = np.zeros(len(rolled) + 1, np.int64)
    np.cumsum(fresh, out=summed[1:])
    out[:] = summed[at]
    return rolled[fresh], out


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))

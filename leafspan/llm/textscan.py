"""Vectorised scans over the UTF-8 bytes of Arrow string columns.

Everything here works on whole texts, a bounded number of bytes at a time
(``blocks``), without creating a Python object per word.  Hashes are 64-bit
polynomials over random byte values, finished with a mixer; equal strings give
equal hashes on every machine and in every session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

#: Bytes that part words: blank and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[: offsets[-1]] if data else np.zeros(0, np.uint8), offsets


def blocks(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``size`` bytes, or one row with more."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], by content and length."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and how many words each row has; words never cross rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~breaks[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def word_hashes(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and words per row, of rows whose bytes are ``data`` from offsets[0] = 0 on."""
    start, end, counts = words(data, offsets, breaks)
    return span_hash(prefix(LOWER[data] if lower else data), start, end), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words and runs per row; a row with fewer words has one run, of all of them."""
    ends = np.cumsum(counts)
    runs = np.where(counts == 0, 0, np.maximum(1, counts - k + 1))
    row = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(ends - counts, runs)
    length = np.minimum(counts, k)[row]
    out = length.astype(U64)
    for j in range(k):
        use = length > j
        out = np.where(use, mix(out * U64(0x2545F4914F6CDD1D) + hashes[np.where(use, at + j, 0)]), out) if len(hashes) else out
    return out, runs


def bytes_slice(data: np.ndarray, offsets: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows at..to of a column, with offsets from 0."""
    return data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]

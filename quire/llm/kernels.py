"""Vectorised text kernels over Arrow string columns, shared by the operators of this subpackage.

All kernels see the raw UTF-8 bytes of many texts at once. A null text counts as empty.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; bounds the memory of a Python worker whatever the batch holds (one text is never split).
CHUNK_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240501)
_BYTE_VALUE = _rng.integers(1, 2**63 - 1, 256, dtype=np.int64).astype(U64)
_WINDOW = (_rng.integers(1, 2**63 - 1, 64, dtype=np.int64).astype(U64) << U64(1)) | U64(1)
_powers: list[np.ndarray] = []


def space_table() -> np.ndarray:
    """True for bytes of a word, where words are runs outside U+0009-U+000D and U+0020."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def alnum_table() -> np.ndarray:
    """True for a-z, 0-9 and every byte of a non-ASCII character."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


SPACE_WORDS, ALNUM_WORDS = space_table(), alnum_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES):
    """Yields (first row, last row, bytes, offsets) with at most `limit` bytes each, or one longer text; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, to, data[offs[row] : offs[to]], offs[row : to + 1] - offs[row]
        row = to


def parts(batches, rows: int = 512):
    """The batches of a task in slices of a few rows, so that no output is gathered for long; then gives memory back.

    A worker process lives on between tasks, and the executor's memory has to hold for what comes next.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only with the GNU library
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray = SPACE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more entry at the end)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offs)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size, tables = max(n, CHUNK_BYTES + 1), []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, U64(base))
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if size > 2 * CHUNK_BYTES:  # one very long text: not kept
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    up, down = _power_table(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` consecutive items; the caller drops those that cross texts."""
    if len(h) < size:
        return np.zeros(0, U64)
    out = np.full(len(h) - size + 1, U64(size))
    for k in range(size):
        out += h[k : k + len(out)] * _WINDOW[k]
    return mix(out)


def shingles(data: np.ndarray, offs: np.ndarray, size: int = 5, table: np.ndarray = SPACE_WORDS):
    """Yields for each text the ascending distinct hashes of its shingles of `size` words, A-Z lower-cased; a shorter text is one shingle."""
    data = LOWER[data]
    starts, ends, first = words(data, offs, table)
    h = word_hashes(data, starts, ends)
    w = window_hashes(h, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(w[a : b - size + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif b > a:
            yield window_hashes(h[a:b], b - a)
        else:
            yield np.zeros(0, U64)

"""Vectorised reading of UTF-8 text: slices of Arrow columns as flat byte arrays, word spans and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=U) | U(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {_BASE: np.ones(1, U), _BASE_INV: np.ones(1, U)}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        size = max(n, 1 << 16)
        a = np.full(size, base, U)
        a[0] = 1
        have = _powers[base] = np.multiply.accumulate(a)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(col: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows that hold about `most` bytes; null counts as empty.

    A text is never cut: one that is longer makes a slice of its own."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if not len(col):
        return
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b, flat[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial sums, modulo 2**64, so that a span's hash needs two of them."""
    c = np.zeros(len(buf) + 1, U)
    np.cumsum(_BYTE[buf] * _power(_BASE, len(buf)), out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((c[end] - c[start]) * _power(_BASE_INV, len(c))[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def window_hash(c: np.ndarray, size: int) -> np.ndarray:
    """Hash of the window of `size` bytes at each start; windows at offsets that run over a text's end are the caller's to mask."""
    n = len(c) - size
    if n <= 0:
        return np.zeros(0, U)
    return mix((c[size:] - c[:-size]) * _power(_BASE_INV, len(c))[:n])


def word_spans(buf: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and each text's place among them (len(off) offsets)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~gap[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word
    last = last.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    s = np.flatnonzero(first)
    e = np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


def batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, cols[f.name]) for f in schema)], schema=schema)

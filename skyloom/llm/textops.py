"""Vectorised byte and word primitives over Arrow string columns.

A batch of texts is handled as one UTF-8 buffer with row offsets, so NumPy works
on megabytes at a time and never row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Odd base of the polynomial hash; its inverse modulo 2**64 is derived from it.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string or binary column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    bytes_ = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return bytes_, offsets - first


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """Send texts to Python in batches of at most ``most`` bytes, so that workers stay small.

    This is a setting of the session, in force when its plans run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of ``text`` (or a single row)."""
    for batch in batches:
        _, offsets = utf8(batch.column(text))
        at, n = 0, batch.num_rows
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), n)
            yield batch.slice(at, end - at)
            at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, base: int) -> np.ndarray:
    """The first ``n`` powers, from a table that is kept for the usual sizes."""
    return _powers(max(1 << 20, 1 << (n - 1).bit_length() if n > 1 else 1), base)[:n]


class RangeHash:
    """Hashes of any ranges of a sequence of 64-bit symbols, from prefix sums."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * powers(n, BASE), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ``[start, end)``; equal contents give equal hashes anywhere."""
        return (self.sums[end] - self.sums[start]) * powers(len(self.sums), INVERSE)[start]

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all ranges of ``width`` symbols."""
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * powers(n, INVERSE)


@lru_cache(maxsize=8)
def byte_symbols(seed: int) -> np.ndarray:
    """A random odd 64-bit symbol for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1)) | np.uint64(1)


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of each row's first word.

    ``is_word`` says for each byte value whether it belongs to words; words do
    not cross rows.
    """
    inside = is_word[data]
    edge = np.empty(len(data) + 1, bool)
    edge[-1] = True
    edge[0] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    runs = inside[at[:-1]] if len(at) > 1 else np.zeros(0, bool)
    starts, ends = at[:-1][runs], at[1:][runs]
    return starts, ends, np.searchsorted(starts, offsets)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in a constant number of passes."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..counts[0]-1, 0..counts[1]-1, ... in one array."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - counts, counts)

"""Content-defined anchors of fixed-length windows.

To find windows that occur more than once, each window is assigned the smallest
hash among its grams (its anchor).  Equal windows have equal anchors at the same
place, so only windows whose anchor hash occurs elsewhere can be repeated.
Consecutive windows that share an anchor occurrence form one *run*: one row for
many windows, identified by the anchor's hash and a 128-bit XXH3 of the bytes of
its content.  The anchors' polynomial hashes only bring equal windows together;
they never decide that two contents are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops
from .scratch import Scratch
from .textops import RangeHash, mix, sliding_min


@dataclass(frozen=True)
class Units:
    """Units (bytes or words) of several texts laid end to end.

    ``first`` has the index of each text's first unit and, last, their number;
    ``bounds`` gives the bytes of ``data`` from the start of unit ``begin`` to the
    end of unit ``end - 1``.
    """

    data: bytes | np.ndarray
    symbols: np.ndarray
    first: np.ndarray
    bounds: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


#: Reads the bytes of texts laid end to end, with their offsets, as units.
Reader = Callable[[np.ndarray, np.ndarray], Units]
#: A content: its anchor and content hash, its text's id, windows, the anchor's distance,
#: whether it occurs once, and its bytes.
ITEMS = "x_k long, x_h binary, x_id long, x_n int, x_a int, x_once boolean, x_bytes binary"
ITEM_NAMES = ["x_k", "x_h", "x_id", "x_n", "x_a", "x_once", "x_bytes"]
#: A part of an item also names the item it was split from and its first window there.
PARTS = ITEMS + ", x_whole_k long, x_whole_h binary, x_off int"
PART_NAMES = [*ITEM_NAMES, "x_whole_k", "x_whole_h", "x_off"]
#: A run's row: its text's row and id, first start, windows, anchor and content hash,
#: the anchor's distance, and the other starts of the same content in the same text.
RUNS = "x_rid binary, x_id long, x_s int, x_n int, x_k long, x_h binary, x_a int, x_more array<int>"
RUN_NAMES = ["x_rid", "x_id", "x_s", "x_n", "x_k", "x_h", "x_a", "x_more"]

#: Bits of the anchor value that hold the gram's place, to find the leftmost of equal grams.
PLACE_BITS = 24


def anchor_runs(symbols: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor occurrence, for all rows of a piece.

    ``symbols`` are 64-bit values of the rows' units laid end to end, fewer than
    ``2**PLACE_BITS``.  Returns the row, first start (in the row), number of
    windows, anchor hash and the anchor's distance from the first start, one entry
    for each run.
    """
    n = len(symbols)
    if n >= 1 << PLACE_BITS:
        raise ValueError("a piece is too long; lower its byte limit")
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    grams = mix(RangeHash(symbols).windows(gram))
    places = np.uint64((1 << PLACE_BITS) - 1)
    ranked = (grams & ~places) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(ranked, window - gram + 1)
    lengths = np.diff(offsets)
    rows = np.flatnonzero(lengths >= window)
    valid = np.zeros(n + 1, np.int8)
    np.add.at(valid, offsets[rows], 1)
    np.add.at(valid, offsets[rows + 1] - window + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8)[: len(least)].astype(bool)
    new = valid.copy()
    new[1:] &= least[1:] != least[:-1]
    new[offsets[rows]] = True
    start = np.flatnonzero(new)
    row = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(np.append(start[1:], n), offsets[row + 1] - window + 1)
    place = (least[start] & places).astype(np.int64)
    return row, start - offsets[row], end - start, grams[place], place - start


def row_id(id_col: str, text_col: str) -> Column:
    """128 bits of the SHA-256 of id and text: tells rows apart even if ids repeat or are null."""
    marks = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.when(F.col(id_col).isNull(), "n ").otherwise("i "), F.when(F.col(text_col).isNull(), "n").otherwise("t"))
    return F.substring(F.unhex(F.sha2(F.concat(marks, F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)), 1, 16)


def content_hashes(units: Units, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit XXH3 (as ``V16``) of the bytes of each range of units."""
    low, high = units.bounds(begin, end)
    data, digest = memoryview(units.data), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]), "V16")


def _binaries(hashes: np.ndarray) -> pa.Array:
    """A ``V16`` array as a binary column."""
    at = np.arange(len(hashes) + 1, dtype=np.int32) * 16
    return pa.BinaryArray.from_buffers(pa.binary(), len(hashes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(hashes).tobytes())])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _batch(piece: pa.RecordBatch, row: np.ndarray, s: np.ndarray, n: np.ndarray, k: np.ndarray, a: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    """Run rows; a content that a text repeats (as lines of junk do) is one row."""
    parts = h.view("<u8").reshape(-1, 2)
    order = np.lexsort((s, parts[:, 1], parts[:, 0], row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (parts[order][1:] != parts[order][:-1]).any(axis=1)
    first = order[new]
    at = np.cumsum(~new)[np.append(np.flatnonzero(new)[1:] - 1, len(order) - 1)] if len(order) else np.zeros(0, int)
    more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], at]).astype(np.int32)), pa.array(s[order[~new]].astype(np.int32)))
    owner = pa.array(row[first])
    s, n, a = (pa.array(x[first].astype(np.int32)) for x in (s, n, a))
    return pa.RecordBatch.from_arrays([piece.column("x_rid").take(owner), piece.column("x_id").take(owner), s, n, _signed(k[first]), _binaries(h[first]), a, more], RUN_NAMES)


def every_start(runs: DataFrame) -> DataFrame:
    """Runs with one row for each start again."""
    return runs.withColumn("x_s", F.explode(F.concat(F.array("x_s"), "x_more"))).drop("x_more")


def occurrences() -> Column:
    """How often a group of run rows occurs."""
    return F.sum(1 + F.size("x_more"))


def run_rows(rows: DataFrame, read: Reader, window: int, gram: int, piece_bytes: int) -> DataFrame:
    """Runs of all ``rows(x_rid, x_id, x_text)``: first start, windows, anchor and content hash.

    A text of more than twice ``piece_bytes`` units is read in segments that
    share all but one unit of a window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in textops.pieces(batches, "x_text", piece_bytes):
            units = read(*textops.utf8(piece.column("x_text")))
            n = len(units.symbols)
            if n <= 2 * piece_bytes:
                row, s, windows, k, a = anchor_runs(units.symbols, units.first, window, gram)
                begin = units.first[row] + s
                yield _batch(piece, row, s, windows, k, a, content_hashes(units, begin, begin + windows + window - 1))
                continue
            for low in range(0, n - window + 1, piece_bytes):
                part = units.symbols[low : low + piece_bytes + window - 1]
                row, s, windows, k, a = anchor_runs(part, np.array([0, len(part)]), window, gram)
                yield _batch(piece, row, s + low, windows, k, a, content_hashes(units, s + low, s + low + windows + window - 1))

    return rows.select("x_rid", "x_id", "x_text").mapInArrow(run, RUNS)


def cut_contents(rows: DataFrame, contents: DataFrame, read: Reader, window: int) -> DataFrame:
    """``ITEMS`` of the contents ``x_k, x_h, x_at{x_id, x_rid, x_s, x_n, x_a}, x_once``, cut out of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in textops.pieces(batches, "x_text", 1 << 19):
            units = read(*textops.utf8(piece.column("x_text")))
            lists = piece.column("x_list")
            listed, owner = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            begin = units.first[owner] + listed.field("x_s").to_numpy()
            low, high = units.bounds(begin, begin + listed.field("x_n").to_numpy() + window - 1)
            id_ = piece.column("x_id").take(pa.array(owner))
            columns = [listed.field("x_k"), listed.field("x_h"), id_, listed.field("x_n"), listed.field("x_a"), listed.field("x_once")]
            for at, stop in _stretches(high - low, 1 << 21):
                own = slice(at, stop)
                yield pa.RecordBatch.from_arrays([*(c[own] for c in columns), cut_out(units.data, low[own], high[own])], ITEM_NAMES)

    wanted = contents.select(F.col("x_at.x_rid").alias("x_rid"), F.struct("x_k", "x_h", "x_at.x_s", "x_at.x_n", "x_at.x_a", "x_once").alias("x_entry"))
    lists = wanted.groupBy("x_rid").agg(F.collect_list("x_entry").alias("x_list"))
    return rows.join(lists, "x_rid").select("x_id", "x_text", "x_list").mapInArrow(run, ITEMS)


def distinct_items(scratch: Scratch, items: DataFrame, contents: DataFrame) -> DataFrame:
    """One item for each content: rows that repeat id and text cut the same ones out again."""
    return items if items.count() <= contents.count() else scratch.write(items.dropDuplicates(["x_k", "x_h"]), "distinct_items")


def _stretches(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes sum up to about ``limit``."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, stop
        at = stop


def halve(items: DataFrame, read: Reader, window: int, span: int) -> DataFrame:
    """Items split at multiples of ``span`` of the distance from their anchor: ``PARTS``.

    The new key hashes the units that all windows of a part's block share, so
    equal windows stay together while the others fall apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in textops.pieces(batches, "x_bytes", 1 << 19):
            units = read(*textops.utf8(piece.column("x_bytes")))
            first = units.first
            ranged = RangeHash(units.symbols)
            n, a = (piece.column(x).to_numpy().astype(np.int64) for x in ("x_n", "x_a"))
            low = (a - n + 1) // span  # block of the last window, the nearest to the anchor
            blocks = a // span - low + 1
            of = np.repeat(np.arange(len(n)), blocks)
            block = low[of] + textops.ranges(blocks)
            anchor = first[of] + a[of]
            begin = np.maximum(first[of], anchor - (block + 1) * span + 1)
            last = np.minimum(first[of] + n[of] - 1, anchor - block * span)
            core = ranged.of(anchor - block * span, anchor - (block + 1) * span + 1 + window)
            key = mix(core + mix(block.astype(np.uint64) * np.uint64(2 * span + 1)))
            chosen = pa.array(of)
            id_, once, *whole = (piece.column(x).take(chosen) for x in ("x_id", "x_once", "x_k", "x_h"))
            ints = [pa.array(x.astype(np.int32)) for x in (begin - first[of], last - begin + 1, anchor - begin)]
            body = cut_out(units.data, *units.bounds(begin, last + window))
            columns = [_signed(key), _binaries(content_hashes(units, begin, last + window)), id_, ints[1], ints[2], once, body, *whole, ints[0]]
            yield pa.RecordBatch.from_arrays(columns, PART_NAMES)

    return items.select(*ITEM_NAMES).mapInArrow(run, PARTS)


def part_of_whole(spans: DataFrame, parts: DataFrame, *also: str) -> DataFrame:
    """Spans of parts as spans of the items they were split from; both agree in the columns ``also``, which parts carry as ``x_whole_*`` too."""
    names = ["x_k", "x_h", *also]
    own = parts.select(*names, *[f"x_whole_{x[2:]}" for x in names], "x_off").distinct()
    wholes = [F.col(f"x_whole_{x[2:]}").alias(x) for x in names]
    return spans.join(own, names).select(*wholes, (F.col("x_from") + F.col("x_off")).alias("x_from"), (F.col("x_to") + F.col("x_off")).alias("x_to"))


def split_hot(scratch: Scratch, items: DataFrame, hot: int, span: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Items whose key has at most ``hot`` of them, and the others if there are any.

    A key that is a single window has one item, so nothing is left to split there.
    """
    keys = scratch.write(items.groupBy("x_k").agg(F.count("*").alias("x_d")).where(F.col("x_d") > hot).select("x_k"), f"hot_{name}")
    if span <= 1 or keys.isEmpty():
        return items, None
    return items.join(keys, "x_k", "left_anti"), items.join(keys, "x_k", "left_semi")


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, body: str, limit: int) -> Iterator[pa.Table]:
    """Stretches of about ``limit`` bytes of ``body`` that end where ``key`` changes."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        ends = _offsets(batch.column(body))
        begin = 0
        for at in np.flatnonzero(np.concatenate([[last is not None and keys[0] != last], keys[1:] != keys[:-1]])):
            if size + ends[at] - ends[begin] >= limit:
                held.append(batch.slice(begin, at - begin))
                yield pa.Table.from_batches(held)
                held, size, begin = [], 0, at
        held.append(batch.slice(begin))
        size += ends[-1] - ends[begin]
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def _offsets(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_binary())
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


def bodies(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a binary column."""
    whole = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    at = _offsets(whole)
    return np.frombuffer(whole.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def cut_out(data: bytes | np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Ranges of ``data`` as a binary column."""
    at = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(end - begin, out=at[1:])
    seen = memoryview(data)
    body = b"".join([seen[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    return pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(body)])

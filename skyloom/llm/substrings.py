"""Exact substring deduplication with suffix arrays over shards of candidate runs.

1. Every text is read once; its windows of ``width`` bytes are grouped into runs
   by content-defined anchors (see ``windows``).  Only hashes leave this pass.
2. Anchors seen once cannot belong to a repeated window.  Counts are aggregated
   before the shuffle, so a passage in a third of all documents costs one row a
   task.
3. Of each distinct content of the other anchors one occurrence is cut out of its
   text and sent to the anchor's shard; a content that occurs again is laid into
   the shard's text twice.
4. Each shard, a bounded stretch of text, gets a suffix array by induced sorting
   and the permuted common prefixes of its neighbours; a start whose neighbour
   shares ``width`` bytes is repeated.  The spans found hold for all occurrences.
5. Anchors with more than ``hot`` distinct contents are not gathered.  Those
   contents are split by the distance from the anchor, so that a part's shared
   core becomes its key, again and again with half the span, down to single
   windows.

Rows are told apart by 128 bits of a hash of id and text, so ids may repeat or be
null; occurrences of one content by 128 bits of a hash of its bytes.

Edge cases: a null text is empty and a text shorter than the window has no
repeats; a row repeated in the table repeats all its windows; very long texts are
read in overlapping segments; an empty table gives an empty result; columns
other than the named ones pass through ``remove_repeats`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .scratch import Scratch
from .suffix import alternating, repeated_starts
from .windows import RUN_NAMES, Units, bodies, cut_contents, distinct_items, every_start, halve, occurrences, part_of_whole, row_id, run_rows, split_hot, whole_keys

GRAM = 32


def _read(data: np.ndarray, offsets: np.ndarray) -> Units:
    return Units(np.ascontiguousarray(data), textops.byte_symbols(5)[data], offsets, lambda begin, end: (begin, end))


def _shared(scratch: Scratch, runs: DataFrame) -> DataFrame:
    """Runs whose anchor occurs more than once.

    The anchors are written first: a join of two plain shuffles is one whose
    skewed partitions Spark can split.
    """
    anchors = scratch.write(runs.groupBy("x_k").agg(occurrences().alias("x_c")).where("x_c > 1").select("x_k"), "anchors")
    return runs.join(anchors, "x_k").select(*RUN_NAMES)


def _shard_spans(table: pa.Table, width: int) -> pa.RecordBatch:
    """Byte spans of the repeated windows of a shard's contents; those that occur again are laid out twice."""
    body, at = bodies(table.column("x_bytes"))
    length = np.diff(at)
    again = ~table.column("x_once").to_numpy()
    size = np.append(length, length[again])
    inside = alternating(size, np.ones(len(size), np.int64))
    text = np.full(len(inside) + 1, 255, np.uint8)
    symbols = np.minimum(body, 253) + np.uint8(1)
    text[:-1][inside] = np.append(symbols, symbols[np.repeat(again, length)])
    text[-1] = 0
    first = len(body) + len(length)  # the contents laid out once come before those laid out again
    marked = repeated_starts(text, width)[:first][inside[:first]]
    # only whole windows count: common prefixes may run across separators
    marked &= alternating(length - width + 1, np.full(len(length), width - 1))
    edge = np.diff(marked.astype(np.int8), prepend=0)
    edge[at[:-1][marked[at[:-1]]]] = 1
    begin = np.flatnonzero(edge == 1)
    owner = np.searchsorted(at, begin, "right") - 1
    # a run of marked starts ends where marks stop or the next content begins
    stop = np.flatnonzero(np.diff(marked.astype(np.int8), append=0) == -1) + 1
    end = np.minimum(stop[np.searchsorted(stop, begin, "right")] if len(begin) else begin, at[owner + 1])
    chosen = pa.array(owner)
    names = [table.column(x).combine_chunks().take(chosen) for x in ("x_k", "x_h")]
    ends = [pa.array(x.astype(np.int32)) for x in (begin - at[owner], end - at[owner] + width - 1)]
    return pa.RecordBatch.from_arrays([*names, *ends], ["x_k", "x_h", "x_from", "x_to"])


def _sorted_spans(items: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    """Spans found by the suffix arrays of all shards: ``x_k, x_h, x_from, x_to``.

    A partition is sorted by anchor and taken in stretches of whole anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in whole_keys(batches, "x_k", "x_bytes", shard_bytes):
            yield _shard_spans(shard, width)

    dealt = items.select("x_k", "x_h", "x_once", "x_bytes").repartition("x_k").sortWithinPartitions("x_k")
    return dealt.mapInArrow(run, "x_k long, x_h binary, x_from int, x_to int")


def _content_spans(scratch: Scratch, items: DataFrame, width: int, span: int, hot: int, shard_bytes: int) -> DataFrame:
    """Repeated spans of all items, as ``x_k, x_h, x_from, x_to``."""
    few, many = split_hot(scratch, items, hot, span, str(span))
    spans = _sorted_spans(few, width, shard_bytes)
    if many is None:
        return spans
    parts = scratch.write(halve(many, _read, width, span // 2), f"parts_{span}")
    one = F.min(F.struct("x_id", "x_n", "x_a", "x_bytes")).alias("x_one")
    known = scratch.write(parts.groupBy("x_k", "x_h").agg((F.min("x_once") & (F.count("*") == 1)).alias("x_once"), one), f"known_{span}")
    # a key with a single content that occurs once holds nothing repeated
    alone = known.groupBy("x_k").agg(F.count("*").alias("x_d"), F.min("x_once").alias("x_all")).where("x_d > 1 or not x_all").select("x_k")
    deeper = scratch.write(known.join(alone, "x_k").select("x_k", "x_h", "x_one.x_id", "x_one.x_n", "x_one.x_a", "x_once", "x_one.x_bytes"), f"items_{span}")
    inner = _content_spans(scratch, deeper, width, span // 2, hot, shard_bytes)
    return spans.unionByName(part_of_whole(inner, parts))


def repeated_spans(
    spark: SparkSession,
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 200,
    hot: int = 1500,
    shard_bytes: int = 3 << 19,
    piece_bytes: int = 1 << 19,
) -> DataFrame:
    """``x_rid binary, x_spans array<struct<x_from,x_to>>``: byte ranges, not yet merged.

    ``hot`` bounds the distinct contents of an anchor that one task gathers
    (about ``1.5 * width`` bytes each).
    """
    textops.bounded_batches(spark)
    scratch = Scratch(spark, "substrings")
    rows = documents.select(row_id(id_col, text_col).alias("x_rid"), F.lit(0).cast("long").alias("x_id"), F.col(text_col).alias("x_text"))
    runs = scratch.write(run_rows(rows, _read, width, GRAM, piece_bytes), "runs")
    shared = scratch.write(_shared(scratch, runs), "shared")
    scratch.drop("runs", "anchors")
    # one occurrence stands for all of a content
    one = F.min(F.struct("x_rid", "x_id", "x_s", "x_n", "x_a")).alias("x_at")
    contents = scratch.write(shared.groupBy("x_k", "x_h").agg((occurrences() == 1).alias("x_once"), one), "contents")
    items = distinct_items(scratch, scratch.write(cut_contents(rows, contents, _read, width), "items"), contents)
    found = scratch.write(_content_spans(scratch, items, width, 1 << (width - GRAM).bit_length(), hot, shard_bytes), "found")
    scratch.keep("shared", "found")
    placed = every_start(shared.join(found, ["x_k", "x_h"]))
    spans = placed.groupBy("x_rid").agg(F.collect_list(F.struct((F.col("x_s") + F.col("x_from")).alias("x_from"), (F.col("x_s") + F.col("x_to")).alias("x_to"))).alias("x_spans"))
    decided = scratch.write(spans, "spans")
    scratch.keep("spans")
    return decided


def merged(spans: list | None) -> list[tuple[int, int]]:
    """Maximal ranges of overlapping or adjacent ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["x_from"], x["x_to"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges without characters that they cover only in part."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def remove_repeats(spark: SparkSession, documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``documents`` with every byte of a repeated window cut out of ``text_col``.

    Characters of which a window covers only some bytes stay.
    """
    spans = repeated_spans(spark, documents, id_col=id_col, text_col=text_col, **options)
    names = documents.columns
    at = names.index(text_col)
    plain = [f"c{i}" for i in range(len(names))]  # extra columns may have any name
    keyed = documents.select(row_id(id_col, text_col).alias("x_rid"), *[F.col(f"`{c}`").alias(p) for c, p in zip(names, plain, strict=True)])
    keyed = keyed.join(spans.hint("merge"), "x_rid", "left").select(*plain, "x_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, own in zip(batch.column(at), batch.column(len(names)), strict=True):
                if (own := own.as_py()) is None:
                    texts.append(text.as_py())
                else:
                    data = text.as_py().encode()
                    texts.append(_kept(data, whole_characters(data, merged(own))).decode())
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return keyed.mapInArrow(run, documents.schema)


def digest(spark: SparkSession, documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans`` and the checksum of the remaining bytes, for each row."""
    spans = repeated_spans(spark, documents, id_col=id_col, text_col=text_col, **options)
    rows = documents.select(row_id(id_col, text_col).alias("x_rid"), F.col(id_col).cast("long").alias("x_id"), F.col(text_col).alias("x_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, text, own in zip(*batch.columns, strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                cuts = merged(own.as_py())
                out.append((id_.as_py(), len(data), sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(_kept(data, cuts)).hexdigest()))
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = rows.join(spans.hint("merge"), "x_rid", "left").select("x_id", "x_text", "x_spans")
    return joined.mapInArrow(run, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of all ``documents`` without their repeated 200-byte strings."""
    return digest(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Bytes as hexadecimal digits; pieces of 500 starts, each with the 199 bytes that follow, keep the slices short.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
pieces AS (SELECT doc_id, k * 500 AS b, substr(h, k * 1000 + 1, 1398) AS h FROM (SELECT doc_id, h, unnest(generate_series(0, CAST(length(h) AS BIGINT) // 1000)) AS k FROM d)),
bytes AS (SELECT doc_id, b + i AS p, h[2 * i + 1 : 2 * i + 2] AS byte, CASE WHEN length(h) >= 2 * i + 400 THEN md5(h[2 * i + 1 : 2 * i + 400]) END AS s
          FROM (SELECT doc_id, b, h, unnest(generate_series(0, least(length(h) // 2, 500) - 1)) AS i FROM pieces WHERE h <> '')),
f AS (SELECT s FROM bytes WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1),
covered AS (SELECT doc_id, p, byte, coalesce(p - max(CASE WHEN f.s IS NOT NULL THEN p END) OVER (PARTITION BY doc_id ORDER BY p) < 200, FALSE) AS gone FROM bytes LEFT JOIN f USING (s)),
spans AS (SELECT *, gone AND NOT lag(gone, 1, FALSE) OVER (PARTITION BY doc_id ORDER BY p) AS opens FROM covered),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS h FROM spans GROUP BY 1)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

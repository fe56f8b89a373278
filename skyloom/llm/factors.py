"""Substring deduplication by relative Lempel-Ziv parsing against earlier documents.

A window is ``width`` consecutive words.  A word is removed if some window that
covers it also starts in a document with a smaller id.

Windows are grouped into runs by content-defined anchors (see ``windows``).  Of
each distinct content of the anchors that documents with different ids hold, the
occurrence with the smallest id is cut out of its text and sent to the anchor's
shard; a content that a later document repeats is parsed there as well.  The
contents of a shard, bounded stretches of words, are the reference blocks: a
suffix array over all of them gives, for every start, the longest factor that
also starts in a block of a smaller id.  Each content is parsed greedily: a factor
of ``width`` words or more is a duplicate span, and the windows that straddle its
end are looked up before the next factor begins.  Words are compared as they
stand, by their place in the shard's dictionary, never by a hash.

Anchors with more than ``hot`` contents are split by the distance from the anchor
until they have fewer, or until a key is a single window.

Rows are told apart by 128 bits of a hash of id and text, occurrences of one
content by 128 bits of a hash of its words.

Edge cases: a null text has no words; fewer words than a window are never
removed; a null id counts as larger than any id; rows with equal ids do not
remove each other's words; an empty table gives an empty result; columns other
than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .scratch import Scratch
from .substrings import merged
from .suffix import nearest_smaller, permuted_common_prefixes, suffix_array
from .windows import RUN_NAMES, Units, cut_contents, distinct_items, every_start, halve, part_of_whole, row_id, run_rows, split_hot, whole_keys

GRAM = 8
LAST_ID = (1 << 63) - 1


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts, and the index of each text's first.

    ``bytes.split`` breaks at 0x20 and 0x09 to 0x0D only.
    """
    words = [t.split() for t in texts]
    return [w for own in words for w in own], np.cumsum([0, *map(len, words)])


def _dictionary(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each word's place among the distinct words, and these."""
    if not words:
        return np.zeros(0, np.int64), []
    encoded = pa.array(words, pa.binary()).dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_pylist()


def _read(data: np.ndarray, offsets: np.ndarray) -> Units:
    """Words of the texts, joined by single spaces."""
    whole = data.tobytes()
    words, first = split_words([whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
    place, distinct = _dictionary(words)
    symbols = np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64)[place]
    lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))[place]
    ends = np.cumsum(lengths + 1) - 1
    starts = np.append(ends - lengths, len(whole))
    return Units(b" ".join(words), symbols, first, lambda begin, end: (starts[begin], ends[end - 1]))


def _shared(scratch: Scratch, runs: DataFrame) -> DataFrame:
    """Runs whose anchor occurs in documents with different ids.

    The anchors are written first: a join of two plain shuffles is one whose
    skewed partitions Spark can split.
    """
    ids = runs.groupBy("x_k").agg(F.min("x_id").alias("x_first"), F.max("x_id").alias("x_last"))
    anchors = scratch.write(ids.where("x_first < x_last").select("x_k"), "anchors")
    return runs.join(anchors, "x_k").select(*RUN_NAMES)


def longest_factors(symbols: np.ndarray, end: np.ndarray, age: np.ndarray) -> np.ndarray:
    """For each position the longest prefix, up to ``end``, that also starts at a position of smaller ``age``.

    ``symbols`` are positive and the blocks are followed by separators (1).
    """
    n = len(symbols)
    text = np.append(symbols, 0)
    sa = suffix_array(text, int(symbols.max(initial=0)) + 1)
    cap = int((end - np.arange(n)).max(initial=1))
    common, _ = permuted_common_prefixes(text.astype(np.uint32), sa, cap)
    sa, common = sa[1:], common[sa[1:]]  # without the sentinel
    ages = age[sa]
    above = nearest_smaller(ages, common)
    below = nearest_smaller(ages[::-1], np.concatenate([[0], common[:0:-1]]) if n else common)
    best = np.zeros(n, np.int64)
    for at, shared in (above, [x[::-1] for x in below]):
        best = np.maximum(best, np.where(at >= 0, shared, 0))
    out = np.empty(n, np.int64)
    out[sa] = best
    return np.minimum(out, end - np.arange(n))


def parse(longest: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of at least ``width`` words of the blocks ``[begin, end)``: block, first word and the word after the last.

    A factor is followed by the windows across its end: the next one may begin
    ``width - 1`` words before it.
    """
    n = len(longest)
    starts = np.where(longest >= width, np.arange(n), n)
    following = np.append(np.minimum.accumulate(starts[::-1])[::-1], n)
    block, at, found = np.arange(len(begin)), begin.copy(), []
    while len(block):
        at = following[np.minimum(at, n)]
        inside = at < end[block]
        block, at = block[inside], at[inside]
        stop = at + longest[at]
        found.append((block, at, stop))
        at = stop - width + 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _parse_shard(table: pa.Table, width: int) -> pa.RecordBatch:
    """Duplicate factors of a shard's contents, at their smallest id and (``x_later``) where a later document repeats them."""
    words, first = split_words(table.column("x_bytes").to_pylist())
    place, _ = _dictionary(words)
    size = np.diff(first)
    _, age = np.unique(table.column("x_id").to_numpy(), return_inverse=True)
    again = np.flatnonzero(~table.column("x_once").to_numpy())
    content = np.concatenate([np.arange(len(size)), again])
    later = np.arange(len(content)) >= len(size)
    length = size[content]
    begin = np.cumsum(length + 1) - length - 1
    at = np.repeat(begin, length) + textops.ranges(length)
    total = int((length + 1).sum())
    symbols = np.ones(total, np.int64)
    symbols[at] = place[np.repeat(first[content], length) + textops.ranges(length)] + 2
    # a repetition is younger than its own document and older than the next
    ages = np.repeat(2 * age[content] + later, length + 1)
    longest = longest_factors(symbols, np.repeat(begin + length, length + 1), ages)
    block, low, high = parse(longest, begin, begin + length, width)
    chosen = pa.array(content[block])
    names = [table.column(x).combine_chunks().take(chosen) for x in ("x_k", "x_h")]
    ends = [pa.array(x.astype(np.int32)) for x in (low - begin[block], high - begin[block])]
    return pa.RecordBatch.from_arrays([*names, pa.array(later[block]), *ends], ["x_k", "x_h", "x_later", "x_from", "x_to"])


def _factors(items: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in whole_keys(batches, "x_k", "x_bytes", shard_bytes):
            yield _parse_shard(shard, width)

    dealt = items.select("x_k", "x_h", "x_id", "x_once", "x_bytes").repartition("x_k").sortWithinPartitions("x_k")
    return dealt.mapInArrow(run, "x_k long, x_h binary, x_later boolean, x_from int, x_to int")


def _content_spans(scratch: Scratch, items: DataFrame, width: int, span: int, hot: int, shard_bytes: int) -> DataFrame:
    """Duplicate spans of all items, as ``x_k, x_h, x_later, x_from, x_to``."""
    few, many = split_hot(scratch, items, hot, span, str(span))
    spans = _factors(few, width, shard_bytes)
    if many is None:
        return spans
    parts = scratch.write(halve(many, _read, width, span // 2), f"parts_{span}")
    one = F.min(F.struct("x_id", "x_n", "x_a", "x_bytes")).alias("x_one")
    known = scratch.write(parts.groupBy("x_k", "x_h").agg((F.min("x_once") & (F.min("x_id") == F.max("x_id"))).alias("x_once"), one), f"known_{span}")
    # a key with a single content that no later document repeats holds no duplicate
    alone = known.groupBy("x_k").agg(F.count("*").alias("x_d"), F.min("x_once").alias("x_all")).where("x_d > 1 or not x_all").select("x_k")
    deeper = scratch.write(known.join(alone, "x_k").select("x_k", "x_h", "x_one.x_id", "x_one.x_n", "x_one.x_a", "x_once", "x_one.x_bytes"), f"items_{span}")
    inner = _content_spans(scratch, deeper, width, span // 2, hot, shard_bytes)
    # an item is later than a part's first document if its own document is, or where it is a repetition
    whole = F.explode(F.when(F.col("x_once"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("x_whole_later")
    dated = parts.select("x_k", "x_h", "x_id", "x_whole_k", "x_whole_h", "x_off", whole).join(known.select("x_k", "x_h", F.col("x_one.x_id").alias("x_first")), ["x_k", "x_h"])
    dated = dated.select("x_k", "x_h", (F.col("x_whole_later") | (F.col("x_id") > F.col("x_first"))).alias("x_later"), "x_whole_k", "x_whole_h", "x_whole_later", "x_off")
    return spans.unionByName(part_of_whole(inner, dated, "x_later"))


def duplicate_spans(
    spark: SparkSession,
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 50,
    hot: int = 1500,
    shard_bytes: int = 1 << 20,
    piece_bytes: int = 1 << 19,
) -> DataFrame:
    """``x_rid binary, x_spans array<struct<x_from,x_to>>``: word ranges, not yet merged."""
    textops.bounded_batches(spark)
    scratch = Scratch(spark, "factors")
    rows = documents.select(row_id(id_col, text_col).alias("x_rid"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("x_id"), F.col(text_col).alias("x_text"))
    runs = scratch.write(run_rows(rows, _read, width, GRAM, piece_bytes), "runs")
    shared = scratch.write(_shared(scratch, runs), "shared")
    scratch.drop("runs", "anchors")
    contents = shared.groupBy("x_k", "x_h").agg((F.min("x_id") == F.max("x_id")).alias("x_once"), F.min(F.struct("x_id", "x_rid", "x_s", "x_n", "x_a")).alias("x_at"))
    contents = scratch.write(contents, "contents")
    items = distinct_items(scratch, scratch.write(cut_contents(rows, contents, _read, width), "items"), contents)
    factors = scratch.write(_content_spans(scratch, items, width, 1 << (width - GRAM).bit_length(), hot, shard_bytes), "factors")
    scratch.keep("shared", "contents", "factors")
    first = contents.select("x_k", "x_h", F.col("x_at.x_id").alias("x_first"))
    dated = factors.join(first, ["x_k", "x_h"])
    placed = every_start(shared.join(dated, ["x_k", "x_h"]).where("(x_id > x_first) = x_later"))
    spans = placed.groupBy("x_rid").agg(F.collect_list(F.struct((F.col("x_s") + F.col("x_from")).alias("x_from"), (F.col("x_s") + F.col("x_to")).alias("x_to"))).alias("x_spans"))
    decided = scratch.write(spans, "spans")
    scratch.keep("spans")
    return decided


def digest(spark: SparkSession, documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col, n_words, n_removed`` and the checksum of the kept words, for each row."""
    spans = duplicate_spans(spark, documents, id_col=id_col, text_col=text_col, **options)
    rows = documents.select(row_id(id_col, text_col).alias("x_rid"), F.col(id_col).cast("long").alias("x_id"), F.col(text_col).alias("x_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, text, own in zip(*batch.columns, strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                total = len(words)
                for a, b in reversed(merged(own.as_py())):
                    del words[a:b]
                out.append((id_.as_py(), total, total - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [id_col, "n_words", "n_removed", "kept_sha256"])

    joined = rows.join(spans.hint("merge"), "x_rid", "left").select("x_id", "x_text", "x_spans")
    return joined.mapInArrow(run, f"{id_col} long, n_words long, n_removed long, kept_sha256 string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of all ``documents`` without words of 50-word windows seen in earlier documents."""
    return digest(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every window as text, so that nothing rests on a hash.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, p, p AS hit FROM g JOIN f USING (s) WHERE doc_id > least),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
covered AS (SELECT doc_id, p, word, coalesce(p - max(hit) OVER (PARTITION BY doc_id ORDER BY p) < 50, FALSE) AS gone FROM words LEFT JOIN hits USING (doc_id, p)),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS s FROM covered GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

"""Benchmark decontamination: broadcast n-gram set, token-window scan, exact hits.

Only DataFrame functions run here.  A bitmap over three words of each benchmark
window (first, middle, last), sized by their count, lets the scan of the documents
turn only likely windows into rows.  Every such row is then joined on the window's
hash and its whole text, so a reported hit is exact.  The windows are broadcast
behind a check of their number; a larger set is shuffled, and with it only the
likely rows.

Edge cases: null, empty and word-free texts have no words and are clean; an empty
benchmark leaves every document clean; null item ids take no part; repeated
document rows are judged row by row; extra columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, without

UPPER = "".join(map(chr, range(0x41, 0x5B)))
#: ASCII that separates words once A-Z are lower-cased.
BREAKS = "".join(chr(c) for c in range(0x80) if not (0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A))


def normalised_words(text: Column) -> Column:
    """Words of lower-cased digits, letters a-z and non-ASCII characters."""
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + BREAKS, UPPER.lower() + " " * len(BREAKS))
    return F.array_remove(F.split(spaced, " "), "")


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """Distinct windows: ``w_len int, w_text string, w_items array<string>``."""
    words = benchmark.select(F.col(item_col).cast("string").alias("w_item"), normalised_words(F.col(text_col)).alias("w_words"))
    words = words.where(F.col("w_item").isNotNull() & (F.size("w_words") > 0))
    length = F.least(F.size("w_words"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("w_words") - length + 1)
    rows = words.select("w_item", length.alias("w_len"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w_words", i, length), " "))).alias("w_text"))
    return rows.groupBy("w_len", "w_text").agg(F.sort_array(F.collect_set("w_item")).alias("w_items"))


def _probe(words: Column, at: Column, length: int) -> Column:
    """Hash of three words of the window that starts at 1-based ``at``."""
    return F.xxhash64(F.get(words, at - 1), F.get(words, at - 1 + length // 2), F.get(words, at - 2 + length))


#: Bits of a bitmap at most (8 MB); beyond 16 bits a window more rows pass it and the join turns them away.
MOST_BITS = 26


def _bitmaps(windows: DataFrame, by_length: dict[int, int]) -> dict[int, tuple[Column, int]]:
    """For each window length a bitmap of the windows' probe hashes, as a literal array of longs."""
    out = {}
    for length, count in sorted(by_length.items()):
        log2 = min(MOST_BITS, max(12, (16 * count).bit_length()))
        slots = windows.where(F.col("w_len") == length).select(F.split("w_text", " ").alias("w")).select((_probe(F.col("w"), F.lit(1), length).bitwiseAND((1 << log2) - 1)).alias("slot")).distinct()
        longs = [0] * (1 << (log2 - 6))
        for row in slots.toLocalIterator():
            longs[row.slot >> 6] |= 1 << (row.slot & 63)
        signed = ",".join(str(x - (1 << 64) if x >> 63 else x) for x in longs)
        out[length] = (F.split(F.lit(signed), ",").cast("array<bigint>"), log2)
    return out


def _likely(words: Column, length: int, bits: Column, log2: int):
    """Whether the bitmap holds the window that starts at ``i``."""

    def test(i: Column) -> Column:
        slot = _probe(words, i, length).bitwiseAND((1 << log2) - 1)
        return F.getbit(F.get(bits, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(63).cast("int")) == 1

    return test


def _candidate(words: Column, length: int):
    """Position, length and text of the window that starts at ``i``."""
    return lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), F.array_join(F.slice(words, i, length), " ").alias("w"))


def find_contamination(
    spark: SparkSession,
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 13,
    broadcast_windows: int = 200_000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Judge every document against the benchmark's ``n``-word windows.

    Returns ``id_col, n_words long, n_hit long, spans array<struct<first,last>>``
    (merged 1-based word ranges), ``items array<string>, contaminated boolean``
    and the columns named in ``carry``.  Up to ``broadcast_windows`` distinct
    windows are broadcast; beyond that they and the likely rows are shuffled.
    """
    windows = benchmark_windows(benchmark, item_col, item_text_col, n)
    by_length = {r["w_len"]: r["count"] for r in windows.groupBy("w_len").count().collect()}  # n rows at most
    total = sum(by_length.values())
    bitmaps = _bitmaps(windows, by_length)

    docs = documents.select(F.monotonically_increasing_id().alias("x_row"), F.col(id_col).alias("x_id"), *[F.col(c).alias(f"x_c{i}") for i, c in enumerate(carry)], normalised_words(F.col(text_col)).alias("x_words"))
    x_words = F.col("x_words")
    kind = "array<struct<pos:int,len:int,w:string>>"
    # one marker row a document carries its columns through the explode
    found = [F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("string").alias("w"))).cast(kind)]
    for length in sorted(by_length):
        starts = F.when(F.size(x_words) >= length, F.sequence(F.lit(1), F.greatest(F.size(x_words) - length + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        starts = F.filter(starts, _likely(x_words, length, *bitmaps[length]))
        found.append(F.transform(starts, _candidate(x_words, length)).cast(kind))
    kept = ["x_row", "x_id", *[f"x_c{i}" for i in range(len(carry))]]
    rows = docs.select(*kept, F.size(x_words).cast("long").alias("x_n"), F.concat(*found).alias("x_found"))
    rows = rows.select(*kept, "x_n", F.explode("x_found").alias("x_f")).select(*kept, "x_n", "x_f.pos", "x_f.len", "x_f.w")
    side = windows.withColumn("w_hash", F.xxhash64("w_text"))
    side = F.broadcast(side) if total <= broadcast_windows else side
    # marker rows have no window and meet none: each has a hash of its own, so that a shuffle spreads them
    rows = rows.withColumn("x_hash", F.when(F.col("pos") > 0, F.xxhash64("w")).otherwise(F.col("x_row")))
    hits = rows.join(side, (F.col("x_hash") == F.col("w_hash")) & (F.col("w") == F.col("w_text")) & (F.col("len") == F.col("w_len")), "left").where((F.col("pos") == 0) | F.col("w_text").isNotNull())
    hit = F.when(F.col("pos") > 0, F.struct("pos", "len"))
    one = hits.groupBy("x_row").agg(
        F.max(F.when(F.col("pos") == 0, F.struct(*kept[1:], F.col("x_n")))).alias("x_doc"),
        F.sort_array(F.collect_list(hit)).alias("x_hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("w_items")))).alias("items"),
    )
    return _judged(one, id_col, carry)


def _judged(one: DataFrame, id_col: str, carry: tuple[str, ...]) -> DataFrame:
    """Merge each document's hits to spans and apply the contamination rule."""
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("x_hits", lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1)))))
    out = one.withColumn("x_covered", covered).withColumn("n_hit", F.size("x_covered").cast("long"))
    # covered words without a covered one before them, and after them
    first = F.array_except("x_covered", F.transform("x_covered", lambda p: p + 1))
    last = F.array_except("x_covered", F.transform("x_covered", lambda p: p - 1))
    out = out.withColumn("spans", F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last"))))
    return out.select(
        F.col("x_doc.x_id").alias(id_col),
        F.col("x_doc.x_n").alias("n_words"),
        "n_hit",
        "spans",
        "items",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("x_doc.x_n"))).alias("contaminated"),
        *[F.col(f"x_doc.x_c{i}").alias(c) for i, c in enumerate(carry)],
    )


def drop_contaminated(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` that are not contaminated, unchanged."""
    key = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))
    keyed = documents.select(key.alias("x_key"), F.col(id_col).alias("x_id"), F.col(text_col).alias("x_text"), F.struct("*").alias("x_row"))
    found = find_contamination(spark, keyed, benchmark, id_col="x_id", text_col="x_text", carry=("x_key",), **options)
    dropped = Scratch(spark, "contaminated").write(found.where("contaminated").select("x_key").distinct(), "dropped")
    return without(keyed.select("x_key", "x_row"), dropped, "x_key").select("x_row.*")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of :func:`find_contamination` over ``documents`` and ``benchmark``."""
    found = find_contamination(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
             FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, g)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

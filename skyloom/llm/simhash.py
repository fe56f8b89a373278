"""SimHash near-duplicates through an inverted index over byte positions.

A fingerprint has eight positional bytes.  Two fingerprints that differ in at most
two bits share at least six of them and, of any four blocks of positions, at least
two.  The index is therefore keyed by two of the four pairs of positions and their
values: six postings a distinct fingerprint.  Within a list the shared positional
bytes of every pair are tallied, pairs below the guaranteed six are discarded and
the rest verified bit by bit; only a spanning set of the verified links leaves the
task.

Lists are counted before they are gathered.  One of more than ``long_list``
fingerprints is keyed anew by two of four blocks of the positions that are still
free, bytes first and half bytes next, until it is short: with eight free bits it
has 256 fingerprints at most.  Every list is thus tallied in the same way, and
none is cut.

Documents with equal fingerprints form one class before the index is built, so
thousands of copies cost one posting set.

Edge cases: a null text is empty; word-free texts have fingerprint zero and link
like any other; rows with a null id get a fingerprint and their class's component
but never name one; repeated rows are kept; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nearcopies
from .components import components
from .scratch import Scratch
from .shingles import shingle_hashes
from .textops import bounded_batches

POSITIONS = 8


def fingerprint(text: str, shingle: int, seed: int) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included."""
    return _majority(shingle_hashes(text, shingle, seed))


def _majority(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """64-bit value whose bits are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        counts += np.unpackbits(hashes[at : at + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """``x_id long, x_fp long`` (the bits as a signed value) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py() or "", shingle, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["x_id", "x_fp"])

    return documents.select(F.col(id_col).cast("long").alias("x_id"), F.col(text_col).alias("x_text")).mapInArrow(run, "x_id long, x_fp long")


def _spanning(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of one posting list that connect what its verified pairs connect."""
    n, shared = len(values), POSITIONS - max_bits
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    bytes_ = values.view(np.uint8).reshape(n, POSITIONS)
    for i in range(n - 1):
        tally = (bytes_[i + 1 :] == bytes_[i]).sum(axis=1)
        near = np.flatnonzero(tally >= shared) + i + 1
        near = near[np.bitwise_count(values[near] ^ values[i]) <= max_bits]
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def finer(mask: int, max_bits: int) -> list[int]:
    """Masks that keep ``mask`` and two of ``max_bits + 2`` blocks of the other bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(free, max_bits + 2)]
    return [mask | x | y for x, y in combinations(blocks, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _tallied(lists: DataFrame, max_bits: int) -> DataFrame:
    """Verified spanning links ``u, v`` of posting lists ``x_fps array<long>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for row in batch.column(0):
                values = np.unique(row.values.to_numpy().view(np.uint64))
                for i, j in _spanning(values, max_bits):
                    us.append(values[i])
                    vs.append(values[j])
            ends = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs)]
            yield pa.RecordBatch.from_arrays(ends, ["u", "v"])

    return lists.select("x_fps").mapInArrow(run, "u long, v long")


def index_links(scratch: Scratch, classes: DataFrame, max_bits: int, long_list: int = 512) -> DataFrame:
    """Verified spanning links ``u, v`` between the fingerprints ``x_fp`` of ``classes``."""
    spark = scratch.spark
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    masks, links, level = {0: finer(0, max_bits)}, None, 0
    # a few files may hold all classes: dealt out before they are multiplied
    entries = classes.select("x_fp", F.lit(0).cast("long").alias("x_mask")).repartition(tasks)
    while True:
        steps = spark.createDataFrame([(_signed(m), [_signed(f) for f in fine]) for m, fine in masks.items()], "x_mask long, x_finer array<long>")
        keyed = entries.join(F.broadcast(steps), "x_mask").select("x_fp", F.explode("x_finer").alias("x_mask"))  # at most 6**3 rows of masks
        keyed = keyed.withColumn("x_key", F.col("x_fp").bitwiseAND(F.col("x_mask")))
        if level:
            keyed = keyed.distinct()  # a fingerprint may come from several long lists
        crowded = keyed.groupBy("x_mask", "x_key").agg(F.count("*").alias("x_c")).where(F.col("x_c") > long_list).select("x_mask", "x_key")
        crowded = scratch.write(crowded, f"crowded{level}")
        n_crowded = crowded.count()
        side = F.broadcast(crowded) if n_crowded <= 1_000_000 else crowded
        short = keyed.join(side, ["x_mask", "x_key"], "left_anti") if n_crowded else keyed
        found = _tallied(short.groupBy("x_mask", "x_key").agg(F.collect_list("x_fp").alias("x_fps")).where(F.size("x_fps") > 1), max_bits)
        links = found if links is None else links.unionByName(found)
        if not n_crowded:
            return links
        masks = {f: finer(f, max_bits) for fine in masks.values() for f in fine}
        entries = scratch.write(keyed.join(side, ["x_mask", "x_key"], "left_semi").select("x_fp", "x_mask"), f"long{level}").repartition(tasks)
        level += 1


def near_duplicates(
    spark: SparkSession,
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    seed: int = 42,
    max_bits: int = 2,
    long_list: int = 512,
) -> DataFrame:
    """``id_col, fingerprint string, component_id long`` for each row.

    ``component_id`` is the smallest id reachable over links of at most
    ``max_bits`` differing bits.
    """
    bounded_batches(spark)
    scratch = Scratch(spark, "simhash")
    prints = scratch.write(fingerprints(documents, id_col, text_col, shingle, seed), "prints")
    classes = scratch.write(prints.groupBy("x_fp").agg(F.min("x_id").alias("x_rep")), "classes")
    links = index_links(scratch, classes, max_bits, long_list)
    roots = components(scratch, links)
    rooted = classes.join(roots, F.col("x_fp") == F.col("node"), "left").select("x_fp", "x_rep", F.coalesce("root", "x_fp").alias("x_root"))
    named = rooted.groupBy("x_root").agg(F.min("x_rep").alias("component_id"))
    of_class = rooted.join(named, "x_root").select("x_fp", "component_id")
    return prints.join(of_class, "x_fp").select(F.col("x_id").alias(id_col), F.lpad(F.lower(F.hex("x_fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(spark: SparkSession, documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """``documents`` with one row of each group of texts whose shingle sets are alike by ``similarity`` or more.

    Of a group the row with the smallest id stays.  At a similarity of 0.8
    fingerprints differ in some ten of 64 bits, so that no positional byte need be
    shared; :mod:`nearcopies` indexes the byte positions of wider fingerprints, and
    each link is verified on the shingles themselves.
    """
    return nearcopies.drop_near_copies(spark, documents, id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity, seed=seed)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all ``documents``."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Best-fit packing of documents into fixed-length token sequences, by sum of squares.

Documents are tokenised batch by batch; only lengths and checksums leave that
pass.  Texts longer than a sequence are cut so that all but their first piece
fill a sequence alone.  The first pieces are packed shard by shard: a piece goes
where the squared counts of open bins per residual gap become smallest, longest
pieces first.  A shard holds a bounded number of documents, whatever the input.

Edge cases: a null or empty text is one piece holding only the end token; equal
lengths are taken in the order of the ids; repeated rows are packed separately;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .textops import bounded_batches

END_TOKEN = 2


def default_tokenizer() -> str:
    """File of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    """File of the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoder(path: str, ranks_path: str | None):
    """Function from text to token ids for the vocabulary in ``path``.

    With ``ranks_path``, a file of the same vocabulary as ranks, these give the same
    ids at several times the speed.
    """
    if ranks_path is not None:
        import json

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(ranks_path).open("rb"))}
        special = {t["content"]: t["id"] for t in json.loads(Path(path).read_text())["added_tokens"]}
        encoding = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: encoding.encode(text, allowed_special="all")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def tokenize_pieces(documents: DataFrame, tokenizer: str, ranks: str | None, id_col: str, text_col: str, size: int) -> DataFrame:
    """For each document the lengths and checksums of its pieces, in order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _encoder(tokenizer, ranks)
        for batch in batches:
            lengths, sums, total = [], [], 0
            at = [0]
            for text in batch.column(1):
                ids = np.array([*ids_of(text.as_py() or ""), END_TOKEN], "<u4")
                first = len(ids) - (len(ids) - 1) // size * size
                cuts = [0, *range(first, len(ids) + 1, size)]
                lengths += [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
                sums += [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
                total += len(cuts) - 1
                at.append(total)
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(lengths, pa.int32())), pa.ListArray.from_arrays(at, pa.array(sums, pa.int64()))], ["x_id", "x_len", "x_crc"])

    source = documents.select(F.col(id_col).cast("long").alias("x_id"), F.col(text_col).alias("x_text"))
    return source.mapInArrow(encode, "x_id long, x_len array<int>, x_crc array<long>")


class SumOfSquares:
    """Bins of one shard, kept as counts and stacks of open bins per residual gap."""

    def __init__(self, size: int):
        self.size = size
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.counts = np.zeros(size + 1, np.int64)
        self.bins = 0

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece.

        Moving a bin from gap g to g-length changes the sum of squares by
        2 * (N[g - length] - N[g]) + 2, opening a bin by 2 * N[size - length] + 1;
        a gap of 0 counts nothing.
        """
        size, counts = self.size, self.counts
        gap, best = size, 2 * int(counts[size - length]) + 1 if length < size else 0
        if self.bins:
            before = counts[length:size]
            after = counts[: size - length].copy()
            if len(before):
                change = 2 * (after - before) + 2
                change[0] = 1 - 2 * int(before[0])  # the bin is full and leaves the sum
                change[before == 0] = np.iinfo(np.int64).max
                at = int(np.argmin(change))
                if change[at] <= best:
                    gap, best = at + length, int(change[at])
        if gap == size:
            bin_, self.bins = self.bins, self.bins + 1
        else:
            bin_ = self.open[gap].pop()
            counts[gap] -= 1
        if rest := gap - length:
            self.open[rest].append(bin_)
            counts[rest] += 1
        return bin_, size - gap


def _pack_shard(table: pa.Table, size: int) -> pa.Table:
    """All pieces of a shard's documents with their places."""
    table = table.sort_by([("x_id", "ascending")])
    lengths, sums = table.column("x_len").combine_chunks(), table.column("x_crc").combine_chunks()
    offsets = lengths.offsets.to_numpy()
    offsets = offsets - offsets[0]
    flat = lengths.flatten().to_numpy().astype(np.int64)
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    piece = np.arange(len(flat)) - offsets[owner]
    running = np.cumsum(flat) - flat
    start = running - running[offsets[owner]]
    first = flat[offsets[:-1]]
    bins, places = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
    packer = SumOfSquares(size)
    for d in np.argsort(-first, kind="stable"):
        bins[offsets[d]], places[offsets[d]] = packer.place(int(first[d]))
    alone = np.flatnonzero(piece > 0)
    bins[alone] = packer.bins + np.arange(len(alone))
    shard = table.column("x_shard")[0].as_py() if len(table) else 0
    ids = table.column("x_id").combine_chunks().take(pa.array(owner))
    columns = [ids, piece.astype(np.int32), start, flat, sums.flatten(), (np.int64(shard) << 32) + bins, places]
    return pa.table([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(
    spark: SparkSession,
    documents: DataFrame,
    *,
    tokenizer: str | None = None,
    ranks: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 1024,
    shard_documents: int = 50_000,
) -> DataFrame:
    """Places of all pieces: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``shard_documents`` bounds what one packing task holds (about 24 bytes a
    piece); a larger shard wastes less in its last open bins.  ``tokenizer`` is a
    vocabulary of the ``tokenizers`` library and ``ranks``, if given, the file of the
    same vocabulary as ranks; without both, the public byte-level one and its ranks.
    """
    bounded_batches(spark)
    scratch = Scratch(spark, "pack")
    if tokenizer is None:
        tokenizer, ranks = default_tokenizer(), default_ranks()
    lengths = scratch.write(tokenize_pieces(documents, tokenizer, ranks, id_col, text_col, size), "lengths")
    shards = max(1, -(-lengths.count() // shard_documents))
    # rows of the written table are dealt by their place in it, so that repeated ones spread too
    dealt = lengths.withColumn("x_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("x_shard").applyInArrow(lambda table: _pack_shard(table, size), schema)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 1024 tokens."""
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))

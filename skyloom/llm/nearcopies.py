"""Near copies: wide SimHash fingerprints, an index over their byte positions, a count filter, an exact check.

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more.  At that similarity fingerprints differ in some 15 % of
their bits, ten of 64, so that the eight positional bytes of 64 bits guarantee
nothing.  The fingerprint is therefore ``POSITIONS`` bytes wide: a bit is 1 if it is
set in over half of the set's hashes, mixed anew for every 64 bits.  A pair at the
threshold shares a positional byte with probability 0.27, others with 0.004.

Posting lists are keyed by two positions and their values (``LISTS`` of them, twice as
many for sets of up to ``SHORT`` shingles, whose bits differ more often).  Within a
list the shared bytes of every pair among the next ``TAIL`` positions are tallied, and
pairs below ``LEAST`` (``LEAST_SHORT``) are discarded.  Texts with equal sets form one
class before any list is built.

What the remaining pairs connect is a cluster; only a spanning set of them leaves a
task, and after the first ``EARLY`` lists only pairs that connect two clusters.  The
shingle sets of a cluster come together once.  In a large one pairs are tallied over
all positions and verified bit by bit, within four standard deviations of a pair at the
threshold; for sets of up to ``EXACT`` shingles the shingles they share are counted
next, by 32 bits of each.  Each pair that passes is checked on the shingle sets
themselves, unless the links that were found connect it already.  Clusters of more than
``BLOCK`` shingles are cut into blocks, and every two blocks meet.  No list is cut.

Edge cases: a null text is empty; texts without words are copies of each other;
a text of fewer words than a shingle is one shingle; ids may repeat or be null,
as rows are told apart by id and text; extra columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .shingles import shingle_hashes
from .textops import bounded_batches, mix, ranges
from .windows import row_id

#: Bytes of a fingerprint, and lists a set is entered in.
POSITIONS, LISTS = 256, 128
#: Lists whose links come first.
EARLY = 4
#: Positions tallied within a list, and the shared ones that keep a pair.
TAIL, LEAST = 32, 5
#: Shingles of a set that is entered in twice the lists, and the shared positions that keep two such sets.
SHORT, LEAST_SHORT = 32, 3
#: The most shingles of a set whose shingles are counted in a large cluster.
EXACT = 512
#: Members of a cluster, and of a list, all pairs of which are looked at; in larger ones ``HUBS`` members are compared with all first.
SMALL, LONG, HUBS = 32, 256, 8
#: Bytes of postings and shingles of sets a task gathers at once.
PART, BLOCK = 1 << 22, 1 << 21
_XOR, _ODD = mix(np.arange(1, POSITIONS // 4 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)
_ODD = _ODD | np.uint64(1)
_LANES = np.uint64(0x0101010101010101)
_POSTING = np.dtype([("key", "<u4"), ("n", "<u4"), ("set", "<i8"), ("tail", "<u8", TAIL // 8)])


def shingle_set(text: str, shingle: int, seed: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return np.unique(shingle_hashes(text, shingle, seed))


def positional_bytes(hashes: np.ndarray, block: int = 255) -> bytes:
    """The wide fingerprint of a set of hashes: its majority bits."""
    counts = np.zeros((8, len(_XOR) * 8), np.int64)
    for at in range(0, len(hashes), block):  # a lane counts up to 255
        mixed = (hashes[at : at + block, None] ^ _XOR) * _ODD
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(29)
        for bit in range(8):
            counts[bit] += np.add.reduce((mixed >> np.uint64(bit)) & _LANES, axis=0).view(np.uint8)
    return np.packbits(2 * counts > len(hashes), axis=0, bitorder="little").tobytes()


def _set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes())


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def sketches(rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """``x_row, x_id, x_set, x_n, x_print`` of rows ``x_row, x_id, x_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or "", shingle, seed) for t in batch.column(2)]
            prints = pa.array([positional_bytes(s) for s in sets], pa.binary())
            columns = [batch.column(0), batch.column(1), _longs([_set_key(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), prints]
            yield pa.RecordBatch.from_arrays(columns, ["x_row", "x_id", "x_set", "x_n", "x_print"])

    return rows.mapInArrow(run, "x_row binary, x_id long, x_set long, x_n long, x_print binary")


def _postings(sets: np.ndarray, n: np.ndarray, prints: np.ndarray, lists: range) -> np.ndarray:
    """One posting of each set in each list."""
    out = np.empty((len(sets), len(lists)), _POSTING)
    out["set"], out["n"] = sets[:, None], n[:, None]
    for column, k in enumerate(lists):
        first = 2 * k if k < LISTS else 2 * (k - LISTS) + 1  # the further lists take the pairs in between
        at = (first + np.arange(TAIL + 2)) % POSITIONS
        out["key"][:, column] = (np.uint32(k) << np.uint32(16)) | (prints[:, at[0]].astype(np.uint32) << np.uint32(8)) | prints[:, at[1]]
        out["tail"][:, column] = np.ascontiguousarray(prints[:, at[2:]]).view("<u8")
    return out.ravel()


def posting_parts(classes: DataFrame, parts: int, lists: range, rows: int = 512) -> DataFrame:
    """The postings of classes ``x_set, x_n, x_print``, all of a list in the same ``x_part``: ``x_part long, x_postings binary``."""
    further = range(lists.start + LISTS, lists.stop + LISTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                sets, n = (batch.column(k).to_numpy() for k in range(2))
                prints = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, POSITIONS)
                few = n <= SHORT
                found = np.concatenate([_postings(sets, n, prints, lists), _postings(sets[few], n[few], prints[few], further)])
                part = (mix(found["key"].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                found, part = found[order], part[order]
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                blobs = [x.tobytes() for x in np.split(found, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(blobs, pa.binary())], ["x_part", "x_postings"])

    return classes.mapInArrow(run, "x_part long, x_postings binary")


def _shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes of each row of 64-bit words are equal."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    x = a ^ b
    differ = (((x & low) + low) | x) & ~low
    return x.shape[1] * 8 - np.bitwise_count(differ).sum(axis=1, dtype=np.int64)


class _Joined:
    """Union of numbered members; ``links`` are the pairs that joined two sets."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def roots(self, members: np.ndarray) -> np.ndarray:
        return np.array([self.find(i) for i in members.tolist()], np.int64)


def _join_lists(found: np.ndarray, similarity: float, most: int = 1 << 15) -> list[tuple[int, int]]:
    """Spanning pairs of sets of what the pairs of postings (in order of list and size) that pass the tally connect."""
    key, n, tail = found["key"].astype(np.int64), found["n"].astype(np.int64), np.ascontiguousarray(found["tail"])
    names, sets = np.unique(found["set"], return_inverse=True)
    joined = _Joined(len(names))
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edge)
    place = np.arange(len(key))
    last = np.searchsorted(key << 32 | n, key << 32 | np.minimum(np.floor(n / similarity + 1e-9).astype(np.int64), (1 << 32) - 1), "right")

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        least = np.where((n[a] <= SHORT) & (n[b] <= SHORT), LEAST_SHORT, LEAST)
        return (_shared_bytes(tail[a], tail[b]) >= least) & (sets[a] != sets[b])

    def join(a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.minimum(sets[a], sets[b]) * len(names) + np.maximum(sets[a], sets[b]))
        for pair in pairs.tolist():
            joined.join(*divmod(pair, len(names)))

    count = np.where(np.repeat(size, size) > LONG, 0, last - place - 1)
    done, at = np.cumsum(count), 0
    while at < len(key):  # bounded numbers of pairs at a time
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + most, "right")))
        a = np.repeat(place[at:to], count[at:to])
        b = a + 1 + ranges(count[at:to])
        kept = near(a, b)
        join(a[kept], b[kept])
        at = to
    for k in np.flatnonzero(size > LONG).tolist():
        own = place[edge[k] : edge[k + 1]]

        def others(i: int, among: np.ndarray) -> None:
            fits = among[np.minimum(n[among], n[i]) >= similarity * np.maximum(n[among], n[i]) - 1e-9]
            for part in np.array_split(fits, len(fits) // most + 1):
                a = np.full(len(part), i)
                kept = near(a, part)
                join(a[kept], part[kept])

        for i in own[:: max(1, len(own) // HUBS)].tolist():
            others(i, own)
        for i, js in _open_pairs(joined.roots(sets[own])):
            others(int(own[i]), own[js])
    return [(int(names[i]), int(names[j])) for i, j in joined.links]


def coarse_links(parts: DataFrame, similarity: float) -> DataFrame:
    """``u, v``: pairs of sets that connect what the lists' tallies connect."""

    def run(table: pa.Table) -> pa.Table:
        found = np.frombuffer(b"".join(table.column("x_postings").to_pylist()), _POSTING)
        links = _join_lists(found[np.lexsort((found["set"], found["n"], found["key"]))], similarity)
        u, v = np.array(links, np.int64).reshape(-1, 2).T
        return pa.Table.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return parts.groupBy("x_part").applyInArrow(run, "u long, v long")


def shingle_sets(rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """``x_set, x_shingles`` of rows ``x_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or "", shingle, seed) for t in batch.column(0)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([_longs([_set_key(s) for s in sets]), lists], ["x_set", "x_shingles"])

    return rows.mapInArrow(run, "x_set long, x_shingles array<long>")


def _open_pairs(roots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each member outside the bucket's largest component, with all later-counted members of other components."""
    kinds, counts = np.unique(roots, return_counts=True)
    outside = roots != kinds[counts.argmax()]
    for i in np.flatnonzero(outside).tolist():
        other = roots != roots[i]
        other[: i + 1] &= ~outside[: i + 1]  # pairs of two outside members count once
        yield i, np.flatnonzero(other)


class _Shared:
    """How many 32-bit shingles a member shares with each member of its list: an inverted index and a tally."""

    def __init__(self, values: list[bytes]):
        arrays = [np.frombuffer(v, np.uint32) for v in values]
        self.n = len(arrays)
        self.first = np.cumsum([0, *map(len, arrays)])
        _, self.place = np.unique(np.concatenate([np.zeros(0, np.uint32), *arrays]), return_inverse=True)
        owner = np.repeat(np.arange(self.n), np.diff(self.first))
        self.owner = owner[np.argsort(self.place, kind="stable")]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(self.place))])

    def of(self, i: int) -> np.ndarray:
        own = self.place[self.first[i] : self.first[i + 1]]
        size = self.at[own + 1] - self.at[own]
        return np.bincount(self.owner[np.repeat(self.at[own], size) + ranges(size)], minlength=self.n)


def _bounds(similarity: float) -> tuple[int, int]:
    """The fewest shared positional bytes and the most differing bits of a pair, four standard deviations beyond one at the threshold."""
    bit = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    byte = (1 - bit) ** 8
    return int(POSITIONS * byte - 4 * (POSITIONS * byte * (1 - byte)) ** 0.5), int(8 * POSITIONS * bit + 4 * (8 * POSITIONS * bit * (1 - bit)) ** 0.5) + 1


def _alike(pairs: Iterator[tuple[int, np.ndarray]], n: np.ndarray, values: list[bytes], signs: list[bytes], similarity: float, most: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the pairs, those whose tallies reach the minimum: shared positional bytes, then shared shingles."""
    shared = _Shared(values)
    least, bits = _bounds(similarity)
    held = np.array([len(x) == POSITIONS for x in signs])
    table = np.zeros((len(n), POSITIONS // 8), np.uint64)
    if held.any():
        table[held] = np.frombuffer(b"".join(signs), np.uint64).reshape(-1, POSITIONS // 8)
    for i, others in pairs:
        fits = others[np.minimum(n[others], n[i]) >= similarity * np.maximum(n[others], n[i]) - 1e-9]
        for at in range(0, len(fits), most):
            js = fits[at : at + most]
            if held[i]:
                near = _shared_bytes(table[js], table[i]) >= least
                near[near] = np.bitwise_count(table[js[near]] ^ table[i]).sum(axis=1, dtype=np.int64) <= bits
                js = js[near | ~held[js]]
            short = (n[js] <= EXACT) & (n[i] <= EXACT)
            if short.any():
                tally = shared.of(i)[js] + 1  # two shingles of a set may have the same 32 bits
                js = js[~short | (tally * (1 + similarity) >= similarity * (n[i] + n[js]) - 1e-9)]
            yield np.full(len(js), i), js


def _cluster_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of one cluster that connect what its near copies connect."""
    n = np.array([len(s) for s in sets])
    joined = _Joined(len(sets))

    def check(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        for left, right in pairs:
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                if joined.find(i) != joined.find(j):
                    shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if shared * (1 + similarity) >= similarity * (n[i] + n[j]) - 1e-9:
                        joined.join(i, j)

    every = np.arange(len(sets))
    if len(sets) <= SMALL:
        i, j = np.triu_indices(len(sets), 1)
        fits = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
        check([(i[fits], j[fits])])
        return joined.links
    values = [np.unique(s.astype(np.uint32)).tobytes() if len(s) <= EXACT else b"" for s in sets]
    signs = [positional_bytes(s) if len(s) > SHORT else b"" for s in sets]  # those of shorter sets vary too much
    hubs = np.argsort(n, kind="stable")[:: max(1, len(sets) // HUBS)].tolist()
    check(_alike(((i, every[every != i]) for i in hubs), n, values, signs, similarity))
    check(_alike(_open_pairs(joined.roots(every)), n, values, signs, similarity))
    return joined.links


def cluster_links(clusters: DataFrame, similarity: float) -> DataFrame:
    """Links ``u, v`` of clusters ``x_members array<struct<x_set, x_shingles>>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for row in batch.column(0):
                keys, lists = row.values.field("x_set").to_numpy(), row.values.field("x_shingles")
                sets = [lists[k].values.to_numpy().view(np.uint64) for k in range(len(keys))]
                for i, j in _cluster_links(sets, similarity):
                    us.append(keys[i])
                    vs.append(keys[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in (us, vs)], ["u", "v"])

    return clusters.select("x_members").mapInArrow(run, "u long, v long")


def drop_near_copies(
    spark: SparkSession,
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    seed: int = 42,
) -> DataFrame:
    """``documents`` with one row of each group of near copies, the one with the smallest id (null ids last)."""
    bounded_batches(spark)
    scratch = Scratch(spark, "near_copies")
    keyed = documents.select(row_id(id_col, text_col).alias("x_row"), F.col(id_col).cast("long").alias("x_id"), F.col(text_col).alias("x_text"))
    sketch = scratch.write(sketches(keyed, shingle, seed), "sketch")
    representative = F.min(F.struct(F.col("x_id").isNull().alias("x_null"), "x_id", "x_row")).alias("x_rep")
    classes = scratch.write(sketch.groupBy("x_set").agg(representative), "classes")

    # copies have the same fingerprint; a text without words is in no list
    entries = sketch.where("x_n > 0").groupBy("x_set").agg(F.min("x_n").alias("x_n"), F.min("x_print").alias("x_print"))
    entries = scratch.write(entries, "entries")
    tasks, n_classes = int(spark.conf.get("spark.sql.shuffle.partitions")), classes.count()

    def coarse(entries: DataFrame, lists: range, name: str) -> DataFrame:
        """What the lists connect."""
        parts = max(tasks, n_classes * len(lists) * _POSTING.itemsize // PART)
        postings = posting_parts(entries.repartition(tasks), parts, lists).repartition(parts, "x_part")
        return scratch.write(coarse_links(postings, similarity).distinct(), name)

    early = coarse(entries, range(EARLY), "early")
    rounds = [Scratch(spark, f"near_copies_{name}") for name in ("early", "late")]
    roots = components(rounds[0], early)
    named = entries.join(roots, F.col("x_set") == F.col("node"), "left").select(F.coalesce("root", "x_set").alias("x_set"), "x_n", "x_print")
    late = coarse(named, range(EARLY, LISTS), "late")
    roots = scratch.write(components(rounds[1], early.unionByName(late)), "clustered")
    for done in rounds:
        done.keep()

    clustered = roots.select(F.col("node").alias("x_set"), F.col("root").alias("x_cluster")).unionByName(roots.select(F.col("root").alias("x_set"), F.col("root").alias("x_cluster")).distinct())
    clustered = scratch.write(clustered.join(entries.select("x_set", "x_n"), "x_set"), "clusters")
    blocks = clustered.groupBy("x_cluster").agg(F.ceil(F.sum("x_n") / BLOCK).alias("x_blocks"))
    # every two blocks of a cluster meet in a group; a cluster of one block is one group
    block, other = F.col("x_block"), F.col("x_other")
    groups = clustered.join(blocks, "x_cluster").withColumn("x_block", F.expr("pmod(x_set, x_blocks)")).withColumn("x_other", F.explode(F.expr("sequence(0L, x_blocks - 1)")))
    groups = groups.where((F.col("x_blocks") == 1) | (block != other)).select("x_set", "x_cluster", F.least(block, other).alias("x_a"), F.greatest(block, other).alias("x_b"))
    ends = classes.join(clustered.select("x_set"), "x_set").select(F.col("x_rep.x_row").alias("x_row"))
    ends = scratch.write(ends, "ends")
    texts = keyed.join(F.broadcast(ends) if ends.count() <= 1_000_000 else ends, "x_row", "left_semi").dropDuplicates(["x_row"]).select("x_text")
    sets = scratch.write(shingle_sets(texts, shingle, seed), "sets")
    members = F.collect_list(F.struct("x_set", "x_shingles")).alias("x_members")
    links = scratch.write(cluster_links(groups.join(sets, "x_set").groupBy("x_cluster", "x_a", "x_b").agg(members), similarity), "links")
    roots = components(scratch, links)

    rooted = classes.join(roots, F.col("x_set") == F.col("node"), "left").select("x_set", "x_rep", F.coalesce("root", "x_set").alias("x_root"))
    stays = rooted.groupBy("x_root").agg(F.min("x_rep").getField("x_row").alias("x_stays"))
    of_class = rooted.join(stays, "x_root").select("x_set", "x_stays")
    dropped = scratch.write(sketch.join(of_class, "x_set").where("x_row <> x_stays").select("x_row").distinct(), "dropped")
    unique = sketch.groupBy("x_row").count().where("count > 1").isEmpty()
    scratch.keep("dropped")
    gone = F.broadcast(dropped) if dropped.count() <= 1_000_000 else dropped
    kept = documents.join(gone, row_id(id_col, text_col) == dropped["x_row"], "left_anti")
    return kept if unique else kept.dropDuplicates([id_col, text_col])

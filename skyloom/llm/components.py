"""Connected components: in one task up to ``ONE_TASK`` edges, beyond by alternating large-star and small-star rounds.

A round is some ten jobs, whose plans, threads and generated classes the driver
keeps; the edges of most tables fit into a single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Edges (two longs each) that one task joins.
ONE_TASK = 1 << 18


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star operation over symmetric edges ``(u, v)``.

    Minima are aggregated before the shuffle and joined back on the node, so a
    node with many neighbours is a skewed join, which is split, and never a group.
    """
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select("v", "m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge set."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that is not the smallest of its component, and that smallest one."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(names))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)  # a root hangs below the smallest root that it meets
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    other = root != np.arange(len(names))
    return names[other], names[root[other]]


def _joined(edges: DataFrame) -> DataFrame:
    """``node, root`` of all edges, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*[[c.to_numpy() for c in batch.columns] for batch in batches], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_nodes(u, v)], ["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges(u long, v long)`` that is not its component's root, the smallest node.

    Every round is written to the scratch folder, so no plan grows and a lost
    executor repeats at most one round.  Null ends and loops are ignored.
    """
    now = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges0")
    seen, k = _fingerprint(now), 0
    if 0 < seen[0] <= ONE_TASK:
        return scratch.write(_joined(now), "roots")
    while seen[0]:
        then = scratch.write(_star(_star(now, True), False), f"edges{k + 1}")
        scratch.drop(f"edges{k}")
        now, k = then, k + 1
        state = _fingerprint(now)
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

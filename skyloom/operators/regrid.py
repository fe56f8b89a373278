"""Regridding as relational algebra over separable axis weights.

On regular latitude-longitude grids a target cell's weights are products of one
weight for each axis.  Two small tables ``(target, source, w)`` are joined by
equality and the products summed by target cell: one partial aggregation, one
shuffle, no weight matrix.  ``patch`` combines two quadratic fits for each axis
and is separable too.

Missing cells must be rows with NULL (see ``cube.densify``), or absent
contributors would go unnoticed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import BROADCAST_ROWS
from .axes import METHODS, Axis, GridError

Weights = list[tuple[int, int, float]]


def overlap_weights(source: Axis, target: Axis, *, normed: bool, sphere: bool = False, periodic: bool = False) -> Weights:
    """Share of each target cell (or of its covered part) that each source cell covers.

    ``sphere`` measures latitude by the sine, ``periodic`` also tries the source
    a whole turn to either side.
    """
    measure = (lambda a: math.sin(math.radians(a))) if sphere else float
    out: Weights = []
    shifts = (0.0, 360.0, -360.0) if periodic else (0.0,)
    cells = sorted((a + s, b + s, i) for i, _, a, b in source.rows() for s in shifts)
    lows = np.array([c[0] for c in cells])
    longest = max((b - a for a, b, _ in cells), default=0.0)
    for j, _, a, b in target.rows():
        found: dict[int, float] = {}
        for k in range(int(np.searchsorted(lows, a - longest)), int(np.searchsorted(lows, b))):
            low, high, i = cells[k]
            if min(b, high) > max(a, low):
                found[i] = found.get(i, 0.0) + measure(min(b, high)) - measure(max(a, low))
        whole = sum(found.values()) if normed else measure(b) - measure(a)
        out += [(j, i, w / whole) for i, w in found.items() if w > 0]
    return out


def bilinear_weights(source: Axis, target: Axis, *, periodic: bool = False) -> Weights:
    """The two centres around each target centre, linearly; none beyond the outermost centres."""
    points = sorted((c, i) for i, c, _, _ in source.rows())
    if periodic:
        points = [(points[-1][0] - 360.0, points[-1][1]), *points, (points[0][0] + 360.0, points[0][1])]
    at = np.array([p[0] for p in points])
    out: Weights = []
    for j, c, _, _ in target.rows():
        k = int(np.searchsorted(at, c, "right")) - 1
        if k >= 0 and at[k] == c:
            out.append((j, points[k][1], 1.0))
        elif 0 <= k < len(points) - 1:
            share = (c - at[k]) / (at[k + 1] - at[k])
            out += [(j, points[k][1], 1.0 - share), (j, points[k + 1][1], share)]
    return out


def patch_weights(source: Axis, target: Axis) -> Weights:
    """Quadratic recovery: the fits around the two neighbouring centres, blended linearly."""
    points = sorted((c, i) for i, c, _, _ in source.rows())
    n = len(points)
    if n < 3:
        return bilinear_weights(source, target)
    at = [p[0] for p in points]
    out: Weights = []
    for j, c, _, _ in target.rows():
        if c < at[0] or c > at[-1]:
            continue
        k = min(int(np.searchsorted(at, c, "right")) - 1, n - 2)
        share = (c - at[k]) / (at[k + 1] - at[k])
        found: dict[int, float] = {}
        for centre, blend in ((k, 1.0 - share), (k + 1, share)):
            low = min(max(centre - 1, 0), n - 3)
            for p in range(low, low + 3):
                basis = math.prod((c - at[q]) / (at[p] - at[q]) for q in range(low, low + 3) if q != p)
                found[points[p][1]] = found.get(points[p][1], 0.0) + blend * basis
        out += [(j, i, w) for i, w in found.items() if w]
    return out


def nearest_source_weights(source: Axis, target: Axis, *, periodic: bool = False) -> Weights:
    """The nearest source centre of each target centre; of two, the lower index."""
    out: Weights = []
    for j, c, _, _ in target.rows():
        apart = np.abs(source.centres - c)
        if periodic:
            apart = np.minimum(apart % 360.0, 360.0 - apart % 360.0)
        out.append((j, int(apart.argmin()), 1.0))
    return out


def nearest_target_weights(source: Axis, target: Axis) -> Weights:
    """Each source centre goes to its nearest target centre."""
    return [(j, i, w) for i, j, w in nearest_source_weights(target, source)]


def axis_weights(method: str, source: Axis, target: Axis, *, sphere: bool = False, periodic: bool = False) -> Weights:
    """Weights of one axis for any method."""
    if method in ("conservative", "conservative_normed"):
        return overlap_weights(source, target, normed=method.endswith("normed"), sphere=sphere, periodic=periodic)
    if method == "bilinear":
        return bilinear_weights(source, target, periodic=periodic)
    if method == "patch":
        return patch_weights(source, target)
    if method == "nearest_s2d":
        return nearest_source_weights(source, target, periodic=periodic)
    if method == "nearest_d2s":
        return nearest_target_weights(source, target)
    raise GridError(f"method is one of {', '.join(METHODS)}")


def weight_table(spark: SparkSession, weights: Weights, target: str, source: str, weight: str) -> DataFrame:
    """Weights as a table; small ones are broadcast (they number a few for each axis position)."""
    rows = [(int(j), int(i), float(w)) for j, i, w in weights]
    frame = spark.createDataFrame(rows, f"{target} int, {source} int, {weight} double")
    return F.broadcast(frame) if len(weights) <= BROADCAST_ROWS else frame


def valid_threshold(na_thres: float) -> float:
    """Least covered weight that keeps a value when missing cells are skipped."""
    if not 0.0 <= na_thres <= 1.0:
        raise GridError("na_thres lies between 0 and 1")
    return min(max(1.0 - na_thres, 1e-6), 1.0 - 1e-6)


def combine(cells: DataFrame, wy: DataFrame, wx: DataFrame, value: Column, *, skipna: bool = True, na_thres: float = 1.0, mean: bool = False, time: str = "t") -> DataFrame:
    """Sum of weights times values for each target cell: ``t, ty, tx, value``.

    Skipping missing cells divides by the weight of the valid ones and keeps
    what reaches the threshold; otherwise one missing contributor makes the
    target missing.  ``mean`` divides by the valid weight without a threshold.
    """
    w = F.col("wy") * F.col("wx")
    joined = cells.withColumn("x_v", value.cast("double")).join(wy, "y").join(wx, "x")
    sums = joined.groupBy(time, "ty", "tx").agg(
        F.sum(w * F.col("x_v")).alias("x_num"),
        F.sum(F.when(F.col("x_v").isNotNull(), w)).alias("x_den"),
        F.count("*").alias("x_all"),
        F.count("x_v").alias("x_valid"),
    )
    if mean:
        out = F.when(F.col("x_den") > 0, F.col("x_num") / F.col("x_den"))
    elif skipna:
        out = F.when(F.col("x_den") >= F.lit(valid_threshold(na_thres)), F.col("x_num") / F.col("x_den"))
    else:
        out = F.when(F.col("x_all") == F.col("x_valid"), F.col("x_num"))
    return sums.select(time, "ty", "tx", out.alias("value"))


def regrid(cells: DataFrame, source: tuple[Axis, Axis], target: tuple[Axis, Axis], method: str, *, value: str = "v", skipna: bool = True, na_thres: float = 1.0, sphere: bool = False, time: str = "t") -> DataFrame:
    """Cells on the target grid as ``t, y, x, value``; uncovered target cells are NULL rows.

    ``cells`` must be dense over the source window.  Nearest-target with skipped
    missing cells is the mean of the contributing sources, without it their sum.
    """
    spark = cells.sparkSession
    weights = axis_weights(method, source[0], target[0], sphere=sphere), axis_weights(method, source[1], target[1], periodic=source[1].periodic)
    wy = weight_table(spark, weights[0], "ty", "y", "wy")
    wx = weight_table(spark, weights[1], "tx", "x", "wx")
    found = combine(cells, wy, wx, F.col(value), skipna=skipna, na_thres=na_thres, mean=method == "nearest_d2s" and skipna, time=time)
    found = found.select(time, F.col("ty").alias("y"), F.col("tx").alias("x"), "value")
    bare_y, bare_x = (sorted(set(range(len(a))) - {w[0] for w in own}) for a, own in zip(target, weights, strict=True))
    if not bare_y and not bare_x:
        return found
    # cells are dense, so every reached target cell has a row already; the others are added without a join
    grid = spark.range(len(target[0]) * len(target[1])).select((F.col("id") / len(target[1])).cast("int").alias("y"), (F.col("id") % len(target[1])).cast("int").alias("x"))
    rest = grid.where(F.col("y").isin(bare_y) | F.col("x").isin(bare_x))
    times = cells.select(time).distinct()
    return found.unionByName(rest.crossJoin(F.broadcast(times) if times.count() <= BROADCAST_ROWS else times).select(time, "y", "x", F.lit(None).cast("double").alias("value")))

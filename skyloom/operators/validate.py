"""Checks of products: samples against sources, domains, structure, and regrid arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .axes import Axis, spread_positions
from .regrid import axis_weights, valid_threshold


def probe_cells(spark: SparkSession, shape: tuple[int, int, int], times: int = 3) -> DataFrame:
    """A fixed scattering of cells: first, middle and last times, each with its own cell."""
    nt, ny, nx = shape
    rows = [(t, (t * 104729 + 1) % ny, (t * 130363 + 3) % nx) for t in spread_positions(nt, times)]
    return spark.createDataFrame(rows, "ti int, y int, x int")


def mismatches(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """Keys whose values differ, or that one side lacks; NULL equals NULL."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("x_left"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("x_right"))
    both = a.join(b, list(keys), "full")
    off = F.abs(F.col("left_value") - F.col("right_value")) > tolerance * F.greatest(F.lit(1.0), F.abs("left_value"))
    wrong = F.col("x_left").isNull() | F.col("x_right").isNull() | (F.col("left_value").isNull() != F.col("right_value").isNull()) | F.coalesce(off, F.lit(False))
    return both.where(wrong).select(*keys, "left_value", "right_value")


def identical(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats included."""
    same = sorted(left.columns) == sorted(right.columns)
    right = right.select(*left.columns) if same else right
    return same and left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def domain_report(cells: DataFrame, value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """One row: counts of cells, finite values and values outside the domain, and the range.  It warns, never fails."""
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v.cast("double"))
    below = v < low if low is not None else F.lit(False)
    above = v > high if high is not None else F.lit(False)
    return cells.agg(F.count("*").alias("n_cells"), F.count_if(finite).alias("n_finite"), F.count_if(finite & below).alias("n_below"), F.count_if(finite & above).alias("n_above"), F.min(F.when(finite, v)).alias("least"), F.max(F.when(finite, v)).alias("most"))


def expected_domain(name: str, attrs: dict) -> tuple[float | None, float | None]:
    """Domain from the attributes; names of uncertainties imply values of at least zero."""
    low, high = attrs.get("valid_min"), attrs.get("valid_max")
    described = " ".join([name, *(str(attrs.get(k, "")) for k in ("standard_name", "long_name"))]).lower()
    if low is None and ("uncertainty" in described or "standard_error" in described or "standard error" in described):
        low = 0.0
    return low, high


def structure_problems(found: DataFrame, expected: dict[str, str]) -> list[str]:
    """Columns that lack, differ in type, or are not expected."""
    types = dict(found.dtypes)
    lacking = [f"no {c}" for c in expected if c not in types]
    other = [f"{c} is {types[c]}, not {k}" for c, k in expected.items() if c in types and types[c] != k]
    return lacking + other + [f"unexpected {c}" for c in types if c not in expected]


def dense_regrid(values: np.ndarray, source: tuple[Axis, Axis], target: tuple[Axis, Axis], method: str, *, skipna: bool = True, na_thres: float = 1.0) -> np.ndarray:
    """The same regridding of one small map with dense weight matrices, for checks."""
    def matrix(a: Axis, b: Axis) -> np.ndarray:
        out = np.zeros((len(b), len(a)))
        for j, i, w in axis_weights(method, a, b, periodic=a.periodic and b is target[1]):
            out[j, i] += w
        return out

    wy, wx = matrix(source[0], target[0]), matrix(source[1], target[1])
    valid = np.isfinite(values)
    num = wy @ np.where(valid, values, 0) @ wx.T
    den = wy @ valid.astype(float) @ wx.T
    holes = (wy != 0).astype(float) @ (~valid).astype(float) @ (wx != 0).astype(float).T
    some = (wy != 0).any(axis=1)[:, None] & (wx != 0).any(axis=1)[None, :]
    if method == "nearest_d2s" and skipna:
        keep = den > 0
    elif skipna:
        keep = den >= valid_threshold(na_thres)
    else:
        return np.where(some & (holes == 0), num, np.nan)
    return np.where(some & keep, num / np.where(den == 0, 1, den), np.nan)


def within(observed: Column, expected: Column, item_size: int) -> Column:
    """Whether a value agrees up to its storage precision."""
    tolerance = 5e-5 if item_size <= 4 else 1e-10
    return F.abs(observed - expected) <= tolerance * F.greatest(F.lit(1.0), F.abs(expected))

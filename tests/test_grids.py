"""Axes, regridding and selection."""

from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import axes, regrid, select, validate

METHODS = list(axes.METHODS)


def axis(n, low=0.0, step=1.0, descending=False):
    centres = low + (np.arange(n) + 0.5) * step
    return axes.inspect_axis(centres[::-1] if descending else centres)


def test_edges_and_checks():
    assert axes.edges_of([3.5, 2.5, 1.5]).tolist() == [4, 3, 2, 1]
    noisy = axes.inspect_axis(np.float32(0.1) * np.arange(100, dtype=np.float32) + np.float32(0.05))
    assert abs(noisy.resolution - 0.1) < 1e-6
    for bad in ([1.0], [1.0, 1.0], [0, 1, 3], [0, 1, np.nan], [0, 1, 0.5]):
        with pytest.raises(axes.GridError):
            axes.inspect_axis(bad)


def test_targets():
    source = axis(4)
    outward = axes.target_axis(3.0, False, source=source)
    assert outward.edges.tolist() == [0, 3, 6]
    assert len(axes.target_axis(3.0, True, extent="global", bounds=axes.global_bounds("lat"))) == 60
    assert len(axes.target_axis(3.0, False, extent="global", bounds=axes.global_bounds("lon"))) == 120
    with pytest.raises(axes.GridError):
        axes.target_axis(0.7, False, extent="custom", bounds=(0, 1))
    with pytest.raises(axes.GridError):
        axes.target_axis(-1, False, source=source)
    assert axis(36, -180, 10).periodic and not axis(35, -180, 10).periodic


def test_equality_within_noise():
    source = axis(100, 0, 0.05)
    noise = axes.Axis(source.centres.astype(np.float32).astype(float), source.edges, source.resolution)
    assert axes.matching_slice(noise, source) == (0, 100)
    part = axes.Axis(source.centres[10:20], source.edges[10:21], source.resolution)
    assert axes.matching_slice(source, part) == (10, 20)
    shifted = axes.Axis(source.centres + 0.025, source.edges + 0.025, source.resolution)
    assert axes.matching_slice(source, shifted) is None


def test_read_windows():
    a = axis(10)
    assert axes.read_window(a, 2.0, 4.0, "conservative") == (2, 4)
    assert axes.read_window(a, 2.0, 4.0, "bilinear") == (1, 5)
    assert axes.read_window(a, 2.0, 4.0, "patch") == (0, 6)
    assert axes.read_window(a, 2.0, 4.0, "nearest_s2d") == (2, 4)
    assert axes.read_window(a, 20.0, 24.0, "conservative") == (8, 10)
    assert axes.read_window(axis(10, descending=True), 2.0, 4.0, "conservative") == (6, 8)


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("options", [{}, {"skipna": False}, {"na_thres": 0.25}])
def test_plans_agree_with_dense_matrices(spark, method, options):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(7, 9)).round(3)
    values[2, 3] = values[6, 0] = np.nan
    source, target = (axis(7, descending=True), axis(9)), (axis(6, -1, 1.5, True), axis(5, 0.2, 2.1))
    cells = spark.createDataFrame([(1, i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(values)], "t int, y int, x int, v double")
    out = regrid.regrid(cells, source, target, method, **options).collect()
    expected = validate.dense_regrid(values, source, target, method, **options)
    assert len(out) == expected.size
    for r in out:
        e = expected[r.y, r.x]
        assert (r.value is None) == np.isnan(e)
        assert r.value is None or abs(r.value - e) < 1e-9


@pytest.mark.parametrize("method", METHODS)
def test_constants_stay_constant(spark, method):
    source, target = (axis(8), axis(8)), (axis(5, 1, 1.1), axis(5, 1, 1.1))
    cells = spark.range(64).select(F.lit(1).alias("t"), (F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"), F.lit(2.5).alias("v"))
    values = [r.value for r in regrid.regrid(cells, source, target, method).collect() if r.value is not None]
    assert values and max(abs(v - 2.5) for v in values) < 1e-9


def test_area_is_conserved_on_the_sphere():
    source, target = axis(180, -90), axis(60, -90, 3)
    weights = regrid.overlap_weights(source, target, normed=False, sphere=True)
    totals = {}
    for j, _, w in weights:
        totals[j] = totals.get(j, 0) + w
    assert all(abs(t - 1) < 1e-9 for t in totals.values())


def test_periodic_nearest():
    source = axes.inspect_axis([-135.0, -45, 45, 135])
    target = axes.target_axis(72.0, False, extent="custom", bounds=(0, 360))
    picks = dict((j, i) for j, i, _ in regrid.nearest_source_weights(source, target, periodic=True))
    assert picks[4] == 1


def test_selection():
    a = axis(10)
    assert select.index_window(a, 7.9, 2.1) == (2, 8)
    with pytest.raises(select.SelectionError):
        select.index_window(a, 20, 30)
    assert select.date_span("2001", "2002-02") == (date(2001, 1, 1), date(2002, 2, 28))
    assert select.choose_variables(["a", "b"], ["b", "b"]) == ["b"] and select.choose_variables(["a"], None) == ["a"]
    for wanted in ([], ["c"]):
        with pytest.raises(select.SelectionError):
            select.choose_variables(["a"], wanted)
    for names in ({"a": "lat"}, {"a": " "}, {"a": "x/y"}, {"a": "c", "b": "c"}):
        with pytest.raises(select.SelectionError):
            select.check_renames(names)
    assert select.parse_range_list("[2001-01-01, 2022-12-31]") == ["2001-01-01", "2022-12-31"]
    assert select.parse_range_list("[1, -2.5]") == [1, -2.5] and select.parse_range_list(" ") is None
    with pytest.raises(select.SelectionError):
        select.parse_range_list("1, 2")


def test_pushed_filters(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").cast("int").alias("y"), F.lit(1).alias("x"), F.lit(2.0).alias("v"), F.lit(3.0).alias("other"))
    rows.write.parquet(str(tmp_path / "c"))
    plan = spark.read.parquet(str(tmp_path / "c")).where(select.cell_window((3, 7))).select("v")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(y,3)" in plan and "other" not in plan

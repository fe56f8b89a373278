"""Inventories of named files, reports, and the command line."""

from __future__ import annotations

import json
from datetime import date

import numpy as np
import pytest

from skyloom.__main__ import main
from skyloom.operators.catalog import CatalogError
from skyloom.plans import inventory
from skyloom.sources import files, netcdf3, zarr


def write(path, value, attrs=None):
    netcdf3.write_classic(str(path), {"latitude": 2, "longitude": 3}, {"latitude": (["latitude"], np.array([20.0, 10]), {}), "longitude": (["longitude"], np.array([1.0, 2, 3]), {}), "v": (["latitude", "longitude"], np.full((2, 3), value, "i2"), attrs or {"missing_value": np.int16(-99)})})


def test_missing_date_becomes_a_missing_map(spark, tmp_path):
    for i, doy in enumerate((1, 5, 13)):
        write(tmp_path / f"product_2001{doy:03d}.nc", i)
    found = inventory.inspect_named_files(spark, str(tmp_path))
    assert found.missing == [date(2001, 1, 9)] and "1 missing" in found.describe() and found.variables == ["v"]
    rows = sorted((r.t, r.path.removeprefix("file:")) for r in found.times.collect())
    cells = files.named_cells(spark, [p for _, p in rows], [t for t, _ in rows], "v")
    whole = inventory.completed(cells, found)
    assert whole.count() == 24 and whole.where("v is null").count() == 6


def test_files_that_differ_are_refused(spark, tmp_path):
    write(tmp_path / "p_20010101.nc", 1)
    write(tmp_path / "p_20010102.nc", 1, {"missing_value": np.int16(-1)})
    with pytest.raises(CatalogError):
        inventory.inspect_named_files(spark, str(tmp_path))


def test_tree_report(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    write(tmp_path / "a" / "x_2001001.nc", 1)
    (tmp_path / "b" / "y.tif").write_bytes(b"II*\0")
    report = inventory.tree_report(str(tmp_path), str(tmp_path / "r.json"))
    assert report["a"]["axes"]["latitude"]["direction"] == "descending" and "error" in report["b"]
    assert json.loads((tmp_path / "r.json").read_text())["a"]["files"] == 1
    assert main(["validate-raw", str(tmp_path)]) == 0


def test_command_line(spark, tmp_path, capsys):
    store = str(tmp_path / "s.zarr")
    zarr.create_store(store, {"time": np.arange(2), "lat": np.array([1.5, 0.5]), "lon": np.array([0.5, 1.5])}, {"v": ("float64", None, {})}, (2, 2, 2), [{"name": "bytes"}])
    chunk = spark.createDataFrame([("v", 0, 0, 0, [2, 2, 2], [float(i) for i in range(8)])], "var string, ct int, cy int, cx int, shape array<int>, data array<double>")
    zarr.write_chunks(chunk, store)
    common = ["--input", store, "--variable", "v", "--output", str(tmp_path / "o"), "--temporary", str(tmp_path)]
    assert main(["resample", *common, "--resolution", "2", "--dry-run"]) == 0 and not (tmp_path / "o").exists()
    assert main(["resample", *common, "--resolution", "2", "--after-conditions", ">3", "--after-results", "0"]) == 0
    assert sorted(r.v for r in files.read_parquet_cube(spark, str(tmp_path / "o")).collect()) == [0, 1.5]
    assert "resample: executed_as_stage" in capsys.readouterr().out

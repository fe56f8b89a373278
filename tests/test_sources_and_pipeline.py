"""Stores, classic files, publication, the planner and streaming."""

from __future__ import annotations

import json
import math
from datetime import date, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import layout, validate
from skyloom.plans import pipeline, publish
from skyloom.sources import files, netcdf3, zarr
from skyloom.streaming import incremental

BYTES = {"name": "bytes", "configuration": {"endian": "little"}}


@pytest.mark.parametrize("codec", [[], [{"name": "zstd", "configuration": {"level": 3}}], [{"name": "gzip", "configuration": {"level": 1}}]])
def test_store_round_trip(spark, tmp_path, codec):
    shape, store = (5, 4, 6), str(tmp_path / "s.zarr")
    plan = layout.plan_chunks(shape, 8, "custom", custom=(2, 3, 4))
    zarr.create_store(store, {"time": np.arange(5), "lat": np.linspace(2, -2, 4), "lon": np.arange(6.0)}, {"v": ("float32", None, {"units": "K"})}, plan.chunks, [BYTES, *codec])
    cells = spark.range(120).where("id % 11 <> 0").select((F.col("id") / 24).cast("int").alias("ti"), (F.col("id") / 6 % 4).cast("int").alias("y"), (F.col("id") % 6).cast("int").alias("x"), F.col("id").cast("double").alias("v"))
    packed = layout.pack(cells, plan, shape).withColumn("var", F.lit("v"))
    assert zarr.write_chunks(packed, store) == 12
    back = zarr.read_cells(spark, store, "v").where("v is not null")
    assert validate.identical(back, cells)
    arrays, _ = zarr.read_arrays(store)
    assert zarr.read_axis(store, arrays["lat"]).tolist() == np.linspace(2, -2, 4).tolist()
    assert zarr.read_chunks(spark, store, lat="3:4", time="0:2").count() == 2
    assert files.inspect(store)["variables"]["v"]["chunks"] == [2, 3, 4] and files.direct_variables(files.inspect(store)) == ["v"]


def test_stores_that_are_refused(tmp_path):
    with pytest.raises(zarr.StoreError):
        zarr.read_arrays(str(tmp_path))
    (tmp_path / "zarr.json").write_text(json.dumps({"zarr_format": 2, "node_type": "group"}))
    with pytest.raises(zarr.StoreError):
        zarr.read_arrays(str(tmp_path))


def test_shuffles_are_undone():
    values = np.arange(64, dtype="<i4")
    raw = values.tobytes()
    bytes_ = np.frombuffer(raw, np.uint8).reshape(64, 4).T.tobytes()
    assert zarr._unshuffle(bytes_, 4, 1) == raw
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(64, 4), axis=1, bitorder="little").T
    assert zarr._unshuffle(np.packbits(bits, axis=1, bitorder="little").tobytes(), 4, 4) == raw


def test_classic_files(spark, tmp_path):
    values = np.arange(24, dtype="f4").reshape(2, 3, 4)
    values[1, 1, 1] = np.nan
    marks = np.arange(6, dtype="i2").reshape(2, 3)
    path = str(tmp_path / "a.nc")
    netcdf3.write_classic(path, {"time": None, "lat": 3, "lon": 4}, {"lat": (["lat"], np.array([3.0, 2, 1]), {"units": "degrees_north"}), "v": (["time", "lat", "lon"], values, {"_FillValue": -9.0}), "m": (["time", "lat"], marks, {})}, {"title": "x"})
    header = netcdf3.read_header(path)
    assert header.dims == {"time": 2, "lat": 3, "lon": 4} and header.attrs == {"title": "x"} and header.variables["v"].attrs == {"_FillValue": -9.0}
    assert netcdf3.read_steps(path, header, "lat", 0, 3).tolist() == [3, 2, 1]
    got = {(r.var, tuple(r.i)): r.v for r in netcdf3.read_cells(spark, [path], ["v", "m"], stepsPerTask="1").collect()}
    assert len(got) == 30 and got["v", (1, 2, 3)] == 23 and math.isnan(got["v", (1, 1, 1)]) and got["m", (1, 2)] == 5
    assert files.inspect(path)["reader"] == "netcdf3"
    with pytest.raises(netcdf3.FormatError):
        netcdf3.parse_header(b"HDF\1" + b"0" * 40)


def test_two_dimensional_files_join_their_dates(spark, tmp_path):
    paths = []
    for i in range(3):
        paths.append(str(tmp_path / f"p_200100{i + 1}.nc"))
        netcdf3.write_classic(paths[-1], {"lat": 2, "lon": 2}, {"v": (["lat", "lon"], np.full((2, 2), i, "i2"), {})})
    cells = files.named_cells(spark, paths, [date(2001, 1, i + 1) for i in range(3)], "v")
    assert cells.where("t = date'2001-01-03'").agg(F.sum("v")).first()[0] == 8


def cube(spark, lat, lon, days=4):
    rows = [(date(2001, 1, 1) + timedelta(days=d), i, j, float(100 * d + 10 * i + j)) for d in range(days) for i in range(len(lat)) for j in range(len(lon))]
    return spark.createDataFrame(rows, "t date, y int, x int, v double")


LAT, LON = [3.5, 2.5, 1.5, 0.5], [0.5, 1.5, 2.5, 3.5]


@pytest.mark.parametrize(
    "config,resample,shape",
    [
        (pipeline.Config(), "not_requested", (4, 4, 4)),
        (pipeline.Config(lat=(0, 2), rechunk=True, recompress=True), "not_requested", (4, 2, 4)),
        (pipeline.Config(resample=True, resolution=1.0), "satisfied_as_noop", (4, 4, 4)),
        (pipeline.Config(resample=True, resolution=1.0, lat=(1, 3), lon=(0, 2)), "satisfied_as_noop", (4, 2, 2)),
        (pipeline.Config(resample=True, resolution=1.0, lat=(0.5, 3.5)), "executed_as_stage", (4, 3, 4)),
        (pipeline.Config(resample=True, resolution=1.0, after=("<5", "5")), "executed_as_stage", (4, 4, 4)),
        (pipeline.Config(resample=True, resolution=2.0, method="bilinear"), "executed_as_stage", (4, 2, 2)),
    ],
)
def test_decisions(config, resample, shape):
    plan = pipeline.build_plan(LAT, LON, 4, config)
    assert plan.decisions["resample"] == resample and plan.shape == shape
    assert plan.decisions["rechunk"] == ("fused" if config.rechunk else "not_requested")
    assert "source window" in plan.explain()


def test_contradictions():
    for config in (pipeline.Config(before=("<0", "0")), pipeline.Config(resample=True), pipeline.Config(resample=True, resolution=1, method="x")):
        with pytest.raises(ValueError):
            pipeline.build_plan(LAT, LON, 4, config)


def test_product_of_a_turned_grid(spark):
    cells = cube(spark, LAT[::-1], LON)
    plan = pipeline.build_plan(LAT[::-1], LON, 4, pipeline.Config(resample=True, resolution=1.0))
    out = {(r.t.day, r.y, r.x): r.v for r in pipeline.product(cells, plan).collect()}
    assert out[1, 0, 0] == 30 and out[1, 3, 0] == 0


def test_uncovered_cells_are_missing(spark):
    plan = pipeline.build_plan(LAT, LON, 4, pipeline.Config(resample=True, resolution=1.0, lat=(-2, 4), method="conservative_normed"))
    out = {(r.t.day, r.y, r.x): r.v for r in pipeline.product(cube(spark, LAT, LON), plan).collect()}
    assert len(out) == 4 * 6 * 4 and out[1, 5, 0] is None and out[1, 3, 0] == 30
    assert plan.warnings


def test_run_publishes_once(spark, tmp_path):
    target = tmp_path / "out"
    config = pipeline.Config(resample=True, resolution=2.0, after=("<mean", "mean"), rechunk=True, chunks=(2, 1, 2), recompress=True, codec="zstd", level=3)
    result = pipeline.run(cube(spark, LAT, LON), LAT, LON, config, str(target), str(tmp_path / "jobs"))
    assert result.rows == 4 * 2 * 2
    got = files.read_parquet_cube(spark, str(target))
    assert got.agg(F.min("v")).first()[0] == got.agg(F.percentile("v", 0.0)).first()[0] > 0
    manifest = json.loads((result.job / publish.MANIFEST).read_text())
    assert manifest["status"] == "succeeded" and manifest["schema"] == 6
    with pytest.raises(publish.PublishError):
        pipeline.run(cube(spark, LAT, LON), LAT, LON, config, str(target), str(tmp_path / "jobs"))
    pipeline.run(cube(spark, LAT, LON), LAT, LON, pipeline.Config(), str(target), str(tmp_path / "jobs"), overwrite=True)
    assert files.read_parquet_cube(spark, str(target)).count() == 64
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".out")]


def test_a_failed_run_goes_on(spark, tmp_path, monkeypatch):
    config = pipeline.Config(resample=True, resolution=2.0, after=("<mean", "mean"))
    whole = pipeline.write_product

    def broken(*a, **k):
        job = publish.newest_manifest(tmp_path / "jobs").parent
        assert (job / "resampled").exists()
        raise RuntimeError("disk gone")

    monkeypatch.setattr(pipeline, "write_product", broken)
    with pytest.raises(RuntimeError):
        pipeline.run(cube(spark, LAT, LON), LAT, LON, config, str(tmp_path / "out"), str(tmp_path / "jobs"))
    monkeypatch.setattr(pipeline, "write_product", whole)
    result = pipeline.resume(spark, LAT, LON, str(tmp_path / "out"), str(tmp_path / "jobs"))
    assert result.rows == 16
    manifest = json.loads((result.job / publish.MANIFEST).read_text())
    assert manifest["status"] == "succeeded" and "disk gone" in manifest["error_history"][0]
    with pytest.raises(publish.PublishError):
        publish.inspect_recovery(result.job / publish.MANIFEST)


def test_publication_restores_the_old_product(tmp_path, monkeypatch):
    old, new = tmp_path / "p", tmp_path / "n"
    old.mkdir(), new.mkdir()
    (old / publish.PRODUCT_MARK).write_text("{}")
    real = publish.os.replace

    def fail(a, b):
        if Path(a) == new:
            raise OSError("no")
        real(a, b)

    monkeypatch.setattr(publish.os, "replace", fail)
    with pytest.raises(OSError):
        publish.publish(new, old, overwrite=True)
    assert (old / publish.PRODUCT_MARK).exists()


def test_targets_that_are_refused(tmp_path):
    (tmp_path / "f").write_text("x")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x").write_text("x")
    (tmp_path / "l").symlink_to(tmp_path / "d")
    for name in ("f", "d", "l"):
        with pytest.raises(publish.PublishError):
            publish.check_target(tmp_path / name, True)
    publish.check_target(tmp_path / "new", False)
    publish.check_writable(tmp_path)
    with pytest.raises(publish.PublishError):
        publish.check_capacity(tmp_path, 1 << 60)


def test_followed_folder(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("int").alias("x"), F.lit(1.0).alias("v")).write.parquet(str(tmp_path / "in"))
    run = lambda: incremental.ingest(incremental.follow(spark, str(tmp_path / "in"), "x int, v double"), lambda b: b, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(3, 2.0)], "x int, v double").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {r.x: r.v for r in incremental.merged(spark, str(tmp_path / "out"), ["x"], "v").collect()}
    assert len(got) == 10 and got[3] == 2.0 and got[4] == 1.0


def test_zarr_keeps_zeros_and_wide_integers(spark, tmp_path):
    """Zeros are values, integers beyond 2**53 keep their digits, marked cells are missing."""
    import numpy as np

    from skyloom.operators import layout
    from skyloom.sources import zarr

    path, big = str(tmp_path / "store"), (1 << 53) + 1
    axes = {"time": np.arange(1), "lat": np.array([2.0, 1.0]), "lon": np.array([0.0, 1.0])}
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 1}}]
    zarr.create_store(path, axes, {"whole": ("int64", None, {}), "marked": ("int32", -9.0, {"_FillValue": -9}), "real": ("float32", None, {})}, (1, 2, 2), codecs)
    plan = layout.plan_chunks((1, 2, 2), 8, "custom", custom=(1, 2, 2))
    cells = lambda v, kind: spark.createDataFrame([(0, i // 2, i % 2, x) for i, x in enumerate(v)], f"ti int, y int, x int, v {kind}")
    for name, values, kind in (("whole", [0, 5, big, -big], "long"), ("marked", [0, None, 7, 9], "long"), ("real", [0.0, None, 7.5, 9.0], "double")):
        zarr.write_chunks(layout.pack(cells(values, kind), plan, (1, 2, 2)).selectExpr(f"'{name}' as var", "*"), path)
        back = {(r.y, r.x): r.v for r in zarr.read_cells(spark, path, name).collect()}
        assert [back[i // 2, i % 2] for i in range(4)] == values


def test_dates_do_not_depend_on_the_session_zone(spark):
    from pyspark.sql import functions as F

    from skyloom.functions import timeaxis

    rows = spark.createDataFrame([(k,) for k in (0, 1, 150, 200)], "n int")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            days = [str(r.t) for r in rows.select("n", timeaxis.decoded_time(F.col("n"), "days since 2001-07-01").alias("t")).orderBy("n").collect()]
            assert days == ["2001-07-01", "2001-07-02", "2001-11-28", "2002-01-17"]
            hours = [str(r.t) for r in rows.select("n", timeaxis.decoded_time(F.col("n"), "hours since 2001-07-01 23:30:00").alias("t")).orderBy("n").collect()]
            assert hours == ["2001-07-01", "2001-07-02", "2001-07-08", "2001-07-10"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for units, calendar in (("months since 2001-01-01", "standard"), ("days since 2001-01-01", "360_day"), ("days", "standard")):
        with pytest.raises(timeaxis.TimeAxisError):
            timeaxis.decoded_time(F.col("n"), units, calendar)

"""Chunk plans, packing, codecs, catalogue and snapshots."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skyloom.operators import catalog, layout, validate


def test_chunk_plans():
    assert layout.plan_chunks((10, 20, 30), 4, "time").chunks == (10, 20, 30)
    big = layout.plan_chunks((365, 3600, 7200), 4, "time", mib=128)
    assert big.chunks[0] == 365 and big.chunks[1] % 16 == 0 and big.bytes(4) <= 129 << 20
    assert layout.plan_chunks((365, 1800, 3600), 4, "space", mib=128).chunks == (5, 1800, 3600)
    assert layout.plan_chunks((9, 9, 9), 4, "custom", custom=(3, 4, 5)).counts((9, 9, 9)) == (3, 3, 2)
    for bad in ((1, 2), (0, 1, 1), (10, 1, 1), (1.5, 1, 1)):
        with pytest.raises(layout.LayoutError):
            layout.plan_chunks((9, 9, 9), 4, "custom", custom=bad)
    assert layout.target_mib(1000) == 256 and layout.target_mib(1) == 32 and layout.target_mib(200, 4000, 4) == 100


@pytest.mark.parametrize("holes", [False, True])
def test_pack_and_unpack(spark, holes):
    shape = (5, 4, 6)
    cells = spark.range(120).select((F.col("id") / 24).cast("int").alias("ti"), (F.col("id") / 6 % 4).cast("int").alias("y"), (F.col("id") % 6).cast("int").alias("x"), F.col("id").alias("v"))
    if holes:
        cells = cells.where("v % 7 <> 0")
    first, second = (layout.plan_chunks(shape, 8, "custom", custom=c) for c in ((2, 3, 4), (5, 1, 6)))
    packed = layout.pack(cells, first, shape)
    assert packed.count() == 3 * 2 * 2
    again = layout.unpack(layout.rechunk(packed, first, second, shape), second).where("v is not null")
    assert validate.identical(again, cells.select("ti", "y", "x", "v"))


def test_one_shuffle(spark):
    cells = spark.range(100).select(F.lit(1).alias("ti"), F.col("id").cast("int").alias("y"), F.lit(1).alias("x"), F.col("id").alias("v"))
    plan = layout.laid_out(cells, layout.plan_chunks((2, 100, 2), 8, "custom", custom=(1, 10, 1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_codecs():
    assert layout.choose_codec("speed") == layout.Codec("blosc-zstd", 1)
    assert layout.choose_codec(codec="gzip", level=9).level == 9
    for bad in ({"profile": "x"}, {"codec": "zstd", "level": 30}, {"codec": "gzip", "shuffle": "shuffle"}, {"codec": "q"}):
        with pytest.raises(layout.LayoutError):
            layout.choose_codec(**bad)
    assert [layout.automatic_shuffle(d) for d in ("int16", "int8", "float32", "bool", "datetime64[ns]", "float64")] == ["bitshuffle", "noshuffle", "shuffle", "bitshuffle", "bitshuffle", "shuffle"]
    assert len(layout.candidate_codecs(["int16", "float32", "bool"])) <= 8
    assert layout.candidate_codecs(["int16"], layout.Codec("gzip", 1)) == [layout.Codec("gzip", 1)]


def test_smaller_at_equal_speed_dominates(spark):
    rows = spark.createDataFrame([(0, 10.0, 5.0), (1, 10.0, 4.0), (2, 12.0, 9.0)], "k int, speed double, bytes double")
    assert sorted(r.k for r in layout.pareto_front(rows, "k", ["speed"], ["bytes"]).collect()) == [1, 2]


def test_listing_and_snapshot(spark, tmp_path):
    folder = tmp_path / "in" / "sub"
    folder.mkdir(parents=True)
    for name in ("b.nc", "a.nc", "c.txt"):
        (folder / name).write_bytes(b"x" * len(name))
    files = catalog.list_files(spark, str(tmp_path / "in"))
    assert [r.path[-4:] for r in files.collect()] == ["a.nc", "b.nc"] and catalog.one_suffix(files) == ".nc"
    catalog.save_snapshot(str(tmp_path / "s.json"), files, {"mode": "filename"})
    known, meta = catalog.load_snapshot(spark, str(tmp_path / "s.json"))
    assert meta == {"mode": "filename"}
    new, reused = catalog.split_changes(files, known)
    assert (new.count(), reused.count()) == (0, 2)
    (tmp_path / "s.json").write_text('{"version": 1, "files": [], "meta": {}}')
    with pytest.raises(catalog.CatalogError):
        catalog.load_snapshot(spark, str(tmp_path / "s.json"))
    (folder / "d.hdf").write_bytes(b"x")
    with pytest.raises(catalog.CatalogError):
        catalog.one_suffix(catalog.list_files(spark, str(tmp_path / "in")))


def test_dimension_names():
    assert catalog.spatial_dims(["time", "Latitude", "lon"]) == ("Latitude", "lon")
    assert catalog.spatial_dims(["YDim:g", "XDim:g"]) == ("YDim:g", "XDim:g")
    assert catalog.spatial_dims(["a", "b"], {"a": {"axis": "Y"}, "b": {"standard_name": "longitude"}}) == ("a", "b")
    assert catalog.dimension_map(["t", "a", "b"], ["t", "a", "b"])["lat"] == "a"
    for dims, given in ((["t", "a"], None), (["t", "a", "b"], ["t", "a", "a"])):
        with pytest.raises(catalog.CatalogError):
            catalog.dimension_map(dims, given)
    assert catalog.mode_of(["time", "lat", "lon"]) == "dimension" and catalog.mode_of(["lat", "lon"]) == "filename"
    assert catalog.reader_for(".tif") == "geotiff" and catalog.reader_for(".nc", "zarr") == "zarr"

"""Codec measurement, layout shortcuts and small planner helpers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skyloom.functions import timeaxis
from skyloom.operators import layout
from skyloom.plans import pipeline, publish, tuning


def test_measured_codecs(spark, tmp_path):
    sample = spark.range(2000).select(F.col("id"), (F.col("id") % 7).cast("double").alias("v"))
    codecs = [layout.Codec("none"), layout.Codec("zstd", 3), layout.Codec("gzip", 1)]
    trials = tuning.measure_codecs(sample, str(tmp_path), codecs).collect()
    assert all(t.verified and t.feasible for t in trials) and trials[1].bytes < trials[0].bytes
    assert not any(t.feasible for t in tuning.measure_codecs(sample, str(tmp_path), codecs[:1], free_bytes=1).collect())
    assert tuning.best_codec(sample, str(tmp_path), ["float64"], explicit=codecs[1]) == codecs[1]
    assert tuning.best_codec(sample, str(tmp_path), ["float64"], "compact") in layout.candidate_codecs(["float64"])


def test_partition_sizes(spark):
    assert tuning.partitions_for(1 << 40) == 8192 and tuning.partitions_for(1) == 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert tuning.size_session(spark, 1 << 30, 6) == 12
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_layout_changes():
    a, b = layout.ChunkPlan("custom", (1, 2, 3)), layout.ChunkPlan("custom", (3, 2, 1))
    zstd, gzip = layout.Codec("zstd", 1), layout.Codec("gzip", 1)
    assert [layout.same_layout(a, a, zstd, zstd), layout.same_layout(a, a, zstd, gzip), layout.same_layout(a, b, zstd, zstd)] == ["copy", "recompress", "rechunk"]
    assert layout.regridded_chunks((64, 512, 512), (10, 600, 400)) == (10, 512, 400)


def test_copies_and_names(tmp_path):
    source = tmp_path / "p.zarr"
    source.mkdir()
    (source / "zarr.json").write_text("{}")
    publish.copy_product(str(source), str(tmp_path / "q.zarr"))
    assert (tmp_path / "q.zarr" / "zarr.json").exists()
    assert publish.next_output(str(source)).name == "p_rechunked_1.zarr"
    (source / "l").symlink_to(source / "zarr.json")
    with pytest.raises(publish.PublishError):
        publish.copy_product(str(source), str(tmp_path / "r.zarr"))
    assert publish.measured_capacity(tmp_path, 100, 10, 100) == 1250
    with pytest.raises(publish.PublishError):
        publish.measured_capacity(tmp_path, 1 << 40, 1, 1 << 30)


def test_time_kinds():
    assert [timeaxis.time_kind("days since 2001-01-01"), timeaxis.time_kind("day", [1, 9]), timeaxis.time_kind("day", [400]), timeaxis.time_kind(None)] == ["full", "doy", "number", None]


def test_provenance():
    plan = pipeline.build_plan([1.5, 0.5], [0.5, 1.5], 1, pipeline.Config(resample=True, resolution=2.0, after=("<0", "0")))
    assert pipeline.provenance(plan)["rules_after"] == "<0 -> 0"

"""One product from an intent: decisions on the driver, one lazy plan, one write.

The planner works out the target grid, the source window with its halo, which
operations become work and which are satisfied already.  Execution is a single
lineage: window, decode, rules, regrid, rules, layout.  Only rules that need
statistics of the regridded product force a barrier, written to the job's folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cube import densify
from ..functions import rules, transforms
from ..operators import axes, layout, regrid, select
from .publish import Job, as_config, check_capacity, inspect_recovery, mark_recovered, newest_manifest, write_product

#: How an operation was carried out.
STAGE, FUSED, NOOP, ABSENT = "executed_as_stage", "fused", "satisfied_as_noop", "not_requested"


class PlanError(ValueError):
    """An intent that contradicts itself or the source."""


@dataclass(frozen=True)
class Config:
    """What the product shall be; everything else follows."""

    time: tuple | None = None
    lat: tuple[float, float] | None = None
    lon: tuple[float, float] | None = None
    fill_values: tuple[float, ...] = ()
    scale: float | None = None
    dtype: str = "float64"
    resample: bool = False
    resolution: float | None = None
    extent: str = "source"
    method: str = "conservative"
    skipna: bool = True
    na_thres: float = 1.0
    sphere: bool = False
    before: tuple[str, str] = ("", "")
    after: tuple[str, str] = ("", "")
    rechunk: bool = False
    strategy: str = "time"
    chunks: tuple[int, ...] | None = None
    target_mib: float = layout.DEFAULT_MIB
    recompress: bool = False
    profile: str = "balanced"
    codec: str | None = None
    level: int | None = None


@dataclass(frozen=True)
class Plan:
    """Everything decided before any data are read."""

    config: Config
    source: tuple[axes.Axis, axes.Axis]
    target: tuple[axes.Axis, axes.Axis]
    window: tuple[tuple[int, int], tuple[int, int]]
    regridding: bool
    before: tuple[rules.Rule, ...]
    after: tuple[rules.Rule, ...]
    chunks: layout.ChunkPlan
    codec: layout.Codec
    decisions: dict[str, str]
    warnings: tuple[str, ...] = ()
    shape: tuple[int, int, int] = (0, 0, 0)

    @property
    def barrier(self) -> bool:
        """Whether rules need statistics of the regridded product."""
        return bool(rules.needs_statistics(self.after))

    def explain(self) -> str:
        """The plan as text."""
        lines = [f"{k}: {v}" for k, v in self.decisions.items()]
        lines += [f"source window y {self.window[0]}, x {self.window[1]}", f"target {len(self.target[0])} x {len(self.target[1])}", f"chunks {self.chunks.chunks}", f"codec {self.codec}"]
        return "\n".join([*lines, *(f"warning: {w}" for w in self.warnings)])


def _sub_axis(axis: axes.Axis, window: tuple[int, int]) -> axes.Axis:
    return axes.Axis(axis.centres[window[0] : window[1]], axis.edges[window[0] : window[1] + 1], axis.resolution)


def _target(source: axes.Axis, name: str, config: Config, bounds: tuple[float, float] | None, descending: bool) -> axes.Axis:
    if config.extent == "global":
        bounds = axes.global_bounds(name)
    extent = "custom" if bounds is not None and config.extent != "global" else config.extent
    return axes.target_axis(config.resolution, descending, extent=extent, source=source, bounds=bounds)


def build_plan(lat: Sequence[float], lon: Sequence[float], times: int, config: Config) -> Plan:
    """Decide target, window, layout and what each operation amounts to."""
    source = (axes.inspect_axis(lat, "lat"), axes.inspect_axis(lon, "lon"))
    before, after = rules.parse_rules(*config.before), rules.parse_rules(*config.after)
    warnings: list[str] = []
    if not config.resample:
        if before or after:
            raise PlanError("replacement rules belong to a regridding")
        window = tuple(select.index_window(a, *b) if b else (0, len(a)) for a, b in zip(source, (config.lat, config.lon), strict=True))
        target = tuple(_sub_axis(a, w) for a, w in zip(source, window, strict=True))
        regridding, resample = False, ABSENT
    else:
        if config.resolution is None or config.method not in axes.METHODS:
            raise PlanError("a regridding needs a resolution and a method")
        target = (_target(source[0], "lat", config, config.lat, True), _target(source[1], "lon", config, config.lon, False))
        # products run from north to south and from west to east, so a source may only need turning
        turned = tuple(_turn(a, t) for a, t in zip(source, target, strict=True))
        slices = [axes.matching_slice(a, t) for a, t in zip(turned, target, strict=True)]
        if None not in slices and not before and not after:
            window = tuple((len(a) - s[1], len(a) - s[0]) if a.descending != t.descending else s for a, t, s in zip(source, target, slices, strict=True))
            regridding, resample = False, NOOP
        else:
            window = tuple((0, len(a)) if name == "lon" and a.periodic else axes.read_window(a, t.low, t.high, config.method) for name, a, t in zip(("lat", "lon"), source, target, strict=True))
            regridding, resample = True, STAGE
            for name, a, t in zip(("lat", "lon"), source, target, strict=True):
                if not (name == "lon" and a.periodic):
                    warnings += [f"{name}: the target reaches beyond the source at its {side} side" for side in axes.uncovered_sides(a, t)]
    shape = (times, len(target[0]), len(target[1]))
    item = 4 if config.dtype == "float32" else 8
    if config.rechunk:
        chunks = layout.plan_chunks(shape, item, "custom" if config.chunks else config.strategy, mib=config.target_mib, custom=config.chunks)
    else:
        chunks = layout.plan_chunks(shape, item, "custom", custom=tuple(min(n, c) for n, c in zip(shape, (64, 512, 512), strict=True)))
    codec = layout.choose_codec(config.profile, config.codec, config.level) if config.recompress else layout.Codec("blosc-zstd", 1)
    decisions = {"convert": STAGE, "resample": resample, "rechunk": FUSED if config.rechunk else ABSENT, "recompress": FUSED if config.recompress else ABSENT}
    return Plan(config, source, target, window, regridding, before, after, chunks, codec, decisions, tuple(warnings), shape)


def _turn(source: axes.Axis, target: axes.Axis) -> axes.Axis:
    return source if source.descending == target.descending else axes.Axis(source.centres[::-1], source.edges[::-1], source.resolution)


def converted(cells: DataFrame, plan: Plan) -> DataFrame:
    """Window and decoding: ``t, y, x, v`` with positions counted from the window."""
    config, (wy, wx) = plan.config, plan.window
    rows = cells.where(select.cell_window(wy, wx))
    if config.time:
        rows = rows.where(select.time_window(*config.time))
    kind = dict(cells.dtypes)["v"]
    name = {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8", "float": "float32", "double": "float64"}[kind]
    value = transforms.decode(F.col("v"), transforms.Transform(config.fill_values, config.scale), name)
    if kind in ("float", "double"):
        value = F.nanvl(value, F.lit(None).cast(kind))
    y, x = (F.col(d) - w[0] for d, w in (("y", wy), ("x", wx)))
    if not plan.regridding:
        y, x = (F.lit(len(t) - 1) - c if s.descending != t.descending else c for c, s, t in zip((y, x), plan.source, plan.target, strict=True))
    return rows.select("t", y.cast("int").alias("y"), x.cast("int").alias("x"), value.alias("v"))


def resampled(rows: DataFrame, plan: Plan) -> DataFrame:
    """Rules before, regridding, and literal rules after; missing cells are rows."""
    config, spark = plan.config, rows.sparkSession
    source = tuple(_sub_axis(a, w) for a, w in zip(plan.source, plan.window, strict=True))
    grid = [rows.select("t").distinct(), *(spark.range(len(a)).select(F.col("id").cast("int").alias(d)) for a, d in zip(source, ("y", "x"), strict=True))]
    dense = densify(rows, grid)
    if plan.before:
        known = rules.statistics(dense, "v", rules.needs_statistics(plan.before)) if rules.needs_statistics(plan.before) else None
        dense = dense.withColumn("v", rules.apply_rules(F.col("v"), dense.schema["v"].dataType, plan.before, known))
    out = regrid.regrid(dense, source, plan.target, config.method, skipna=config.skipna, na_thres=config.na_thres, sphere=config.sphere)
    out = out.withColumnRenamed("value", "v")
    if plan.after and not plan.barrier:
        out = out.withColumn("v", rules.apply_rules(F.col("v"), T.DoubleType(), plan.after))
    return out


def product(cells: DataFrame, plan: Plan, barrier: str | None = None) -> DataFrame:
    """The whole lineage.  ``barrier`` is where a regridded product is kept for its statistics."""
    rows = converted(cells, plan)
    if plan.regridding:
        rows = resampled(rows, plan)
        if plan.barrier:
            if barrier is not None:
                rows.write.mode("overwrite").parquet(barrier)
                rows = cells.sparkSession.read.parquet(barrier)
            rows = rows.withColumn("v", rules.apply_rules(F.col("v"), T.DoubleType(), plan.after, rules.statistics(rows, "v", rules.needs_statistics(plan.after))))
    return rows.withColumn("v", F.col("v").cast(transforms.SPARK_TYPES[plan.config.dtype]))


def with_time_index(rows: DataFrame) -> DataFrame:
    """``ti``: position of each date among the product's dates (an axis, so small)."""
    from pyspark.sql import Window

    axis = rows.select("t").distinct().withColumn("ti", (F.row_number().over(Window.orderBy("t")) - 1).cast("int"))
    return rows.join(F.broadcast(axis), "t")


def preview(lat: Sequence[float], lon: Sequence[float], times: int, config: Config) -> str:
    """The plan without any work."""
    return build_plan(lat, lon, times, config).explain()


def provenance(plan: Plan) -> dict[str, str]:
    """How a product came about, as attributes."""
    config = plan.config
    out = {"chunks": str(plan.chunks.chunks), "codec": plan.codec.name}
    if plan.regridding:
        out |= {
            "resample_method": config.method,
            "resample_skipna": str(config.skipna).lower(),
            "resample_na_thres": str(config.na_thres),
            "source_resolution": f"{plan.source[0].resolution:g},{plan.source[1].resolution:g}",
            "target_resolution": f"{plan.target[0].resolution:g}",
            "target_extent": config.extent,
            "rules_before": "; ".join(f"{r.comparison}{r.threshold.text} -> {r.result.text}" for r in plan.before),
            "rules_after": "; ".join(f"{r.comparison}{r.threshold.text} -> {r.result.text}" for r in plan.after),
        }
    return out


def cancel(spark, group: str) -> None:
    """Stop the jobs of a run that was started with this group."""
    spark.sparkContext.cancelJobGroup(group)


@dataclass
class Result:
    """What a run wrote."""

    rows: int
    decisions: dict[str, str]
    job: Path
    warnings: tuple[str, ...] = field(default=())


def run(cells: DataFrame, lat: Sequence[float], lon: Sequence[float], config: Config, target: str, temporary: str, overwrite: bool = False, group: str | None = None) -> Result:
    """Plan, build, write once, and publish; the job's folder tells how it went.

    With a ``group`` the run can be cancelled, and then be resumed.
    """
    if group:
        cells.sparkSession.sparkContext.setJobGroup(group, "skyloom pipeline", interruptOnCancel=True)
    inside = cells.where(select.time_window(*config.time)) if config.time else cells
    times = inside.select("t").distinct().count()
    plan = build_plan(lat, lon, times, config)
    check_capacity(Path(target).parent, axes.logical_bytes(plan.shape, [8]))
    job = Job.create(Path(temporary), as_config(config))
    try:
        rows = with_time_index(product(cells, plan, str(job.root / "resampled")))
        if plan.regridding and plan.barrier:
            job.finish_stage("resample", str(job.root / "resampled"), -1)
        written = write_product(rows, target, plan.chunks, plan.codec, {"decisions": plan.decisions, "attrs": provenance(plan)}, overwrite)
        job.finish_stage("publish", None, written)
        job.end("succeeded")
    except Exception as error:
        cancelled = "cancelled" in str(error).lower()
        job.end("cancelled" if cancelled else "failed", f"{type(error).__name__}: {error}")
        raise
    return Result(written, plan.decisions, job.root, plan.warnings)


def resume(spark, lat: Sequence[float], lon: Sequence[float], target: str, temporary: str, overwrite: bool = False) -> Result:
    """Go on from the regridded product of the newest failed run."""
    manifest = newest_manifest(Path(temporary))
    if manifest is None:
        raise PlanError("there is no run to resume")
    found = inspect_recovery(manifest)
    settings = {k: tuple(v) if isinstance(v, list) else v for k, v in found.job.manifest["config"].items()}
    config = Config(**settings)
    rows = spark.read.parquet(found.path)
    plan = build_plan(lat, lon, rows.select("t").distinct().count(), config)
    rows = rows.withColumn("v", rules.apply_rules(F.col("v"), T.DoubleType(), plan.after, rules.statistics(rows, "v", rules.needs_statistics(plan.after))))
    rows = with_time_index(rows.withColumn("v", F.col("v").cast(transforms.SPARK_TYPES[config.dtype])))
    written = write_product(rows, target, plan.chunks, plan.codec, {"decisions": plan.decisions}, overwrite)
    mark_recovered(found, cleanup=True)
    return Result(written, plan.decisions, found.job.root, plan.warnings)

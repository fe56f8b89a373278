"""Inventories of source folders: one record a file, checked to form one product.

The driver plans over metadata only; headers are read by the executors, a batch
of files each, and come back as rows.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeaxis
from ..operators import axes, catalog
from ..sources import files, netcdf3, zarr

#: Signature fields of a variable; anything else may differ between files (fixed values).
SIGNATURE_ATTRS = ("_FillValue", "missing_value", "scale_factor", "add_offset", "units")
VARIABLES = "path string, name string, dims string, dtype string, shape string, marks string"


def scan_variables(listing: DataFrame) -> DataFrame:
    """One row for each variable of each file, with what must agree between files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                local = path.removeprefix("file:")
                for name, v in files.inspect(local)["variables"].items():
                    marks = {k: v["attrs"][k] for k in SIGNATURE_ATTRS if k in v["attrs"]}
                    still = [n for d, n in zip(v["dims"], v["shape"], strict=True) if d.lower() not in ("time", "t")]
                    rows.append((path, name, ",".join(v["dims"]), v["dtype"], json.dumps(still), json.dumps(marks, sort_keys=True)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], [f.split()[0] for f in VARIABLES.split(", ")])

    return listing.select("path").mapInArrow(run, VARIABLES)


@dataclass(frozen=True)
class Inventory:
    """What a folder holds, as tables and axes."""

    mode: str
    files: DataFrame
    times: DataFrame
    variables: list[str]
    lat: np.ndarray | None
    lon: np.ndarray | None
    missing: list

    def describe(self) -> str:
        """The inventory as text."""
        count = self.files.agg(F.count("*"), F.sum("size")).first()
        span = self.times.agg(F.min("t"), F.max("t"), F.count("*")).first()
        lines = [f"mode {self.mode}", f"files {count[0]}, {count[1]} bytes", f"times {span[2]} from {span[0]} to {span[1]}, {len(self.missing)} missing", f"variables {', '.join(self.variables)}"]
        for name, axis in (("lat", self.lat), ("lon", self.lon)):
            if axis is not None:
                lines.append(f"{name} {axes.axis_report(axis)}")
        return "\n".join(lines)


def inspect_named_files(spark: SparkSession, folder: str, rule: timeaxis.NameRule | None = None) -> Inventory:
    """Two-dimensional files whose names hold their dates: rule, signature, calendar."""
    listing = catalog.list_files(spark, folder, catalog.NAMED_SUFFIXES)
    catalog.one_suffix(listing)
    names = [r.path.rpartition("/")[2] for r in listing.select("path").toLocalIterator()]
    rule = rule or timeaxis.automatic_rule(names)
    times = listing.select("path", timeaxis.named_date(F.substring_index("path", "/", -1), rule).alias("t"))
    if not times.where("t is null").isEmpty():
        raise timeaxis.TimeAxisError("some names hold no date under the rule")
    if not timeaxis.duplicate_dates(times).isEmpty():
        raise timeaxis.TimeAxisError("two files claim one date")
    wrong = catalog.signature_mismatches(scan_variables(listing)).collect()
    if wrong:
        raise catalog.CatalogError("variables differ: " + "; ".join(f"{r.path} {r.name}" for r in wrong))
    calendar = timeaxis.annual_calendar(times) if rule.template == "doy" else timeaxis.daily_calendar(times, _common_step(times))
    absent = [r.t for r in timeaxis.missing_dates(calendar, times).orderBy("t").collect()]
    first = listing.select("path").first().path.removeprefix("file:")
    info = files.inspect(first)
    lat, lon = catalog.spatial_dims(list(info["dims"]), {n: v["attrs"] for n, v in info["variables"].items()})
    spatial = [n for n, v in info["variables"].items() if {lat, lon} <= set(v["dims"])]
    centres = [_axis_values(first, info, d) for d in (lat, lon)]
    return Inventory("filename", listing, times, spatial, centres[0], centres[1], absent)


def _common_step(times: DataFrame) -> int:
    steps = timeaxis.annual_steps(times).select("step").distinct().collect()
    return min(r.step for r in steps)


def _axis_values(path: str, info: dict, dim: str) -> np.ndarray | None:
    """Values of a coordinate, if the file has one."""
    if dim not in info["variables"]:
        return None
    if info["reader"] == "zarr":
        return zarr.read_axis(path, zarr.read_arrays(path)[0][dim])
    header = netcdf3.read_header(path)
    return netcdf3.read_steps(path, header, dim, 0, header.dims[dim]).astype(float)


def completed(cells: DataFrame, inventory: Inventory) -> DataFrame:
    """Cells of all expected dates: a missing date is a map of missing cells."""
    calendar = inventory.times.select("t").unionByName(timeaxis.calendar_frame(cells.sparkSession, inventory.missing)) if inventory.missing else inventory.times.select("t")
    grid = cells.select("y", "x").distinct().crossJoin(F.broadcast(calendar))  # a row for each date of the inventory, which the driver holds
    return grid.join(cells, ["t", "y", "x"], "left")


def write_report(path: str, report: dict) -> None:
    """Write JSON so that readers see the old report or the new one."""
    fresh = Path(path).with_name(f".{Path(path).name}.{uuid.uuid4().hex}")
    fresh.write_text(json.dumps(report, indent=1, default=str))
    os.replace(fresh, path)


def tree_report(root: str, out: str | None = None, samples: int = 3) -> dict:
    """Each subfolder as a data set: files, readers, axes, and a few raw values or the error met."""
    report: dict = {}
    for folder in sorted(p for p in Path(root).iterdir() if p.is_dir()):
        members = sorted(p for p in folder.rglob("*") if p.suffix.lower() in catalog.NAMED_SUFFIXES)
        entry: dict = {"files": len(members), "suffixes": sorted({p.suffix.lower() for p in members})}
        report[folder.name] = entry
        if not members:
            continue
        try:
            info = files.inspect(str(members[0]))
            entry |= {"reader": info["reader"], "dims": info["dims"], "variables": sorted(info["variables"])}
            entry["axes"] = {d: axes.axis_report(values) for d in info["dims"] if (values := _axis_values(str(members[0]), info, d)) is not None}
            entry["sampled"] = [members[k].name for k in axes.spread_positions(len(members), samples)]
        except (ValueError, OSError) as error:
            entry["error"] = f"{type(error).__name__}: {error}"
    if out:
        write_report(out, report)
    return report


def parse_names(text: Sequence[str] | str | None) -> list[str] | None:
    """Names from a comma list."""
    if text is None:
        return None
    return [x.strip() for x in (text.split(",") if isinstance(text, str) else text) if x.strip()]

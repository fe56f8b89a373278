"""Command line: ``python -m skyloom <command>``; any command plans first and can stop there."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import timeaxis
from .operators import select
from .plans import inventory, pipeline
from .sources import zarr


def parser() -> argparse.ArgumentParser:
    """Options of all commands."""
    root = argparse.ArgumentParser(prog="skyloom")
    commands = root.add_subparsers(dest="command", required=True)
    report = commands.add_parser("validate-raw", help="report on a folder of data sets")
    report.add_argument("root")
    report.add_argument("--out")
    for name in ("convert", "resample", "rechunk", "pipeline"):
        p = commands.add_parser(name, help=f"{name} a store")
        p.add_argument("--input", required=True, help="Zarr v3 store")
        p.add_argument("--variable", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--temporary", default="/tmp")
        p.add_argument("--time", help="[first, last]")
        p.add_argument("--lat", help="[low, high]")
        p.add_argument("--lon", help="[low, high]")
        p.add_argument("--fill", default="", help="raw markers")
        p.add_argument("--scale", type=float)
        p.add_argument("--resolution", type=float)
        p.add_argument("--method", default="conservative")
        p.add_argument("--extent", default="source", choices=("source", "global", "custom"))
        p.add_argument("--no-skipna", action="store_true")
        p.add_argument("--na-thres", type=float, default=1.0)
        for when in ("before", "after"):
            p.add_argument(f"--{when}-conditions", default="")
            p.add_argument(f"--{when}-results", default="")
        p.add_argument("--strategy", default="time", choices=("time", "space", "custom"))
        p.add_argument("--chunks", help="[t, y, x]")
        p.add_argument("--codec")
        p.add_argument("--level", type=int)
        p.add_argument("--overwrite", action="store_true")
        p.add_argument("--dry-run", action="store_true")
    return root


def config_of(args: argparse.Namespace) -> pipeline.Config:
    """The intent of a command."""
    from .functions.transforms import parse_numbers

    chunks = select.parse_range_list(args.chunks or "")
    return pipeline.Config(
        time=select.pair(select.parse_range_list(args.time or ""), "time"),
        lat=select.pair(select.parse_range_list(args.lat or ""), "lat"),
        lon=select.pair(select.parse_range_list(args.lon or ""), "lon"),
        fill_values=parse_numbers(args.fill),
        scale=args.scale,
        resample=args.command == "resample" or args.resolution is not None,
        resolution=args.resolution,
        method=args.method,
        extent=args.extent,
        skipna=not args.no_skipna,
        na_thres=args.na_thres,
        before=(args.before_conditions, args.before_results),
        after=(args.after_conditions, args.after_results),
        rechunk=args.command == "rechunk" or chunks is not None,
        strategy="custom" if chunks else args.strategy,
        chunks=tuple(chunks) if chunks else None,
        recompress=args.codec is not None,
        codec=args.codec,
        level=args.level,
    )


def main(argv: Sequence[str] | None = None) -> int:
    """Run a command; the exit status tells whether it did."""
    args = parser().parse_args(argv)
    if args.command == "validate-raw":
        for name, entry in inventory.tree_report(args.root, args.out).items():
            print(name, entry)
        return 0
    arrays, _ = zarr.read_arrays(args.input)
    lat, lon = (zarr.read_axis(args.input, arrays[d]) for d in ("lat", "lon"))
    config = config_of(args)
    print(pipeline.preview(lat, lon, arrays["time"].shape[0], config))
    if args.dry_run:
        return 0
    spark = SparkSession.builder.appName(f"skyloom {args.command}").getOrCreate()
    times = zarr.read_axis(args.input, arrays["time"])
    axis = spark.createDataFrame([(i, t.item()) for i, t in enumerate(times)], f"ti int, x_time {'double' if times.dtype.kind == 'f' else 'long'}")
    attrs = arrays["time"].attrs
    cells = zarr.read_cells(spark, args.input, args.variable).join(axis, "ti")
    date = timeaxis.decoded_time(F.col("x_time"), str(attrs.get("units", "days since 1970-01-01")), str(attrs.get("calendar", "standard")))
    cells = cells.select(date.alias("t"), "y", "x", F.col("v").cast("double").alias("v"))
    result = pipeline.run(cells, lat, lon, config, args.output, args.temporary, args.overwrite)
    print(result)
    return 0


if __name__ == "__main__":
    sys.exit(main())

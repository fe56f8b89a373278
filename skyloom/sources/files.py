"""Readers by suffix.  Formats that need absent libraries fail by name, not by accident."""

from __future__ import annotations

import importlib.util
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import CatalogError, reader_for
from . import netcdf3, zarr

#: Library that each optional format needs.
LIBRARIES = {"netcdf": "h5py", "hdf4": "netCDF4", "geotiff": "rasterio"}


def require(reader: str) -> None:
    """Refuse a reader whose library is not installed."""
    library = LIBRARIES.get(reader)
    if library and importlib.util.find_spec(library) is None:
        raise CatalogError(f"{reader} files need {library}, which is not installed")


def is_classic(path: str) -> bool:
    """Whether a file is classic NetCDF, whatever its suffix."""
    fs, name = zarr.open_store(path)
    with fs.open_input_stream(name) as source:
        return source.read(4) in (b"CDF\1", b"CDF\2", b"CDF\5")


def inspect(path: str, reader: str | None = None) -> dict:
    """Dimensions, attributes and variables of one file or store."""
    suffix = "." + path.rstrip("/").rpartition(".")[2].lower()
    reader = reader_for(suffix, reader)
    if reader == "zarr":
        arrays, attrs = zarr.read_arrays(path)
        variables = {n: {"dims": list(a.dims), "dtype": a.dtype, "shape": list(a.shape), "chunks": list(a.chunks), "attrs": a.attrs} for n, a in arrays.items()}
        return {"reader": reader, "dims": {d: n for a in arrays.values() for d, n in zip(a.dims, a.shape, strict=True)}, "attrs": attrs, "variables": variables}
    if reader == "netcdf3" or is_classic(path):
        header = netcdf3.read_header(path)
        variables = {n: {"dims": list(v.dims), "dtype": v.dtype.lstrip(">"), "shape": list(v.shape), "chunks": None, "attrs": v.attrs} for n, v in header.variables.items()}
        return {"reader": "netcdf3", "dims": header.dims, "attrs": header.attrs, "variables": variables}
    require(reader)
    raise CatalogError(f"no reader for {reader} is built in")


def direct_variables(info: dict, dims: Sequence[str] = ("time", "lat", "lon")) -> list[str]:
    """Numeric variables over exactly the three dimensions."""
    return [n for n, v in info["variables"].items() if sorted(v["dims"]) == sorted(dims) and v["dtype"].lstrip("<>|")[0] in "biufc"]


def read_parquet_cube(spark: SparkSession, path: str) -> DataFrame:
    """Cells that ``plans.publish`` wrote, without their chunk keys."""
    return spark.read.parquet(path).drop("ct", "cy", "cx")


def named_cells(spark: SparkSession, paths: Sequence[str], dates: Sequence, variable: str) -> DataFrame:
    """Cells ``t, y, x, v`` of two-dimensional files, one date a file.

    ``paths`` and ``dates`` come from a checked catalogue; their table joins by path.
    """
    cells = netcdf3.read_cells(spark, paths, [variable])
    times = spark.createDataFrame(list(zip(paths, dates, strict=True)), "path string, t date")
    last = F.size("i")
    return cells.join(F.broadcast(times), "path").select("t", F.get("i", last - 2).alias("y"), F.get("i", last - 1).alias("x"), F.nanvl("v", F.lit(None).cast("double")).alias("v"))

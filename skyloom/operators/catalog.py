"""Source catalogue: files, schemas, axes, incremental scans and snapshots."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPLETE_SUFFIXES = (".nc", ".nc4", ".nc3", ".cdf", ".hdf")
NAMED_SUFFIXES = (*COMPLETE_SUFFIXES, ".tif", ".tiff")
SNAPSHOT_VERSION = 4


class CatalogError(ValueError):
    """Files that do not form one product."""


def list_files(spark: SparkSession, root: str, suffixes: Sequence[str] = COMPLETE_SUFFIXES) -> DataFrame:
    """``path, size, mtime, suffix`` of all files with a known suffix that are not empty, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    suffix = F.lower(F.concat(F.lit("."), F.substring_index("path", ".", -1)))
    rows = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), suffix.alias("suffix"))
    return rows.where(F.col("suffix").isin(*suffixes)).orderBy("path")


def one_suffix(files: DataFrame) -> str:
    """The files' suffix; none or several are an error."""
    found = [r.suffix for r in files.select("suffix").distinct().limit(3).collect()]
    if len(found) != 1:
        raise CatalogError("no file has a known suffix" if not found else f"suffixes differ: {sorted(found)}")
    return found[0]


def reader_for(suffix: str, override: str | None = None) -> str:
    """Name of the reader for a suffix."""
    return override or {".tif": "geotiff", ".tiff": "geotiff", ".hdf": "hdf4", ".nc3": "netcdf3", ".zarr": "zarr"}.get(suffix.lower(), "netcdf")


def mode_of(dims: Sequence[str], time_names: Sequence[str] = ("time", "t")) -> str:
    """``dimension`` with time and space, ``filename`` with space alone."""
    lowered = [d.lower() for d in dims]
    space = any(d.startswith(("lat", "y")) for d in lowered) and any(d.startswith(("lon", "x")) for d in lowered)
    if not space:
        raise CatalogError("no latitude and longitude")
    return "dimension" if any(d in time_names for d in lowered) else "filename"


#: Names by which latitude and longitude are known, best first (fixed values).
SPATIAL_NAMES = (("lat", "lon"), ("latitude", "longitude"), ("lat", "longitude"), ("latitude", "lon"), ("y", "x"))


def spatial_dims(dims: Sequence[str], attrs: dict[str, dict] | None = None) -> tuple[str, str]:
    """Names of the latitude and longitude dimensions."""
    by_lower = {d.lower(): d for d in dims}
    for pair in SPATIAL_NAMES:
        if all(p in by_lower for p in pair):
            return by_lower[pair[0]], by_lower[pair[1]]
    prefixed = [[d for d in dims if d.lower().startswith(p)] for p in ("ydim", "xdim")]
    if all(len(p) == 1 for p in prefixed):
        return prefixed[0][0], prefixed[1][0]
    named = []
    for standard, axis in (("latitude", "Y"), ("longitude", "X")):
        hits = [d for d in dims if (attrs or {}).get(d, {}).get("standard_name") == standard or (attrs or {}).get(d, {}).get("axis") == axis]
        if len(hits) != 1:
            raise CatalogError("name the dimensions of time, latitude and longitude")
        named.append(hits[0])
    return named[0], named[1]


def dimension_map(dims: Sequence[str], given: Sequence[str] | None = None) -> dict[str, str]:
    """Source dimension of ``time, lat, lon``: canonical, or three distinct names that exist."""
    canonical = ("time", "lat", "lon")
    if given is None:
        if not set(canonical) <= set(dims):
            raise CatalogError("the dimensions need a mapping")
        return dict(zip(canonical, canonical, strict=True))
    if len(given) != 3 or len(set(given)) != 3 or not set(given) <= set(dims):
        raise CatalogError("the mapping names three different dimensions of the source")
    return dict(zip(canonical, given, strict=True))


def signature_mismatches(variables: DataFrame, limit: int = 10) -> DataFrame:
    """Files whose variables differ from the first file's: path, variable, both signatures.

    ``variables`` has ``path, name`` and any columns that count as the signature.
    """
    fields = sorted(c for c in variables.columns if c not in ("path", "name"))
    signed = variables.select("path", "name", F.to_json(F.struct(*fields)).alias("signature"))
    first = signed.agg(F.min("path").alias("path"))
    reference = signed.join(F.broadcast(first), "path").select("name", F.col("signature").alias("expected"))
    pairs = signed.select("path").distinct().crossJoin(F.broadcast(reference)).join(signed, ["path", "name"], "full")
    return pairs.where(~F.col("signature").eqNullSafe(F.col("expected"))).orderBy("path", "name").limit(limit)


def axis_hash(axis: DataFrame, order: str, value: str) -> DataFrame:
    """Checksum of an axis; equal axes have equal ones."""
    rows = axis.agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("x"))
    return rows.select(F.sha2(F.to_json("x"), 256).alias("axis_hash"))


def split_changes(listing: DataFrame, known: DataFrame, key: Sequence[str] = ("path", "size", "mtime")) -> tuple[DataFrame, DataFrame]:
    """Files to scan, and known records that still hold."""
    key = list(key)
    return listing.join(known.select(*key), key, "left_anti"), known.join(listing.select(*key), key, "left_semi")


def refreshed(scanned: DataFrame, reused: DataFrame) -> DataFrame:
    """All records after an incremental scan."""
    return reused.unionByName(scanned)


def workload(files: DataFrame) -> DataFrame:
    """One row: number, total, median and 90th percentile of sizes, and the kind of workload."""
    sums = files.agg(F.count("*").alias("n_files"), F.sum("size").cast("bigint").alias("total_bytes"), F.percentile("size", 0.5).alias("median_bytes"), F.percentile("size", 0.9).alias("p90_bytes"))
    kind = F.when((F.col("n_files") >= 1000) & (F.col("median_bytes") < 16 << 20), "many-small").when(F.col("median_bytes") >= 512 << 20, "large").otherwise("balanced")
    return sums.withColumn("kind", kind)


def times_per_file(times: DataFrame) -> DataFrame:
    """How many files hold how many times."""
    return times.groupBy("path").agg(F.count("*").alias("n_times")).groupBy("n_times").agg(F.count("*").alias("n_files"))


def locate_times(wanted: DataFrame, file_times: DataFrame, time: str = "t") -> DataFrame:
    """File and local index of every wanted time; a time without a file has NULL there."""
    return wanted.join(file_times, time, "left")


def save_snapshot(path: str, files: DataFrame, meta: dict) -> None:
    """Write the catalogue of a driver-sized listing as JSON."""
    stamped = files.withColumn("mtime", F.unix_micros("mtime"))  # the instant, whatever the session's zone
    rows = [r.asDict() for r in stamped.toLocalIterator()]
    with open(path, "w", encoding="utf-8") as out:
        json.dump({"version": SNAPSHOT_VERSION, "meta": meta, "files": rows}, out, indent=1)


def load_snapshot(spark: SparkSession, path: str, validate: bool = True) -> tuple[DataFrame, dict]:
    """Files and metadata of a snapshot; versions without what is needed are refused."""
    with open(path, encoding="utf-8") as source:
        data = json.load(source)
    if data.get("version", 0) < (SNAPSHOT_VERSION if validate else 2):
        raise CatalogError("the snapshot is too old; inspect the source again")
    # versions up to 3 hold the times as text without a zone
    micros = lambda at: at if isinstance(at, int) else round(datetime.fromisoformat(at).timestamp() * 1_000_000)
    rows = [(r["path"], r["size"], micros(r["mtime"]), PurePosixPath(r["path"]).suffix.lower()) for r in data["files"]]
    frame = spark.createDataFrame(rows, "path string, size long, mtime long, suffix string").withColumn("mtime", F.timestamp_micros("mtime"))
    return frame, data["meta"]

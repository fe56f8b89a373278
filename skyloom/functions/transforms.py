"""Value transforms: fill markers, scale, output fill, types and attributes."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark type of each numeric storage type; unsigned ones take the next wider signed type.
SPARK_TYPES = {
    "bool": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
}


class TransformError(ValueError):
    """A marker or scale that a variable cannot take."""


@dataclass(frozen=True)
class Transform:
    """Raw markers of missing cells, a factor, and the marker to write."""

    fill_values: tuple[float, ...] = ()
    scale: float | None = None
    output_fill: float | None = None


def parse_numbers(text: str) -> tuple[float, ...]:
    """Finite numbers or NaN from a comma list, brackets optional."""
    out = []
    for item in text.strip().strip("[]()").split(","):
        if item.strip():
            try:
                value = float(item)
            except ValueError:
                raise TransformError(f"{item.strip()!r} is not a number") from None
            if math.isinf(value):
                raise TransformError("markers are finite or NaN")
            out.append(value)
    return tuple(out)


def is_missing(raw: Column, markers: Sequence[float]) -> Column:
    """Whether a raw, unscaled value is one of the markers (or missing already)."""
    out = raw.isNull()
    if numbers := [m for m in markers if not math.isnan(m)]:
        out = out | raw.isin(numbers)
    if len(numbers) < len(markers):
        out = out | F.isnan(raw.cast("double"))
    return out


def scaled_type(dtype: str) -> str:
    """Type after scaling: floats stay, integers of up to four bytes become float32, wider ones float64."""
    kind = np.dtype(dtype)
    if kind.kind == "f":
        return kind.name
    return "float32" if kind.itemsize <= 4 else "float64"


def resampled_type(dtype: str, compute: str | None = None) -> str:
    """Type after regridding: integers become float64; float32 computation affects floats only."""
    kind = np.dtype(dtype)
    if kind.kind != "f":
        return "float64"
    return "float32" if compute == "float32" else kind.name


def output_marker(dtype: str, transform: Transform, attrs: Mapping[str, float], needed: bool = True) -> float | None:
    """Marker to write: the explicit one, NaN for floats, the first raw marker, then the attributes."""
    kind = np.dtype(dtype)
    if transform.output_fill is not None:
        marker = transform.output_fill
    elif kind.kind == "f":
        return math.nan
    else:
        marker = next(iter(transform.fill_values), attrs.get("_FillValue", attrs.get("missing_value")))
    if marker is None:
        if needed:
            raise TransformError(f"{dtype} has no marker for missing cells")
        return None
    if kind.kind in "iu":
        limits = np.iinfo(kind)
        if math.isnan(marker) or marker != int(marker) or not limits.min <= marker <= limits.max:
            raise TransformError(f"{marker} is not a value of {dtype}")
    return marker


def decode(raw: Column, transform: Transform, dtype: str) -> Column:
    """Missing cells as NULL, others times the factor in the scaled type.  Offsets are not applied."""
    target = SPARK_TYPES[scaled_type(dtype)] if transform.scale is not None else SPARK_TYPES[dtype]
    value = raw.cast(target)
    if transform.scale is not None:
        value = (value * F.lit(transform.scale).cast(target)).cast(target)
    return F.when(~is_missing(raw, transform.fill_values), value)


def encode(value: Column, dtype: str, marker: float | None) -> Column:
    """Missing cells as the marker, for writing."""
    target = SPARK_TYPES[dtype]
    return value.cast(target) if marker is None else F.coalesce(value.cast(target), F.lit(marker).cast(target))


def rewritten_attrs(attrs: Mapping[str, object], transform: Transform, marker: float | None) -> dict[str, object]:
    """Attributes of the written variable: its marker, and where a factor came from."""
    out = {k: v for k, v in attrs.items() if k not in ("scale_factor", "add_offset", "_FillValue", "missing_value")}
    if marker is not None:
        out |= {"_FillValue": marker, "missing_value": marker}
    if transform.scale is not None:
        out["source_scale_factor"] = transform.scale
    return out


def rewritten_time_attrs(attrs: Mapping[str, object]) -> dict[str, object]:
    """``units`` and ``calendar`` of the source under names of their own."""
    return {{"units": "source_time_units", "calendar": "source_time_calendar"}.get(k, k): v for k, v in attrs.items()}


def python_modulo(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign."""
    return a - b * F.floor(a / b)

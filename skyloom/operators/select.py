"""Windows: variables, times and coordinates, as filters that reach the scan."""

from __future__ import annotations

import calendar
import json
import re
from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .axes import Axis


class SelectionError(ValueError):
    """A window that names nothing, or something that does not exist."""


def choose_variables(available: Sequence[str], wanted: Iterable[str] | None) -> list[str]:
    """Wanted variables in the order given, once each; all of them without a wish."""
    names = list(available if wanted is None else dict.fromkeys(wanted))
    if unknown := sorted(set(names) - set(available)):
        raise SelectionError(f"unknown variables: {', '.join(unknown)}")
    if not names:
        raise SelectionError("no variable is selected")
    return names


def check_renames(names: dict[str, str], dims: Sequence[str] = ("time", "lat", "lon")) -> dict[str, str]:
    """Refuse blank, reserved, path-like and colliding new names."""
    new = list(names.values())
    for name in new:
        if not name.strip() or name in dims or "/" in name or "\\" in name:
            raise SelectionError(f"{name!r} cannot name a variable")
    if len(set(new)) != len(new):
        raise SelectionError("new names collide")
    return names


_DATE_ITEM = re.compile(r"\d{4}(-\d{1,2}){0,2}([T ][\d:.]+)?")


def parse_range_list(text: str) -> list | None:
    """A list literal; dates need no quotes.  Blank text is no list at all."""
    text = text.strip()
    if not text:
        return None
    if not (text.startswith(("[", "(")) and text.endswith(("]", ")"))):
        raise SelectionError(f"{text!r} is not a list")
    items = [x.strip() for x in text[1:-1].split(",")]
    if items == [""]:
        return []
    out = []
    for item in items:
        bare = item.strip("'\"")
        if bare != item or (_DATE_ITEM.fullmatch(bare) and "-" in bare):
            out.append(bare)
            continue
        try:
            out.append(json.loads(item))
        except ValueError:
            raise SelectionError(f"{item!r} is neither a number nor a date") from None
    return out


def pair(bounds: Sequence | None, label: str) -> tuple | None:
    """Both bounds or none."""
    if bounds is None:
        return None
    if len(bounds) != 2 or any(b is None for b in bounds):
        raise SelectionError(f"{label} needs both bounds")
    return tuple(bounds)


def date_span(first: object, last: object) -> tuple[date, date]:
    """Inclusive dates; a year or month alone means all of it."""

    def ends(value: object) -> tuple[date, date]:
        parts = [int(p) for p in str(value).strip()[:10].split("-")]
        if len(parts) == 1:
            return date(parts[0], 1, 1), date(parts[0], 12, 31)
        if len(parts) == 2:
            return date(*parts, 1), date(*parts, calendar.monthrange(*parts)[1])
        return date(*parts), date(*parts)

    return ends(first)[0], ends(last)[1]


def time_window(first: object, last: object, column: str = "t") -> Column:
    """Filter for an inclusive range of dates."""
    low, high = date_span(first, last)
    return F.col(column).between(F.lit(low), F.lit(high))


def index_window(axis: Axis, low: float, high: float) -> tuple[int, int]:
    """Half-open index range of the centres between two bounds, in either order."""
    low, high = min(low, high), max(low, high)
    inside = [i for i, c in enumerate(axis.centres) if low <= c <= high]
    if not inside:
        raise SelectionError("no cell centre lies between the bounds")
    return inside[0], inside[-1] + 1


def cell_window(y: tuple[int, int] | None = None, x: tuple[int, int] | None = None) -> Column:
    """Filter for half-open index ranges; pushed to the scan like any comparison."""
    out = F.lit(True)
    for name, window in (("y", y), ("x", x)):
        if window is not None:
            out = out & (F.col(name) >= window[0]) & (F.col(name) < window[1])
    return out


def contiguous(rows: DataFrame, column: str) -> DataFrame:
    """One row: first, last and number of distinct indices, and whether they have no gap."""
    sums = rows.agg(F.min(column).alias("first_index"), F.max(column).alias("last_index"), F.count_distinct(column).alias("n"))
    return sums.withColumn("contiguous", F.col("last_index") - F.col("first_index") + 1 == F.col("n"))


def strided(rows: DataFrame, strides: dict[str, int]) -> DataFrame:
    """Every n-th index of each dimension (a fixed sample, unlike a random one)."""
    keep = F.lit(True)
    for dim, n in strides.items():
        keep = keep & (F.pmod(F.col(dim), F.lit(n)) == 0)
    return rows.where(keep)

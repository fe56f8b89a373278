"""Axes of regular grids: edges, uniformity, targets, equality and stencils.

An axis has at most some tens of thousands of positions, so this is plain NumPy
on the driver; the results become small tables that plans join by equality.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

CONSERVATIVE = ("conservative", "conservative_normed")
METHODS = ("bilinear", *CONSERVATIVE, "patch", "nearest_s2d", "nearest_d2s")
#: Source positions beyond the target that a point method needs on each side.
STENCIL = {"bilinear": 1, "patch": 2}


class GridError(ValueError):
    """An axis or a target outside what regular grids allow."""


def edges_of(centres: Sequence[float]) -> np.ndarray:
    """Cell edges: midpoints inside, half a spacing beyond each end."""
    c = np.asarray(centres, float)
    inner = (c[1:] + c[:-1]) / 2
    return np.concatenate([[c[0] - (c[1] - c[0]) / 2], inner, [c[-1] + (c[-1] - c[-2]) / 2]])


@dataclass(frozen=True)
class Axis:
    """Centres and edges of a checked axis, in storage order."""

    centres: np.ndarray
    edges: np.ndarray
    resolution: float

    @property
    def descending(self) -> bool:
        return bool(self.centres[0] > self.centres[-1])

    @property
    def low(self) -> float:
        return float(self.edges.min())

    @property
    def high(self) -> float:
        return float(self.edges.max())

    def __len__(self) -> int:
        return len(self.centres)

    def rows(self) -> list[tuple[int, float, float, float]]:
        """``(index, centre, low edge, high edge)`` of each cell."""
        pairs = np.sort(np.stack([self.edges[:-1], self.edges[1:]]), axis=0)
        return [(i, float(c), float(a), float(b)) for i, (c, a, b) in enumerate(zip(self.centres, *pairs, strict=True))]

    @property
    def periodic(self) -> bool:
        """Whether the axis spans the whole circle."""
        return abs(self.high - self.low - 360.0) <= 1e-5


def spacing_tolerance(centres: np.ndarray, resolution: float) -> float:
    """Absolute slack of a spacing: the larger of a millionth of it, two float32 steps and 1e-10."""
    magnitude = max(float(np.abs(centres).max()), abs(resolution), 1.0)
    return max(resolution * 1e-6, 2.0 * float(np.spacing(np.float32(magnitude))), 1e-10)


def inspect_axis(centres: Sequence[float], name: str = "axis") -> Axis:
    """Check an axis (one-dimensional, finite, strictly monotonic, uniform) and derive its edges."""
    c = np.asarray(centres, float)
    if c.ndim != 1 or len(c) < 2 or not np.isfinite(c).all():
        raise GridError(f"{name} needs at least two finite coordinates in one dimension")
    steps = np.diff(c)
    if not ((steps > 0).all() or (steps < 0).all()):
        raise GridError(f"{name} is not strictly monotonic")
    sizes = np.abs(steps)
    resolution = float(np.median(sizes))
    slack = spacing_tolerance(c, resolution) + 1e-5 * resolution
    if (np.abs(sizes - resolution) > slack).any():
        raise GridError(f"{name} is not uniformly spaced")
    return Axis(c, edges_of(c), resolution)


def _regular(low: float, count: int, resolution: float, descending: bool, high: float | None = None) -> Axis:
    edges = low + resolution * np.arange(count + 1, dtype=float)
    if high is not None:
        edges[-1] = high
    centres = (edges[1:] + edges[:-1]) / 2
    return Axis(centres[::-1], edges[::-1], resolution) if descending else Axis(centres, edges, resolution)


def target_axis(resolution: float, descending: bool, *, extent: str = "source", source: Axis | None = None, bounds: tuple[float, float] | None = None) -> Axis:
    """Target cells over the source's extent, a whole range, or given outer edges.

    The source extent is rounded outward at its high side; the other extents must
    be whole multiples of the resolution.
    """
    if not (math.isfinite(resolution) and resolution > 0):
        raise GridError("the resolution must be a positive number")
    if extent == "source":
        if source is None:
            raise GridError("a source axis is needed for its extent")
        cells = max(1, math.ceil((source.high - source.low) / resolution - 1e-10))
        return _regular(source.low, cells, resolution, descending)
    if extent not in ("global", "custom") or bounds is None:
        raise GridError("extent is source, global or custom, the latter two with bounds")
    low, high = sorted(map(float, bounds))
    if not (math.isfinite(low) and math.isfinite(high) and low < high):
        raise GridError("bounds must be finite and differ")
    slack = 1e-8 if extent == "global" else max(1e-10, resolution * 1e-8)
    cells = round((high - low) / resolution)
    if cells < 1 or abs(cells * resolution - (high - low)) > slack:
        raise GridError(f"{low:g} .. {high:g} is not a whole number of cells of {resolution:g}")
    return _regular(low, cells, resolution, descending, high if extent == "custom" else None)


def global_bounds(axis: str) -> tuple[float, float]:
    """Outer edges of the globe along ``lat`` or ``lon``."""
    return (-90.0, 90.0) if axis == "lat" else (-180.0, 180.0)


def matching_slice(source: Axis, target: Axis) -> tuple[int, int] | None:
    """Half-open source range equal to the target within coordinate noise, if there is one.

    Noise is two float32 steps of the largest coordinate, never more than a
    thousandth of a cell, so a shift by part of a pixel is a different grid.
    """
    if source.descending != target.descending or len(target) > len(source):
        return None
    step = float(np.spacing(np.float32(max(np.abs(source.centres).max(), np.abs(target.centres).max(), 1.0))))
    slack = min(max(2.0 * step, 1e-10), 1e-3 * min(source.resolution, target.resolution))
    begin = int(np.abs(source.centres - target.centres[0]).argmin())
    for first in (begin - 1, begin, begin + 1):
        part = source.centres[max(first, 0) : max(first, 0) + len(target)]
        if first >= 0 and len(part) == len(target) and (np.abs(part - target.centres) <= slack).all():
            return first, first + len(target)
    return None


def read_window(source: Axis, low: float, high: float, method: str) -> tuple[int, int]:
    """Half-open source range a method reads for targets between two outer edges.

    Cell methods read the cells that overlap the range, point methods the centres
    inside it and their stencil; the nearest cells are kept where nothing is
    covered, and never fewer than two.
    """
    low, high = min(low, high), max(low, high)
    turn = -1 if source.descending else 1
    centres, edges = source.centres[::turn], source.edges[::turn]
    slack = max(1e-10, 1e-7 * source.resolution)
    if method in CONSERVATIVE:
        inside = np.flatnonzero((edges[1:] > low + slack) & (edges[:-1] < high - slack))
        first, last = (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (0, 0)
    else:
        reach = STENCIL.get(method, 0)
        first = max(0, int((centres < low).sum()) - reach)
        last = min(len(centres), int((centres <= high).sum()) + reach)
    if first >= last:
        first = int(np.abs(centres - (low + high) / 2).argmin())
        last = first + 1
    if last - first == 1 and len(centres) > 1:
        first, last = (first, last + 1) if last < len(centres) else (first - 1, last)
    return (first, last) if turn == 1 else (len(centres) - last, len(centres) - first)


def uncovered_sides(source: Axis, target: Axis) -> list[str]:
    """Sides on which the target reaches beyond the source by more than noise."""
    slack = spacing_tolerance(source.centres, source.resolution)
    return [side for side, beyond in (("low", source.low - target.low), ("high", target.high - source.high)) if beyond > slack]


def axis_report(centres: Sequence[float]) -> dict[str, object]:
    """Size, direction, step and largest deviation of an axis."""
    c = np.asarray(centres, float)
    steps = np.diff(c)
    step = float(np.median(steps)) if len(steps) else 0.0
    error = float(np.abs(steps - step).max()) if len(steps) else 0.0
    return {
        "size": len(c),
        "direction": "single" if not len(steps) else "ascending" if (steps > 0).all() else "descending" if (steps < 0).all() else "mixed",
        "step": step,
        "max_step_error": error,
        "uniform": error <= max(1e-6 * abs(step), 1e-10),
    }


def logical_bytes(shape: Sequence[int], item_sizes: Sequence[int]) -> int:
    """Uncompressed size of variables of one shape."""
    return math.prod(shape) * sum(item_sizes)


def spread_positions(n: int, k: int) -> list[int]:
    """At most ``k`` positions spread evenly over ``0..n-1``, both ends included."""
    if n <= k:
        return list(range(n))
    return sorted({round(i * (n - 1) / (k - 1)) for i in range(k)}) if k > 1 else [0]

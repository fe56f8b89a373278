"""Storage layout: chunk plans, packing cells to chunks, codecs and their choice.

A chunk is a row: its key, its origin and shape, and its values as one array in
time, y, x order.  Rechunking is one shuffle by the new chunk keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

MIB = 1 << 20
MIN_MIB, DEFAULT_MIB, MAX_MIB = 32.0, 128.0, 256.0


class LayoutError(ValueError):
    """A layout that does not fit the cube or the codec."""


def target_mib(wanted: float = DEFAULT_MIB, available_mib: float | None = None, workers: int = 1) -> float:
    """Chunk size within limits, at most a tenth of the memory of a worker."""
    share = math.inf if available_mib is None else available_mib / (10 * max(workers, 1))
    if not 0 < wanted < math.inf:
        raise LayoutError("the target size is a positive number")
    return sorted((MIN_MIB, min(wanted, share), MAX_MIB))[1]


def tile_sizes(length: int, multiple: int) -> np.ndarray:
    """Sizes a chunk may have along a dimension: all below two multiples, multiples beyond, and the whole."""
    sizes = np.arange(1, length + 1)
    return sizes[(sizes < 2 * multiple) | (sizes % multiple == 0) | (sizes == length)]


@dataclass(frozen=True)
class ChunkPlan:
    """Chunk shape of all variables."""

    strategy: str
    chunks: tuple[int, int, int]

    def counts(self, shape: Sequence[int]) -> tuple[int, ...]:
        """Chunks along each dimension."""
        return tuple(-(-n // c) for n, c in zip(shape, self.chunks, strict=True))

    def bytes(self, item_size: int) -> int:
        """Uncompressed size of a whole chunk."""
        return math.prod(self.chunks) * item_size


def _custom(shape: Sequence[int], cells: float, custom: Sequence[int] | None) -> tuple[int, int, int]:
    """Sizes as given."""
    given = np.array(custom if custom is not None else [], object)
    whole = [c for c in given if isinstance(c, (int, np.integer)) and not isinstance(c, bool)]
    if len(whole) != 3 or len(given) != 3 or any(not 0 < c <= n for c, n in zip(whole, shape, strict=True)):
        raise LayoutError("custom chunks are three whole numbers within the shape")
    return tuple(map(int, whole))


def _maps(shape: Sequence[int], cells: float, custom: Sequence[int] | None) -> tuple[int, int, int]:
    """Whole maps: the longest stretch of time that fits."""
    nt, ny, nx = shape
    times = tile_sizes(nt, 4)
    return int(times[times * ny * nx <= cells].max(initial=1)), ny, nx


def _series(shape: Sequence[int], cells: float, custom: Sequence[int] | None) -> tuple[int, int, int]:
    """Whole series: of all tiles that fit, the fullest whose sides are in the map's proportion.

    The cost of a tile adds what it leaves empty and how far it departs from the
    map's shape, both as logarithms.
    """
    nt, ny, nx = shape
    heights, widths = tile_sizes(ny, 16), tile_sizes(nx, 16)
    area = heights[:, None] * widths[None, :].astype(float)
    empty = np.log(max(cells / nt, 1.0) / area)
    skew = np.abs(np.log((heights[:, None] / ny) / (widths[None, :] / nx)))
    cost = np.where(empty >= 0, empty + skew, np.inf)
    i, j = np.unravel_index(np.argmin(cost), cost.shape)
    return nt, int(heights[i]), int(widths[j])


STRATEGIES = {"time": _series, "space": _maps, "custom": _custom}


def plan_chunks(shape: tuple[int, int, int], item_size: int, strategy: str, *, mib: float = DEFAULT_MIB, custom: Sequence[int] | None = None) -> ChunkPlan:
    """Chunk shape of a cube: whole series of tiles, whole maps, or sizes as given."""
    if strategy not in STRATEGIES:
        raise LayoutError(f"strategy is one of {', '.join(STRATEGIES)}")
    if 0 in shape or min(shape) < 0:
        raise LayoutError("every dimension has cells")
    return ChunkPlan(strategy, STRATEGIES[strategy](shape, target_mib(mib) * MIB / item_size, custom))


def regridded_chunks(source: Sequence[int], shape: Sequence[int]) -> tuple[int, ...]:
    """Chunks after regridding: the source's, no larger than the new shape."""
    return tuple(min(c, n) for c, n in zip(source, shape, strict=True))


def same_layout(old: ChunkPlan, new: ChunkPlan, old_codec: Codec, new_codec: Codec) -> str:
    """What a change of layout amounts to: ``copy``, ``recompress`` (chunks stay) or ``rechunk``."""
    if old.chunks != new.chunks:
        return "rechunk"
    return "copy" if old_codec == new_codec or new_codec.name == "none" else "recompress"


def gcd_chunk(sizes: Iterable[int]) -> int:
    """Largest stretch of time that no variable's chunks cut."""
    return math.gcd(*sizes)


def chunk_keys(plan: ChunkPlan, t: str = "ti") -> list[Column]:
    """``ct, cy, cx`` of a cell."""
    return [F.floor(F.col(c) / n).cast("int").alias(k) for c, n, k in zip((t, "y", "x"), plan.chunks, ("ct", "cy", "cx"), strict=True)]


def pack(cells: DataFrame, plan: ChunkPlan, shape: tuple[int, int, int], value: str = "v", t: str = "ti") -> DataFrame:
    """Chunks ``ct, cy, cx, shape, data``; absent cells are NULL entries.

    Each chunk is gathered by its one owner, whose size the plan bounds, and its
    values are laid into one array by their places.
    """
    keyed = cells.select(*chunk_keys(plan, t), t, "y", "x", value)
    kind = to_arrow_type(keyed.schema[value].dataType)
    schema = StructType([*keyed.schema.fields[:3], StructField("shape", ArrayType(IntegerType())), StructField("data", ArrayType(keyed.schema[value].dataType))])

    def lay(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        index = [k.as_py() for k in key]
        size = [min(c, n - k * c) for k, c, n in zip(index, plan.chunks, shape, strict=True)]
        place = np.zeros(table.num_rows, np.int64)
        for name, k, c, n in zip((t, "y", "x"), index, plan.chunks, size, strict=True):
            place = place * n + (table.column(name).to_numpy() - k * c)
        source = np.full(math.prod(size), -1, np.int64)  # which cell is at a place
        source[place] = np.arange(table.num_rows)
        data = table.column(value).combine_chunks().take(pa.array(source, mask=source < 0))
        row = pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), data.cast(kind))
        keys = [pa.array([k], pa.int32()) for k in index]
        return pa.table([*keys, pa.array([size], pa.list_(pa.int32())), row], names=["ct", "cy", "cx", "shape", "data"])

    return keyed.groupBy("ct", "cy", "cx").applyInArrow(lay, schema)


def unpack(chunks: DataFrame, plan: ChunkPlan, value: str = "v", t: str = "ti") -> DataFrame:
    """Cells of chunks, NULL entries included."""
    ct, cy, cx = plan.chunks
    rows = chunks.select("ct", "cy", "cx", "shape", F.posexplode("data").alias("x_i", value))
    sy, sx = F.get("shape", F.lit(1)), F.get("shape", F.lit(2))
    return rows.select(
        (F.col("ct") * ct + F.floor(F.col("x_i") / (sy * sx))).cast("int").alias(t),
        (F.col("cy") * cy + F.floor(F.col("x_i") / sx) % sy).cast("int").alias("y"),
        (F.col("cx") * cx + F.col("x_i") % sx).cast("int").alias("x"),
        value,
    )


def rechunk(chunks: DataFrame, old: ChunkPlan, new: ChunkPlan, shape: tuple[int, int, int]) -> DataFrame:
    """Chunks of another plan, through one shuffle."""
    return pack(unpack(chunks, old).where(F.col("v").isNotNull()), new, shape)


def laid_out(cells: DataFrame, plan: ChunkPlan, partitions: int | None = None, t: str = "ti") -> DataFrame:
    """Cells with chunk keys, every chunk in one partition, sorted inside."""
    keyed = cells.select("*", *chunk_keys(plan, t))
    dealt = keyed.repartition(partitions, "ct", "cy", "cx") if partitions else keyed.repartition("ct", "cy", "cx")
    return dealt.sortWithinPartitions("ct", "cy", "cx", t, "y", "x")


# Levels of the profiles, ranges of the codecs, weights of the objectives.
PROFILE_LEVELS = {"none": None, "fast": 1, "balanced": 4, "maximum": 9, "auto": 1}
CODEC_LEVELS = {"blosc-zstd": (0, 9), "blosc-lz4": (0, 9), "blosc-lz4hc": (0, 9), "blosc-zlib": (0, 9), "zstd": (-7, 22), "gzip": (0, 9)}
OBJECTIVES = {
    "speed": {"write": 0.36, "durable": 0.24, "read": 0.28, "bytes": 0.04, "cpu": 0.05, "rss": 0.03},
    "balanced": {"write": 0.18, "durable": 0.17, "read": 0.25, "bytes": 0.30, "cpu": 0.06, "rss": 0.04},
    "compact": {"write": 0.08, "durable": 0.07, "read": 0.15, "bytes": 0.58, "cpu": 0.07, "rss": 0.05},
}
HIGHER = ("write", "durable", "read")


@dataclass(frozen=True)
class Codec:
    """Lossless codec, its level and byte shuffle; one that does not exist cannot be made."""

    name: str
    level: int | None = None
    shuffle: str = "auto"

    def __post_init__(self) -> None:
        low, high = CODEC_LEVELS.get(self.name, (0, -1))
        levels = {None} if self.name == "none" else set(range(low, high + 1))
        shuffles = {"auto", "noshuffle"} | ({"shuffle", "bitshuffle"} if self.name.startswith("blosc-") else set())
        if self.level not in levels or self.shuffle not in shuffles:
            raise LayoutError(f"there is no {self} (levels {CODEC_LEVELS.get(self.name, 'none')}, shuffles {sorted(shuffles)})")


#: The codec of each profile, under all its names.
PROFILES = {name: Codec("none") if level is None else Codec("blosc-zstd", level) for name, level in PROFILE_LEVELS.items()}
PROFILES |= {"speed": PROFILES["fast"], "compact": PROFILES["maximum"]}


def choose_codec(profile: str = "balanced", codec: str | None = None, level: int | None = None, shuffle: str = "auto") -> Codec:
    """The profile's codec with what is given explicitly in its place."""
    try:
        base = PROFILES[profile]
    except KeyError:
        raise LayoutError(f"profile is one of {', '.join(PROFILES)}") from None
    changes = {k: v for k, v in {"name": codec, "level": level, "shuffle": shuffle}.items() if v is not None}
    if changes.get("name", base.name) == "none":
        return Codec("none")
    return replace(base if base.level is not None else Codec("blosc-zstd", 1), **changes)


def automatic_shuffle(dtype: str) -> str:
    """Bits of integers, dates and booleans, bytes of floats, nothing of single bytes."""
    kind = np.dtype(dtype)
    if kind.kind == "b":
        return "bitshuffle"
    if kind.itemsize == 1 or kind.kind not in "iuMfc":
        return "noshuffle"
    return "shuffle" if kind.kind in "fc" else "bitshuffle"


#: What is tried, most promising first: codec and level; those of the first family once with every shuffle the types ask for.
TRIALS = (("blosc-zstd", 1), ("blosc-zstd", 4), ("blosc-lz4", 1), ("zstd", 1), ("blosc-zstd", 9))


def candidate_codecs(dtypes: Sequence[str], explicit: Codec | None = None, limit: int = 8) -> list[Codec]:
    """Codecs worth measuring; an explicit one is the only candidate."""
    wanted = sorted({automatic_shuffle(d) for d in dtypes}) or ["noshuffle"]
    every = {Codec(name, level, s if name.startswith("blosc-") else "noshuffle"): None for name, level in TRIALS for s in wanted}
    return [explicit] if explicit is not None else list(every)[:limit]


def parquet_options(codec: Codec) -> dict[str, str]:
    """Writer options with the same family of compression."""
    family = {"none": "uncompressed", "gzip": "gzip", "zstd": "zstd", "blosc-zstd": "zstd", "blosc-zlib": "gzip"}.get(codec.name, "lz4")
    options = {"compression": family}
    if family == "zstd" and codec.level is not None:
        options["parquet.compression.codec.zstd.level"] = str(max(1, codec.level))
    return options


def pareto_front(trials: DataFrame, key: str, higher: Sequence[str], lower: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Trials that no other matches everywhere and beats somewhere (``trials`` is small)."""
    a, b = trials.alias("a"), F.broadcast(trials.alias("b"))
    up, down = 1 + tolerance, 1 - tolerance
    no_worse, better = F.lit(True), F.lit(False)
    for c in higher:
        no_worse, better = no_worse & (F.col(f"b.{c}") >= F.col(f"a.{c}") * down), better | (F.col(f"b.{c}") > F.col(f"a.{c}") * up)
    for c in lower:
        no_worse, better = no_worse & (F.col(f"b.{c}") <= F.col(f"a.{c}") * up), better | (F.col(f"b.{c}") < F.col(f"a.{c}") * down)
    return a.join(b, (F.col(f"a.{key}") != F.col(f"b.{key}")) & no_worse & better, "left_anti")


def log_score(trials: DataFrame, baseline: DataFrame, weights: dict[str, float], higher: Sequence[str] = HIGHER) -> DataFrame:
    """``trials`` with the weighted logarithm of their ratios to the one-row baseline."""
    base = baseline.select(*[F.col(c).alias(f"x_{c}") for c in weights])
    score = F.lit(0.0)
    for c, w in weights.items():
        ratio = F.col(c) / F.col(f"x_{c}") if c in higher else F.col(f"x_{c}") / F.col(c)
        score = score + F.lit(w) * F.ln(F.greatest(ratio.cast("double"), F.lit(1e-12)))
    return trials.crossJoin(F.broadcast(base)).withColumn("score", score).drop(*[f"x_{c}" for c in weights])


def select_trial(trials: DataFrame, baseline: DataFrame, objective: str = "balanced") -> DataFrame:
    """Best verified and feasible trial on the front: by score, then size, then order."""
    valid = trials.where("verified and feasible")
    front = pareto_front(valid, "candidate", HIGHER, [c for c in OBJECTIVES[objective] if c not in HIGHER], 1e-9)
    scored = log_score(front, baseline, OBJECTIVES[objective])
    return scored.orderBy(F.col("score").desc(), "bytes", "candidate").limit(1)


def first_common(rows: DataFrame, value: str, order: str) -> DataFrame:
    """The most common value; of several, the one seen first."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("x_first"))
    return counts.orderBy(F.col("n").desc(), "x_first").limit(1).drop("x_first")

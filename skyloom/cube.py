"""The cube as a relation: cells, axes, densification and representations.

``cells`` has one row for each grid cell: ``t DATE, y INT, x INT`` and value
columns.  A cell that is absent or NULL is missing; NaN is turned into NULL where
data enter the engine, because Spark orders NaN above every number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which an axis or weight table is broadcast.
BROADCAST_ROWS = 1_000_000


def event_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``t, y 0..5, x 0..9, v`` (whole cents) from the ``events`` table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cell = F.col("event_id")
    return events.groupBy(
        F.to_date("ts").alias("t"),
        F.floor((cell % 60) / 10.0).cast("int").alias("y"),
        (cell % 10).cast("int").alias("x"),
    ).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("v"))


def nan_to_null(value: Column) -> Column:
    """Missing as NULL: the engine's only marker inside plans."""
    return F.nanvl(value, F.lit(None).cast("double"))


def index_axis(spark: SparkSession, n: int, name: str) -> DataFrame:
    """Positions ``0..n-1`` of an axis."""
    return spark.range(n).select(F.col("id").cast("int").alias(name))


def distinct_axes(cells: DataFrame, dims: Sequence[str] = ("t", "y", "x")) -> dict[str, DataFrame]:
    """The values each dimension takes."""
    return {d: cells.select(d).distinct() for d in dims}


def densify(cells: DataFrame, axes: Sequence[DataFrame]) -> DataFrame:
    """One row for each combination of the axes; NULL where ``cells`` has none.

    The axes are small tables; the product is the cube itself, which is the
    result, and joins the cells by equality.
    """
    grid = axes[0]
    for axis in axes[1:]:
        grid = grid.crossJoin(F.broadcast(axis))
    return grid.join(cells, grid.columns, "left")


def flip(cells: DataFrame, dim: str, n: int) -> DataFrame:
    """Reverse an axis of ``n`` positions."""
    return cells.withColumn(dim, (F.lit(n - 1) - F.col(dim)).cast("int"))


def melt(wide: DataFrame, variables: Sequence[str], dims: Sequence[str] = ("t", "y", "x")) -> DataFrame:
    """Wide cube (a column for each variable) to rows ``var, value``."""
    return wide.unpivot(list(dims), list(variables), "var", "value")


def widen(long: DataFrame, variables: Sequence[str], dims: Sequence[str] = ("t", "y", "x")) -> DataFrame:
    """Rows ``var, value`` to one column for each named variable."""
    return long.groupBy(*dims).pivot("var", list(variables)).agg(F.first("value"))


def concat_time(parts: Sequence[DataFrame]) -> DataFrame:
    """Cubes over disjoint times, one after the other."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

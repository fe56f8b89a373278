"""Bounded, reproducible samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_: Column, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def bounded(rows: DataFrame, key: str, n: int) -> list:
    """At most ``n`` rows in the order of the key's hash (the same rows every time)."""
    return rows.orderBy(F.xxhash64(key), key).limit(n).collect()


def bounded_each(rows: DataFrame, key: str, group: str, n: int) -> list[tuple]:
    """About ``n`` pairs ``(key, group)`` of each group, all of a smaller one (the same rows every time).

    One scan counts the groups, a second keeps the rows whose hash lies below the
    share that twice ``n`` are of their group; of these the ``n`` smallest hashes stay.
    """
    sizes = {r[group]: r["count"] for r in rows.groupBy(group).count().collect()}
    if not sizes:
        return []
    share = rows.sparkSession.createDataFrame([(g, min(1.0, 2 * n / c)) for g, c in sizes.items()], rows.select(F.col(group).alias("x_of"), F.lit(0.0).alias("x_share")).schema)
    place = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30))
    picked = rows.select(key, group, place.alias("x_place")).join(F.broadcast(share), F.col(group) == F.col("x_of")).where(F.col("x_place") < F.col("x_share") * (1 << 30))
    out: dict = {}
    for r in sorted(picked.collect(), key=lambda r: (r.x_place, r[key])):  # about twice ``n`` rows a group
        own = out.setdefault(r[group], [])
        if len(own) < n:
            own.append((r[key], r[group]))
    return [pair for own in out.values() for pair in own]

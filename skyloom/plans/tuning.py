"""Measured choice of a codec, and sizes that Spark is told.

Worker counts, batch sizes and read-ahead are left to Spark's scheduler and
adaptive execution; what remains worth measuring is the codec of real data.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.layout import Codec, candidate_codecs, parquet_options, select_trial
from ..operators.validate import identical

TRIAL_SCHEMA = "candidate int, write double, durable double, read double, bytes double, cpu double, rss double, verified boolean, feasible boolean"


def measure_codecs(sample: DataFrame, folder: str, codecs: Sequence[Codec], free_bytes: float = math.inf, ratio: float = 1.0) -> DataFrame:
    """Write and read a sample with each codec; one row of figures each.

    A trial counts only if what is read equals what was written; ``ratio`` scales
    the sample's size to the product's for the check against free space.  Speeds
    are in rows a second, CPU and memory are not told apart in one process and
    stay equal.
    """
    spark, n = sample.sparkSession, sample.count()
    rows = []
    for k, codec in enumerate(codecs):
        path = f"{folder}/trial{k}"
        began = time.perf_counter()
        sample.write.mode("overwrite").options(**parquet_options(codec)).parquet(path)
        wrote = time.perf_counter()
        back = spark.read.parquet(path)
        back.write.format("noop").mode("overwrite").save()
        read = time.perf_counter()
        size = sum(p.stat().st_size for p in Path(path).glob("*.parquet"))
        rows.append((k, n / (wrote - began), n / (wrote - began), n / (read - wrote), float(max(size, 1)), 1.0, 1.0, identical(back, sample), size * ratio * 1.25 <= free_bytes))
    return spark.createDataFrame(rows, TRIAL_SCHEMA)


def best_codec(sample: DataFrame, folder: str, dtypes: Sequence[str], objective: str = "balanced", explicit: Codec | None = None) -> Codec:
    """The codec to use: an explicit one as it stands, else the best of the measured."""
    codecs = candidate_codecs(dtypes, explicit)
    if explicit is not None:
        return explicit
    trials = measure_codecs(sample, folder, codecs)
    valid = trials.where("verified and feasible")
    if valid.isEmpty():
        return Codec("blosc-zstd", 1)
    return codecs[select_trial(trials, valid.orderBy("candidate").limit(1), objective).first()["candidate"]]


def partitions_for(bytes_: int, target: int = 128 << 20, least: int = 1) -> int:
    """Shuffle partitions that keep each at about ``target`` bytes."""
    return max(least, -(-bytes_ // target))


def size_session(spark: SparkSession, bytes_: int, cores: int) -> int:
    """Set the shuffle partitions for a plan that moves so many bytes; whole waves of cores."""
    n = partitions_for(bytes_)
    n = -(-n // cores) * cores
    spark.conf.set("spark.sql.shuffle.partitions", n)
    return n

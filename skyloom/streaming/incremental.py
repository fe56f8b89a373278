"""Incremental scans as a stream: only files that are new reach a batch.

The source never streams by itself; following a folder is this engine's extension
of its incremental scan.  Each micro-batch aggregates its own cells and merges
them into the product folder by date, so a repeated batch rewrites the same dates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def follow(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's transformed cells under its own number; a retry replaces them."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, target: str, keys: list[str], value: str) -> DataFrame:
    """All batches; of a cell in several, the latest batch wins."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(target)
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))

"""Durable intermediate tables.

Operators that need a barrier write Parquet below the folder the cluster names
in ``spark.checkpoint.dir`` (shared by all executors), so a lost executor only
costs the tasks that ran on it.  Intermediates are deleted by the operator once
its decisions are written; what remains is removed when the interpreter ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

#: Whether Spark deletes a query's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.

    Only a local session, whose tasks see the driver's disk, may go without one: a
    temporary folder then takes its place.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="skyloom-")
        spark.conf.set("spark.checkpoint.dir", configured)
        atexit.register(_remove_local, configured)
    return configured.rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def without(rows: DataFrame, keys: DataFrame, on: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows whose ``on`` is not among ``keys`` (a table that is already written).

    Up to ``broadcast_rows`` keys are broadcast; more are joined by a shuffle.
    """
    return rows.join(broadcast(keys) if keys.count() <= broadcast_rows else keys, on, "left_anti")


class Scratch:
    """Tables of one operator call, under one folder of the shared directory."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/skyloom/{name}-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}
        atexit.register(self._at_exit)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as a Parquet table and return a frame reading it back.

        The write's shuffle files are deleted when it ends.
        """
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEAN_UP)
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEAN_UP, before)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            self._delete(self._paths.pop(name))

    def keep(self, *names: str) -> None:
        """Delete all tables but these."""
        self.drop(*[n for n in self._paths if n not in names])

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _at_exit(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session ended before the interpreter did
            pass

"""Shared scratch storage: where lineage is cut and intermediate tables live.

Executors may be lost at any time, so intermediate results that are read more
than once are written as Parquet below ``spark.checkpoint.dir`` (a folder that
every executor and the driver share) and read again.  The setting is read from
the session; only when it is unset, as in local tests, a temporary folder is
chosen here.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local temporary one if none is configured."""
    global _fallback
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="graphloom-")
    return f"file://{_fallback}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through Hadoop's file system, whatever its scheme."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Named intermediate tables of one run, each a Parquet folder in shared storage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self._saved: dict[str, DataFrame] = {}
        self.base = f"{shared_dir(spark)}/graphloom/{label}-{uuid.uuid4().hex}"
        atexit.register(self._forget)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back: a plan without the past."""
        where = f"{self.path(name)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        self._saved[where] = out
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete the tables behind frames that ``save`` returned; nothing may read them any more."""
        for where in [w for w, f in self._saved.items() if any(f is g for g in frames)]:
            del self._saved[where]
            delete_path(self.spark, where)

    def keep_only(self, *frames: DataFrame) -> None:
        """Delete all tables but those behind the given frames."""
        self.drop(*[f for f in self._saved.values() if not any(f is g for g in frames)])

    def _forget(self) -> None:
        with contextlib.suppress(Exception):
            delete_path(self.spark, self.base)

"""Shared working storage: the one place where a plan's lineage is cut.

``materialize`` writes a frame to the folder that the session names in ``spark.checkpoint.dir`` and reads
it back.  The files outlive any executor, and their sizes give the planner true statistics, so that a join
with a small written table is broadcast because its size is known, never because somebody hoped so.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_written: list[tuple[SparkSession, str]] = []
_local_default: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  A private folder is made only where none is set and the master is local."""
    global _local_default
    configured = spark.conf.get(_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"set {_CONF} to a folder that all executors share")
    if _local_default is None or not os.path.isdir(_local_default):
        _local_default = tempfile.mkdtemp(prefix="lectern-")
    return f"file://{_local_default}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared storage and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[None]:
    """Deletes on leaving what was written inside; results that read it must have been saved or counted by then."""
    mark = len(_written)
    try:
        yield
    finally:
        _delete(mark)


def cleanup() -> None:
    """Delete every table written by ``materialize`` in this process; results that still read them become invalid."""
    _delete(0)


def _delete(mark: int) -> None:
    while len(_written) > mark:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            continue  # no way to the store any more; the folder belongs to the cluster
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True):
            warnings.warn(f"could not delete {path}", stacklevel=2)


def _at_exit() -> None:
    try:
        cleanup()
    except Exception as e:  # the driver's JVM may be going already
        warnings.warn(f"intermediate tables are left: {e}", stacklevel=1)


atexit.register(_at_exit)

"""Tables in the folder that every executor shares, used to cut lineage."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no folder, as in tests.
DEFAULT_DIR = "/tmp/checkpoints/tidemark"
#: While it is on, an execution's shuffle files go when the execution ends; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_MADE = threading.local()


def _made() -> list[DataFrame]:
    """The tables that this thread has made and not dropped."""
    if not hasattr(_MADE, "tables"):
        _MADE.tables = []
    return _MADE.tables


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local session uses ``DEFAULT_DIR``; a cluster's is
    refused, as its machines share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or DEFAULT_DIR).rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lost executor costs no recomputation.

    The shuffle files behind it are deleted once the table is whole, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _made().append(out)
    return out


def mark() -> int:
    """To be given to :func:`dropped_since` later."""
    return len(_made())


def dropped_since(at: int, *kept: DataFrame) -> None:
    """Delete the tables that this thread has made since :func:`mark` gave ``at``, but for ``kept``.

    With 0 it deletes all: call it once a session's results have been read, as lazy ones stand on such tables.
    """
    dropped(*(t for t in _made()[at:] if all(t._stored_at != k._stored_at for k in kept)))


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored`, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _made()[:] = [t for t in _made() if t._stored_at != df._stored_at]

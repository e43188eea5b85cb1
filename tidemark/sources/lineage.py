"""Tables in the folder that every executor shares, which cut the lineage of iterated ones."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no folder, as in tests.
DEFAULT_DIR = "/tmp/checkpoints/tidemark"


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without it uses ``DEFAULT_DIR``, a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or DEFAULT_DIR).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the folder of ``spark.checkpoint.dir`` and read from there: plans stay short, and a
    lost executor costs no recomputation."""
    path = f"{folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut`, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

"""Cutting lineage and deciding about broadcasts, the two plan decisions that Catalyst cannot take alone."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Above this estimated size a side is never broadcast by hand.
BROADCAST_LIMIT = 8 << 20

_written: list[tuple[SparkSession, str]] = []
_local: list[str] = []


def path_of(spark: SparkSession, path: str):  # noqa: ANN201
    """The Hadoop file system of path, whatever its scheme, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@atexit.register
def forget() -> None:
    """Removes the tables that cut() has written; called when the driver ends."""
    while _written:
        spark, path = _written.pop()
        try:
            fs, at = path_of(spark, path)
            fs.delete(at, True)
        except Exception:  # noqa: BLE001, S110 - the session may have ended before
            pass


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, else the checkpoint directory set on the context. Without either a
    temporary folder in local mode (tests), where one machine runs everything; an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="studyloom-"))
    return _local[0]


def cut(df: DataFrame) -> DataFrame:
    """df written once as a table in the shared folder and read back: survives lost executors, is never recomputed."""
    path = os.path.join(shared_dir(df.sparkSession), f"studyloom-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, bytes_a_row: int) -> DataFrame:
    """A broadcast hint where rows (counted by the caller) times the row width stay below the limit, else df itself."""
    return F.broadcast(df) if rows * bytes_a_row <= BROADCAST_LIMIT else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer partitions than the cluster has cores (a small table in one file); as it is
    otherwise. For stages that spend far more on a row than moving it costs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

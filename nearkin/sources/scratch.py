"""Folders that driver and executors share, for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.config import EngineError


def shared(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, gone when the session's
    file system closes. Only a local session may do without that setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="nearkin-")
    path = f"{base.rstrip('/')}/nearkin/{name}-{uuid.uuid4().hex}"
    target, files = place(spark, path)
    files.deleteOnExit(target)
    return path


def place(spark: SparkSession, path: str):
    """(path, its file system) in the form that Spark's own readers use."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    target, files = place(spark, path)
    files.delete(target, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it isn't there."""
    target, files = place(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []


def written(df: DataFrame, path: str, sort_by: str | None = None, partition_by: str | None = None) -> DataFrame:
    """``df`` as a written table. Sorted by a column, a search for one of its
    values reads the row groups that hold it only."""
    if sort_by:
        df = df.repartitionByRange(F.col(sort_by)).sortWithinPartitions(sort_by)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Folder shared by driver and executors, and small relational helpers.

Every table that cuts lineage is written below ``spark.checkpoint.dir``. Where
that setting is absent a local folder stands in if the master is local too (tests,
notebooks); on a cluster its absence is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which an id set is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Keys that one prefix-sum task takes.
PREFIX_SPAN = 4096


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="nearkin-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


class Workspace:
    """A fresh subfolder of the shared folder, holding one run's tables.

    It goes when the session's file system closes, unless it is to be kept.
    """

    def __init__(self, spark: SparkSession, name: str, keep: bool = False):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/nearkin/{name}-{uuid.uuid4().hex}"
        if not keep:
            target, files = self.place()
            files.deleteOnExit(target)

    def place(self, name: str = ""):
        """(path, file system) of the folder or of one of its tables."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str = "snappy") -> DataFrame:
        """Write ``df`` and return it reread: a restart point that outlives executors."""
        writer = df.write.option("compression", codec)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        target, files = self.place(name)
        files.delete(target, True)


def text_of(docs: DataFrame, text_col: str = "text") -> Column:
    """The text, null taken as empty."""
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so no other name can clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))


def text_key(docs: DataFrame, text_col: str = "text") -> Column:
    """Tells rows that share an id apart when a decision is joined back."""
    return F.xxhash64(text_of(docs, text_col))


def remove_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows named in ``dropped`` (``doc_id``, ``text_key``).

    ``dropped`` must be a written table: its rows are counted. Up to
    ``BROADCAST_ROWS`` it is broadcast and the texts stay where they are;
    beyond, both sides are shuffled on the id.
    """
    return named_rows(docs, dropped, "left_anti")


def only_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are named in ``kept``, a written table too."""
    return named_rows(docs, kept, "left_semi")


def named_rows(docs: DataFrame, names: DataFrame, how: str) -> DataFrame:
    names = names.select(F.col("doc_id").alias("__named_id"), F.col("text_key").alias("__named_key"))
    if names.count() <= BROADCAST_ROWS:
        names = F.broadcast(names)
    same = docs["doc_id"].eqNullSafe(names["__named_id"]) & (text_key(docs) == names["__named_key"])
    return docs.join(names, same, how)


def exclusive_prefix(counts: DataFrame, key: str, amount: str, out: str) -> DataFrame:
    """Adds to each row the sum of ``amount`` over smaller ``key`` values.

    ``key`` holds distinct non-negative integers. Sums run inside spans of keys
    first; only one total per span meets in a single task.
    """
    span = F.floor(F.col(key) / PREFIX_SPAN)
    spans = counts.groupBy(span.alias("__span")).agg(F.sum(amount).alias("__total"))
    before = spans.select(
        "__span",
        F.coalesce(F.sum("__total").over(Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"),
    )
    inside = Window.partitionBy("__span").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("__span", span)
        .withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(before, "__span")
        .withColumn(out, F.col("__base") + F.col("__inside"))
        .drop("__span", "__inside", "__base")
    )

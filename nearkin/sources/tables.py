"""The engine's inputs from files: events, vectors, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearkin.functions.meta import meta_map, typed
from nearkin.functions.vector import norm

EVENT_JSON = T.StructType([T.StructField("ctx", T.StringType()), T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("score", T.StringType()), T.StructField("timestamp", T.LongType())])


def seconds(column: str) -> Column:
    """Whole seconds since 1970 of a timestamp without a zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events_of(table: DataFrame) -> DataFrame:
    """The interaction table as events: users are contexts, ``props.k`` items."""
    return table.select(
        F.col("user_id").cast("string").alias("ctx"),
        F.get_json_object("props", "$.k").alias("item_id"),
        F.when(F.col("event_type") == "error", 0).otherwise(F.least(F.floor("value"), F.lit(100))).cast("int").alias("score"),
        seconds("ts").alias("ts"),
        F.when(F.col("event_type") == "error", "DEL").when(F.col("event_type") == "signup", "SET").otherwise("ADD").alias("type"),
        F.col("event_id").alias("seq"),
    )


def kind_events_of(table: DataFrame) -> DataFrame:
    """Additions of a constant score per event type: many repeats."""
    return table.select(
        F.col("user_id").cast("string").alias("ctx"),
        F.col("event_type").alias("item_id"),
        F.lit(10).alias("score"),
        seconds("ts").alias("ts"),
        F.lit("ADD").alias("type"),
        F.col("event_id").alias("seq"),
    )


def vectors_of(table: DataFrame) -> DataFrame:
    """(id, vec, norm) with norms kept for later searches."""
    return table.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"), norm(F.col("embedding")).alias("norm"))


def metadata_of(table: DataFrame) -> DataFrame:
    """(id, meta): a label, a name, a rate and a flag; every seventh row has none
    of them, and rows divisible by five have no ``name``."""
    n, label = F.col("vec_id"), F.col("label")
    whole = {"label": typed("i", label), "name": typed("s", F.concat(F.lit("c"), label.cast("string"))), "rate": typed("d", n % 10 / F.lit(4.0)), "even": typed("b", n % 2 == 0)}
    short = {k: v for k, v in whole.items() if k != "name"}
    return table.where("vec_id % 7 <> 6").select(n.cast("string").alias("id"), F.when(n % 5 == 0, meta_map(short)).otherwise(meta_map(whole)).alias("meta"))


def events_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events from JSON bodies; a score that isn't an integer becomes null."""
    e = F.from_json(column, EVENT_JSON)
    score = F.when(e["score"].rlike(r"^[+-]?[0-9]+$"), e["score"].cast("int"))
    return lines.select(e["ctx"].alias("ctx"), e["id"].alias("item_id"), score.alias("score"), F.coalesce(e["timestamp"], F.unix_timestamp()).alias("ts"), F.upper(e["type"]).alias("type"), "seq")

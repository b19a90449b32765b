"""Snapshots: a Parquet folder per store, sealed by a manifest.

A snapshot is complete once its manifest is there; the manifest is written last
and names each store's rows, checksum and the last change it holds.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearkin.config import EngineError
from nearkin.sources import scratch

VERSION = 1
MANIFEST = "version int, created long, last_seq long, config string, stores map<string,struct<rows:bigint,checksum:bigint,schema:string>>"


def checksum(df: DataFrame) -> tuple[int, int]:
    """(rows, order-free checksum)."""
    cols = [F.to_json(c) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c) for c in df.columns]
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64(*cols)), F.lit(0))).first()
    return row[0], row[1]


def save(stores: dict[str, DataFrame], path: str, created: int, last_seq: int = 0, config: dict | None = None) -> None:
    """Write all stores, then the manifest. An existing snapshot stays as it is."""
    spark = next(iter(stores.values())).sparkSession
    held = {}
    for name, df in stores.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        rows, check = checksum(spark.read.parquet(f"{path}/{name}"))
        held[name] = (rows, check, df.schema.json())
    manifest = spark.createDataFrame([(VERSION, created, last_seq, json.dumps(config or {}), held)], MANIFEST)
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")


def info(spark: SparkSession, path: str) -> DataFrame:
    """A row per store: store, rows, checksum, and the snapshot's own fields."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return manifest.select("version", "created", "last_seq", F.explode("stores").alias("store", "held")).select("store", "held.rows", "held.checksum", "version", "created", "last_seq")


def stores(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").first()
    if manifest is None or manifest["version"] != VERSION:
        raise EngineError(f"no snapshot of version {VERSION}: {path}")
    return {name: spark.read.schema(T.StructType.fromJson(json.loads(held["schema"]))).parquet(f"{path}/{name}") for name, held in manifest["stores"].items()}


def verify(spark: SparkSession, path: str) -> DataFrame:
    """A row per store: store, rows, ok."""
    wanted = {r["store"]: (r["rows"], r["checksum"]) for r in info(spark, path).collect()}
    found = {name: checksum(df) for name, df in stores(spark, path).items()}
    return spark.createDataFrame([(n, found[n][0], found[n] == wanted[n]) for n in sorted(wanted)], "store string, rows long, ok boolean")


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], int]:
    """(stores, last change) of a snapshot that is whole."""
    bad = [r["store"] for r in verify(spark, path).where("not ok").collect()]
    if bad:
        raise EngineError(f"damaged stores: {', '.join(bad)}")
    return stores(spark, path), spark.read.schema(MANIFEST).parquet(f"{path}/manifest").first()["last_seq"]


def retain(names: list[str], keep: int) -> list[str]:
    """Automatic snapshots to delete: all but the newest; others are never named."""
    own = sorted(n for n in names if n.startswith("auto_"))
    return own[: max(0, len(own) - keep)] if keep else []


def prune(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Delete the automatic snapshots of a folder but the newest; their names."""
    gone = retain(scratch.folders(spark, folder), keep)
    for name in gone:
        scratch.remove(spark, f"{folder}/{name}")
    return gone

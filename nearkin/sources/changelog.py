"""The change log: one typed row per change, in segments of Parquet.

Rows carry ``seq`` (contiguous from 1), ``op`` and the fields that the op has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearkin.config import EngineConfig, EngineError
from nearkin.functions.meta import META_TYPE
from nearkin.operators import cooccurrence, events, vectors
from nearkin.sources import scratch

OPS = ("VECSET", "VECDEL", "EVENT", "METASET", "METADEL", "MAINTAIN")
FIELDS = f"seq long, ts_us long, op string, id string, ctx string, item_id string, score int, ts long, type string, vec array<float>, meta {META_TYPE}"
LOG = f"{FIELDS}, crc long"


def sealed(rows: DataFrame) -> DataFrame:
    """Rows in the log's columns, each with a checksum of its fields."""
    have = set(rows.columns)
    spark = rows.sparkSession
    empty = spark.createDataFrame([], LOG)
    fields = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema if f.name != "crc"]
    return rows.select(*fields).withColumn("crc", row_crc())


def row_crc() -> F.Column:
    names = ("seq", "op", "id", "ctx", "item_id", "score", "ts", "type")
    return F.crc32(F.to_json(F.struct(*names, "vec", "meta")))


def append(rows: DataFrame, path: str, segment: int) -> None:
    """Write one segment; its rows must follow the last one's."""
    sealed(rows).write.mode("errorifexists").parquet(f"{path}/segment={segment:08d}")


def read(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    return spark.read.schema(LOG).parquet(f"{path}/segment=*").where(F.col("seq") > after)


def check(log: DataFrame) -> int:
    """The last sequence number; an error where rows are damaged or missing.

    Sequence numbers are whole, so distinct ones from least to largest are
    contiguous exactly if there are as many as the range is wide.
    """
    row = log.agg(F.count(F.lit(1)), F.min("seq"), F.max("seq"), F.countDistinct("seq"), F.sum((F.col("crc") != row_crc()).cast("int"))).first()
    n, low, high, distinct, bad = row
    if not n:
        return 0
    if bad:
        raise EngineError(f"{bad} damaged rows")
    if distinct != n or high - low + 1 != n:
        raise EngineError("the log has gaps or repeats")
    return high


def truncatable(log: DataFrame, seq: int) -> DataFrame:
    """(segment) of closed segments whose rows a snapshot up to ``seq`` holds."""
    named = log.withColumn("segment", F.regexp_extract(F.input_file_name(), r"segment=(\d+)", 1))
    last = named.groupBy("segment").agg(F.max("seq").alias("last"))
    newest = F.max("segment").over(Window.partitionBy())
    return last.withColumn("newest", newest).where((F.col("last") <= seq) & (F.col("segment") < F.col("newest"))).select("segment")


def segments(spark: SparkSession, path: str) -> list[str]:
    return [n for n in scratch.folders(spark, path) if n.startswith("segment=")]


def truncate(spark: SparkSession, path: str, seq: int) -> list[str]:
    """Delete the closed segments that a snapshot up to ``seq`` holds; their names."""
    if not segments(spark, path):
        return []
    gone = sorted(f"segment={r['segment']}" for r in truncatable(read(spark, path), seq).collect())
    for name in gone:
        scratch.remove(spark, f"{path}/{name}")
    return gone


def replay(log: DataFrame, config: EngineConfig, base: dict[str, DataFrame] | None = None, folder: str | None = None, accepted: bool = True) -> dict[str, DataFrame]:
    """The stores after the log, on top of a snapshot's.

    Logged events that were ``accepted`` when they were written aren't checked
    for repeats again. A maintenance row fades and prunes what came before it:
    every pair is worked out once, under the number of the first maintenance
    after it, and the graph is written below ``folder`` at each of these, so the
    work grows with the log and no plan does.
    """
    base = base or {}
    spark = log.sparkSession
    folder = folder or scratch.shared(spark, "replay")
    vec = log.where("op in ('VECSET', 'VECDEL')").select("id", "vec", "seq")
    if "vectors" in base:
        vec = vec.unionByName(base["vectors"].select("id", "vec", F.lit(0).cast("long").alias("seq")))
    store = vectors.vector_store(vec)
    gone = log.where("op = 'VECDEL'").select("id", F.lit(None).cast(META_TYPE).alias("meta"), "seq")
    meta = log.where("op in ('METASET', 'METADEL')").select("id", "meta", "seq").unionByName(gone)
    if "metadata" in base:
        meta = meta.unionByName(base["metadata"].select("id", "meta", F.lit(0).cast("long").alias("seq")))
    new = log.where("op = 'EVENT'").select("ctx", "item_id", "score", "ts", "type", "seq")
    earlier, start = base.get("events"), 0
    whole = new
    if earlier is not None:
        start = earlier.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        whole = earlier.unionByName(new.where(F.col("seq") > start))
    if not accepted:
        whole = events.accept(whole, config)

    stops = [r["seq"] for r in log.where("op = 'MAINTAIN'").select("seq").orderBy("seq").collect()]
    spans = [(i, low + 1, high) for i, (low, high) in enumerate(zip([-1, *stops], [*stops, (1 << 63) - 1], strict=True))]
    spans = spark.createDataFrame(spans, "cycle int, low long, high long")
    numbered = whole.join(F.broadcast(spans), F.col("seq").between(F.col("low"), F.col("high"))).drop("low", "high")
    met = cooccurrence.pairs(numbered, config.ctx_buffer_size, start or None, ("cycle",))
    parts = cooccurrence.both_ways(cooccurrence.contributions(met, config, "cycle"), "cycle")
    if stops:
        parts = scratch.written(parts, f"{folder}/parts", partition_by="cycle")
    edges = base.get("edges")
    for cycle in range(len(stops) + 1):
        part = parts.where(F.col("cycle") == cycle).select("item1", "item2", "score")
        edges = part if edges is None else cooccurrence.merge_edges(edges, part)
        if cycle < len(stops):
            edges = cooccurrence.maintain(edges, config, 1, cycle)
            edges = scratch.written(edges, f"{folder}/edges-{cycle}")
    return {"vectors": store, "metadata": vectors.metadata_store(meta, store), "events": whole, "edges": edges}

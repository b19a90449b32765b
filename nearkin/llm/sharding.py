"""Sharding by a two-pass external shuffle.

Pass one scatters records over memory-sized buckets by seeded hashes; Spark's
shuffle files are the external buckets. Beyond ``MAX_BUCKETS`` buckets are nested:
a task then has an outer bucket and takes the inner ones in turn, so a bucket's
size never grows with the input. Pass two holds one bucket at a time, puts it in Fisher-Yates order (the built-in ``shuffle``, which is the inside-out
form of it, seeded) and writes it. A record's place in the whole order is its
bucket's first place, known from a count of the buckets, plus its place inside;
shards are equal consecutive stretches of that order, so their counts differ by
one at most (law ``rows``) and a bucket goes to one or two shards.

Only DataFrame operations run here. A bucket is sorted before it is shuffled
and has a partition of its own, so a task that is run again gives the same
order. Copies and repeated rows spread evenly where their ids or texts differ.

Defined results: a null text stays null and has size 16; a null id is hashed
with its text; an empty table writes no shard and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearkin.llm.shared import Workspace, exclusive_prefix

#: Outer buckets at most; the table of their first places is broadcast and so has
#: this many rows at most.
MAX_BUCKETS = 1 << 18


def shard_records(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 20260, bucket_bytes: int = 8 << 20, work: Workspace | None = None) -> DataFrame:
    """Write all records in shuffled order, one folder per shard; reread them.

    Returns ``record`` (a struct of all columns of ``docs``), shard, slot.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "sharding")
    size = F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long") + 16
    n, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    wanted = max(1, -(-total // bucket_bytes))
    buckets = min(MAX_BUCKETS, wanted)
    nested = -(-wanted // buckets)

    def part_of(seed: int, n: int):
        return F.pmod(F.xxhash64(F.lit(seed), docs[id_col], docs[text_col]), F.lit(n)).cast("int")

    keyed = docs.select(
        part_of(seed, buckets).alias("bucket"),
        (part_of(seed + 1, nested) if nested > 1 else F.lit(0)).alias("inner"),
        F.struct(docs[id_col].alias("__id"), F.struct(*docs.columns).alias("record")).alias("entry"),
    )
    firsts = exclusive_prefix(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket", "n", "first").select("bucket", "first")
    held = keyed.repartitionById(buckets, F.col("bucket")).groupBy("bucket", "inner").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    before = F.lit(0)
    if nested > 1:  # places of the inner buckets, in the outer one's task
        before = F.coalesce(F.sum(F.size("entries")).over(Window.partitionBy("bucket").orderBy("inner").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shuffled = (
        held.withColumn("before", before)
        .withColumn("entries", F.shuffle("entries", seed))
        .join(F.broadcast(firsts), "bucket")
        .select("first", "before", F.posexplode("entries").alias("place", "entry"))
        .withColumn("position", F.col("first") + F.col("before") + F.col("place"))
    )
    short, longer = n // n_shards, n % n_shards
    edge = longer * (short + 1)
    at, rest = F.col("position"), F.col("position") - F.lit(edge)
    head = at < F.lit(edge)
    placed = shuffled.select(
        "entry.record",
        F.when(head, F.floor(at / F.lit(short + 1))).otherwise(F.lit(longer) + F.floor(rest / F.lit(max(short, 1)))).cast("int").alias("shard"),
        F.when(head, F.pmod(at, F.lit(short + 1))).otherwise(F.pmod(rest, F.lit(max(short, 1)))).cast("long").alias("slot"),
    )
    return work.table(placed.sortWithinPartitions("shard", "slot"), "shards", partition_by=["shard"], codec="snappy")


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return shard_records(docs, 40).select(
        "record.doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

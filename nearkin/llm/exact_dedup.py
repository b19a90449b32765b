"""Exact deduplication over an extendible-hash index on shared files.

The key of a text is its 64-bit hash; a bucket owns all keys that start with
its bits. The directory starts with one bucket and doubles until no bucket
holds more than ``bucket_keys`` distinct keys. Every owner task has a contiguous
range of buckets:

* a key that stands in one row goes to its owner with the row's id alone;
* texts whose key repeats go there whole, copies collapsed before by the
  map-side partial aggregate, so a hot text costs a row or so per task;
* the owner sorts a bucket by key and bytes, numbers the different texts of one
  key along its chain, adds up equal ones, and writes the bucket.

Rows then look their group up by bucket, key and digest.

Only DataFrame operations run here. The look-up is an equi-join of two written
tables, which adaptive execution splits where one group is hot.

Defined results: a null text counts as empty; rows repeated with the same id
and text are counted one by one and exactly one of them is kept; a null id is
kept only where no other id has that text; an empty table gives an empty result;
other columns of the table are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearkin.llm.shared import BROADCAST_ROWS, Workspace, id_and_text

#: Distinct keys of a bucket at most, up to ``MAX_BUCKETS`` times as many of them;
#: of more keys buckets hold an even share, so the directory stays bounded.
BUCKET_KEYS = 1 << 12
MAX_BUCKETS = 1 << 16
#: Bits beyond the number of buckets that the directory can double by. Keys are
#: hashes, so a bucket that is still too full then is a chance event: it stays
#: whole, and its owner sorts a little more.
SPARE_BITS = 3
#: Parts that rows of a repeated text are collapsed in before they are routed.
SALTS = 4


def build_directory(histogram: dict[int, int], bucket_keys: int, max_depth: int) -> list[tuple[int, int, int]]:
    """Directory slots as (slot, bucket, local depth), buckets in key order.

    ``histogram`` counts distinct keys by their first ``max_depth`` bits.
    """
    total = [0] * ((1 << max_depth) + 1)
    for i in range(1 << max_depth):
        total[i + 1] = total[i] + histogram.get(i, 0)

    def held(prefix: int, depth: int) -> int:
        width = max_depth - depth
        return total[(prefix + 1) << width] - total[prefix << width]

    depth, slots = 0, [(0, 0)]
    while True:
        over = [i for i, (prefix, local) in enumerate(slots) if local < max_depth and held(prefix, local) > bucket_keys]
        if not over:
            break
        if any(slots[i][1] == depth for i in over):
            slots = [s for s in slots for _ in (0, 1)]
            depth += 1
        for i, (prefix, local) in enumerate(slots):
            if local < depth and held(prefix, local) > bucket_keys:
                slots[i] = (2 * prefix + (i >> (depth - local - 1) & 1), local + 1)
    number: dict[tuple[int, int], int] = {}
    return [(i, number.setdefault(s, len(number)), s[1]) for i, s in enumerate(slots)]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS, work: Workspace | None = None, key_of: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """(entries, index), both written tables.

    entries: doc_id, bucket, key, sha, copies — one row per distinct (id, text).
    index: bucket, key, link (place in the key's chain), sha, keep_id, group_size
    — one row per distinct text.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "exact_dedup")
    rows = id_and_text(docs, id_col, text_col).withColumn("key", key_of(F.col("text")))
    sha = F.unhex(F.sha2("text", 256)).alias("sha")
    entries = work.table(rows.select("doc_id", "key", sha).groupBy("doc_id", "key", "sha").agg(F.count(F.lit(1)).alias("copies")), "entries")
    keys = entries.groupBy("key").agg(F.sum("copies").alias("n"), F.max("doc_id").alias("keep_id"), F.min("sha").alias("sha"))
    keys = work.table(keys, "keys")

    distinct = keys.count()
    bucket_keys = max(bucket_keys, distinct // MAX_BUCKETS)
    bits = max(1, math.ceil(math.log2(max(1, distinct) / bucket_keys))) + SPARE_BITS
    prefix = F.shiftrightunsigned("key", 64 - bits)
    slots = build_directory({r["prefix"]: r["count"] for r in keys.groupBy(prefix.alias("prefix")).count().collect()}, bucket_keys, bits)
    depth = int(math.log2(len(slots)))
    n_buckets = slots[-1][1] + 1
    owners = min(n_buckets, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    directory = work.table(
        spark.createDataFrame([(s, b, d, b * owners // n_buckets) for s, b, d in slots], "slot long, bucket int, local_depth int, owner int").coalesce(1),
        "directory",
    )

    def located(df: DataFrame) -> DataFrame:
        # shift counts are taken modulo 64, so the one-slot directory is spelt out
        if not depth:
            return df.withColumns({"bucket": F.lit(0), "owner": F.lit(0)})
        slot = F.shiftrightunsigned("key", 64 - depth)
        return df.withColumn("slot", slot).join(F.broadcast(directory.select("slot", "bucket", "owner")), "slot").drop("slot")

    repeated = keys.where("n > 1").select("key")
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    texts = rows.join(repeated, "key", "left_semi").groupBy("key", "text", salt.alias("salt")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    single = keys.where("n = 1").select("key", F.lit(None).cast("string").alias("text"), "sha", "keep_id", "n")
    routed = located(texts.select("key", "text", sha, "keep_id", "n").union(single)).repartitionById(owners, F.col("owner"))
    # in the owner's task: one sort by key and bytes, a chain for each key, a sum for each text
    link = F.dense_rank().over(Window.partitionBy("owner", "bucket", "key").orderBy("text")).alias("link")
    chains = routed.select("owner", "bucket", "key", link, "sha", "keep_id", "n").groupBy("owner", "bucket", "key", "link")
    index = chains.agg(F.first("sha").alias("sha"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    index = index.sortWithinPartitions("bucket", "key", "link").select("bucket", "key", "link", "sha", "keep_id", "group_size")
    return located(entries).select("doc_id", "bucket", "key", "sha", "copies"), work.table(index, "index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS, work: Workspace | None = None, key_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, text_key, keep_id, group_size, kept, sha."""
    entries, index = exact_groups(docs, id_col, text_col, bucket_keys, work, key_of)
    found = entries.join(index.drop("link"), ["bucket", "key", "sha"])
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "doc_id",
        F.col("key").alias("text_key"),
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "sha",
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP4_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

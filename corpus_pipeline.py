"""From raw documents to packed training sequences, in four stages.

Each stage takes the session, the documents that the stage before it kept and
the folder of the input tables, and returns a DataFrame. ``run`` writes each
stage's result below ``spark.checkpoint.dir`` and reads it for the next, so a
lost executor never sends work back further than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.llm import exact_dedup, language_id, near_copies, packing
from nearkin.llm.shared import Workspace, only_rows, remove_rows, text_key


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is in no language that the corpus names."""
    return language_id.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text: the one with the largest id."""
    work = Workspace(spark, "pipeline-exact")
    found = exact_dedup.exact_dedup(docs, work=work)
    return without(docs, found, F.col("kept"), work)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies (five words, 0.8 alike): the smallest id."""
    work = Workspace(spark, "pipeline-near")
    found = near_copies.near_copies(docs, work=work)
    return without(docs, found, F.col("doc_id").eqNullSafe(F.col("component_id")), work)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of 2048 tokens."""
    return packing.packed(docs)


def without(docs: DataFrame, found: DataFrame, kept, work: Workspace) -> DataFrame:
    """``docs`` less the rows that aren't ``kept``; of repeated rows one stays."""
    found = work.table(found.select("doc_id", "text_key", kept.alias("kept")), "decisions")
    rows = found.groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    rows = work.table(rows.where("not kept or n > 1"), "notable")
    left = remove_rows(docs, rows.where("not kept"))
    again = rows.where("kept")
    if again.isEmpty():
        return left
    # rows with the same id and text: only these are moved, one of each stays
    same = only_rows(left, again)
    record = F.struct(*(same[f"`{c}`"] for c in docs.columns)).alias("record")
    one = same.select(same["doc_id"].alias("id"), text_key(same).alias("key"), record).groupBy("id", "key").agg(F.first("record").alias("record"))
    return remove_rows(left, again).union(one.select("record.*"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("best_fit_packing", pack)]

#: Language models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

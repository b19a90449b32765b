"""The vector and metadata stores as tables kept by a log of changes.

Change rows carry ``seq``; the last one of an id decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.config import EngineError
from nearkin.functions.vector import norm

MAX_DIMENSION = 4096


def valid_vector(vec: str = "vec") -> F.Column:
    """Whether the components are all there, finite, and not too many."""
    v = F.col(vec)
    bad = F.exists(v.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & (F.size(v) <= MAX_DIMENSION) & ~F.coalesce(bad, F.lit(True))


def latest(changes: DataFrame, key: str = "id") -> DataFrame:
    """The last change of each id: a partial aggregate, no sort of a hot id."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("__last")).select(key, "__last.*")


def vector_store(changes: DataFrame) -> DataFrame:
    """(id, vec, norm) from changes (id, vec, seq); a null vector deletes."""
    return latest(changes).where("vec is not null").select("id", "vec", norm(F.col("vec")).alias("norm"))


def check_dimension(changes: DataFrame) -> int | None:
    """The store's dimension, learned from its first vector; others are refused."""
    first, low, high = changes.where("vec is not null").agg(F.min_by(F.size("vec"), "seq"), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if first is not None and (low, high) != (first, first):
        raise EngineError(f"vectors have {low} to {high} components; the store's have {first}")
    return first


def delete_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("id"), "id", "left_anti")


def metadata_store(changes: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, meta): whole maps are replaced, and belong to a vector that exists."""
    return latest(changes).where("meta is not null").select("id", "meta").join(vectors.select("id"), "id", "left_semi")


def has_vector(vectors: DataFrame, item: str) -> DataFrame:
    return vectors.where(F.col("id") == item).agg((F.count(F.lit(1)) > 0).alias("found"))


def get_vector(vectors: DataFrame, item: str) -> DataFrame:
    return vectors.where(F.col("id") == item).select("id", "vec")


def compact(vectors: DataFrame, files: int) -> DataFrame:
    """The table in fewer files; deleted rows aren't there to begin with."""
    return vectors.coalesce(files)

"""Similarity search by events, by vectors, and by both.

Results are (item_id, score), larger scores first, then smaller ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearkin.config import EngineConfig, EngineError
from nearkin.functions import vector as V
from nearkin.operators import cooccurrence, filters

# Fixed value: scores closer than this aren't spread out.
LEAST_RANGE = 1e-4


def check_top_k(k: int, config: EngineConfig) -> int:
    if not 1 <= k <= config.max_top_k:
        raise EngineError(f"top_k must be from 1 to {config.max_top_k}")
    return k


def best(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("score"), "item_id").limit(k)


def min_score(results: DataFrame, least: float | None = 0.0) -> DataFrame:
    """After the top k are chosen: those that score enough."""
    return results if least is None else results.where(F.col("score") >= least)


def rounded(results: DataFrame) -> DataFrame:
    """Scores to four decimals, as they are shown."""
    return results.withColumn("score", F.round("score", 4))


def by_events(edges: DataFrame, item: str, k: int, config: EngineConfig, metadata: DataFrame | None = None, filter_text: str = "") -> DataFrame:
    """Neighbours with positive scores. An unknown item has none."""
    check_top_k(k, config)
    found = cooccurrence.neighbors(edges, item).where("score > 0")
    return best(filters.keep_matching(found, metadata, filter_text), k)


def scored(vectors: DataFrame, query: Column, metric: str, query_norm: Column | None = None) -> DataFrame:
    """(item_id, score) of all vectors against one; stored norms are used."""
    if metric == "cosine":
        score = V.cosine(F.col("vec"), query, F.col("norm"), query_norm if query_norm is not None else V.norm(query))
    else:
        score = V.similarity(metric, F.col("vec"), query)
    return vectors.select(F.col("id").alias("item_id"), score.alias("score"))


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def sampled(vectors: DataFrame, config: EngineConfig, seed: int = 0) -> DataFrame:
    """With a sample size set and far fewer than all rows: that many at random."""
    if config.sample_size and vectors.count() > 2 * config.sample_size:
        return vectors.orderBy(F.rand(seed)).limit(config.sample_size)
    return vectors


def fetch_vector(vectors: DataFrame, item: str) -> list[float]:
    row = vectors.where(F.col("id") == item).select("vec").first()
    if row is None:
        raise EngineError(f"no vector: {item}")
    return list(row["vec"])


def by_vector(vectors: DataFrame, query: list[float], k: int, config: EngineConfig, metadata: DataFrame | None = None, filter_text: str = "", without: str | None = None) -> DataFrame:
    """The stored vectors most similar to a given one."""
    check_top_k(k, config)
    if not query or not all(math.isfinite(x) for x in query):
        raise EngineError("a query vector needs finite components")
    if config.distance_metric == "cosine" and without is None and math.sqrt(sum(x * x for x in query)) < V.TINY_NORM:
        raise EngineError("a query vector needs length")
    rows = filters.keep_matching(vectors, metadata, filter_text, key="id") if filter_text else vectors
    rows = sampled(rows.where(F.col("id") != without) if without is not None else rows, config)
    return best(scored(rows.where(F.size("vec") == len(query)), literal(query), config.distance_metric), k)


def by_item_vector(vectors: DataFrame, item: str, k: int, config: EngineConfig, metadata: DataFrame | None = None, filter_text: str = "") -> DataFrame:
    """The stored vectors most similar to a stored one, itself left out."""
    check_top_k(k, config)
    return by_vector(vectors, fetch_vector(vectors, item), k, config, metadata, filter_text, without=item)


def normalized_scores(results: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Scores spread over 0 to 1, or held to it where there is nothing to spread."""
    w = Window.partitionBy(*keys)
    low, high, n = F.min("score").over(w), F.max("score").over(w), F.count(F.lit(1)).over(w)
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return results.withColumn("score", F.when((n <= 1) | (high - low < LEAST_RANGE), held).otherwise((F.col("score") - low) / (high - low)))


def adaptive_alpha(neighbors: Column, config: EngineConfig) -> Column:
    """Weight of vectors: it falls as an item gathers neighbours."""
    ratio = F.least(F.lit(1.0), neighbors / F.lit(float(config.adaptive_maturity))) if config.adaptive_maturity else F.lit(1.0)
    return F.lit(config.adaptive_max_alpha) - ratio * (config.adaptive_max_alpha - config.adaptive_min_alpha)


def fused(events: DataFrame, vectors: DataFrame, alpha: Column, beta: Column, keys: list[str]) -> DataFrame:
    """Both sources' normalised candidates, weighted and summed per item.

    A query with candidates from one source only gives that source all weight.
    ``alpha`` and ``beta`` are over columns of ``vectors`` and ``events``.
    """
    parts = normalized_scores(events, keys).select(*keys, "item_id", "score", beta.alias("weight"), F.lit(0).alias("source"))
    parts = parts.unionByName(normalized_scores(vectors, keys).select(*keys, "item_id", "score", alpha.alias("weight"), F.lit(1).alias("source")))
    w = Window.partitionBy(*keys)
    weights = [F.max(F.when(F.col("source") == i, F.col("weight"))).over(w) for i in (0, 1)]
    both = weights[0].isNotNull() & weights[1].isNotNull()
    total = weights[0] + weights[1]
    share = F.when(~both, 1.0).when(total > 0, F.col("weight") / total)
    parts = parts.withColumn("share", share).where("share is not null")
    return parts.groupBy(*keys, "item_id").agg(F.sum(F.col("share") * F.col("score")).alias("score"))


def by_fusion(edges: DataFrame, vectors: DataFrame, item: str, k: int, config: EngineConfig, metadata: DataFrame | None = None, filter_text: str = "", adaptive: bool | None = None) -> DataFrame:
    """Events and vectors together; an item known to neither is an error."""
    check_top_k(k, config)
    fetch = min(3 * k, config.max_top_k)
    events = by_events(edges, item, fetch, config, metadata, filter_text)
    try:
        found = by_item_vector(vectors, item, fetch, config, metadata, filter_text)
    except EngineError:
        if events.isEmpty():
            raise
        found = vectors.limit(0).select(F.col("id").alias("item_id"), F.lit(0.0).alias("score"))
    alpha, beta = config.fusion_alpha, config.fusion_beta
    if config.adaptive_fusion if adaptive is None else adaptive:
        n = cooccurrence.neighbors(edges, item).count()
        ratio = min(1.0, n / config.adaptive_maturity) if config.adaptive_maturity else 1.0
        alpha = config.adaptive_max_alpha - ratio * (config.adaptive_max_alpha - config.adaptive_min_alpha)
        beta = 1.0 - alpha
    return best(fused(events, found, F.lit(alpha), F.lit(beta), []), k)


def top_per_query(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with ranks."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def batch_events(edges: DataFrame, k: int) -> DataFrame:
    """``by_events`` of all items: (query_id, item_id, score, rank)."""
    return top_per_query(edges.where("score > 0").select(F.col("item1").alias("query_id"), F.col("item2").alias("item_id"), "score"), k)


def batch_fusion(edges: DataFrame, vectors: DataFrame, k: int, config: EngineConfig) -> DataFrame:
    """``by_fusion`` of all items that have an edge or a vector."""
    from nearkin.operators.blocks import batch_vectors

    check_top_k(k, config)
    fetch = min(3 * k, config.max_top_k)
    events = batch_events(edges, fetch).drop("rank").withColumn("beta", F.lit(config.fusion_beta))
    found = batch_vectors(vectors, vectors, fetch, config.distance_metric).drop("rank").withColumn("alpha", F.lit(config.fusion_alpha))
    if config.adaptive_fusion:
        counts = cooccurrence.neighbor_counts(edges).withColumnRenamed("item_id", "query_id")
        alpha = adaptive_alpha(F.coalesce("neighbors", F.lit(0)), config)
        events = events.drop("beta").join(counts, "query_id", "left").withColumn("beta", 1 - alpha).drop("neighbors")
        found = found.drop("alpha").join(counts, "query_id", "left").withColumn("alpha", alpha).drop("neighbors")
    return top_per_query(fused(events, found, F.col("alpha"), F.col("beta"), ["query_id"]), k)

"""The weighted co-occurrence graph as a table of directed edges.

Edges are rows (item1, item2, score); each is there in both directions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearkin.config import EngineConfig
from nearkin.operators.events import arrival_rank, ring_buffer

# The least temporal factor, and the least score that decay keeps
# without a minimum support.
LEAST_FACTOR = 1e-6
LEAST_SCORE = 1e-6
#: Decay cycles between two prunings.
PRUNE_EVERY = 10


def pairs(accepted: DataFrame, buffer: int, after: int | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """Each event with the up to ``buffer`` events before it in its context.

    Rows (ctx, item_a, score_a, ts_a, item_b, score_b, ts_b, type_b) and the new
    event b's ``carried`` columns; b came ``after`` a given change. Contexts are cut into runs
    of ``buffer`` events; an event can only meet its own run and the one before,
    so the join is on (ctx, run), has at most ``buffer`` rows a key, and a
    crowded context is spread over many keys.
    """
    ranked = arrival_rank(accepted).withColumn("run", F.floor((F.col("rn") - 1) / buffer))
    names = ("item_id", "score", "ts", "type", "rn")
    new = ranked if after is None else ranked.where(F.col("seq") > after)
    new = new.select("ctx", "run", *(F.col(c).alias(f"{c.removesuffix('_id')}_b") for c in names), *carried)
    old = ranked.select("ctx", F.explode(F.array(F.col("run"), F.col("run") + 1)).alias("run"), *(F.col(c).alias(f"{c.removesuffix('_id')}_a") for c in names[:3]), F.col("rn").alias("rn_a"))
    gap = F.col("rn_b") - F.col("rn_a")
    met = new.join(old, ["ctx", "run"]).where(gap.between(1, buffer) & (F.col("item_a") != F.col("item_b")))
    return met.select("ctx", "item_a", "score_a", "ts_a", "item_b", "score_b", "ts_b", "type_b", *carried)


def batch_pairs(accepted: DataFrame, buffer: int) -> DataFrame:
    """All pairs inside each context's final buffer, older event first."""
    return pairs(ring_buffer(accepted, buffer).drop("rn"), buffer)


def temporal_factor(half_life: float) -> Column:
    """Weight of a pair by its events' ages at the later of the two."""
    later = F.greatest("ts_a", "ts_b")
    fade = lambda ts: F.greatest(F.pow(F.lit(2.0), -(later - F.col(ts)) / F.lit(float(half_life))), F.lit(LEAST_FACTOR))
    return fade("ts_a") * fade("ts_b")


def contributions(met: DataFrame, config: EngineConfig, *keys: str) -> DataFrame:
    """Undirected (*keys, item1, item2, score) parts of edges."""
    ends = [*keys, F.col("item_a").alias("item1"), F.col("item_b").alias("item2")]
    weight = (F.col("score_a").cast("long") * F.col("score_b")).cast("double")
    if config.temporal_cooccurrence:
        weight = weight * temporal_factor(config.temporal_half_life_sec)
    parts = met.select(*ends, weight.alias("score")).where("score <> 0")
    if config.negative_signals:  # these count even where they are zero
        against = -F.col("score_a").cast("double") * F.lit(float(config.negative_weight))
        parts = parts.unionByName(met.where("type_b = 'DEL'").select(*ends, against.alias("score")))
    return parts


def both_ways(parts: DataFrame, *keys: str) -> DataFrame:
    """Summed once per unordered pair, then given in both directions."""
    one = parts.groupBy(*keys, F.least("item1", "item2").alias("item1"), F.greatest("item1", "item2").alias("item2")).agg(F.sum("score").alias("score"))
    ends = F.explode(F.array(F.struct("item1", "item2"), F.struct(F.col("item2").alias("item1"), F.col("item1").alias("item2")))).alias("e")
    return one.select(*keys, ends, "score").select(*keys, "e.item1", "e.item2", "score")


def build_edges(accepted: DataFrame, config: EngineConfig, item: str | None = None) -> DataFrame:
    """The graph that the accepted events give, one by one as they came.

    With an ``item`` only its edges: the others' pairs go before they are summed,
    which no rule of the planner could do behind the sum.
    """
    met = pairs(accepted, config.ctx_buffer_size)
    if item is not None:
        met = met.where((F.col("item_a") == item) | (F.col("item_b") == item))
    return both_ways(contributions(met, config))


def added_edges(stored: DataFrame, more: DataFrame, after: int, config: EngineConfig) -> DataFrame:
    """What ``more`` accepted events, all after ``after``, add to the graph of
    those ``stored``: only the last events of their contexts are looked at."""
    touched = stored.join(more.select("ctx").distinct(), "ctx", "left_semi")
    near = ring_buffer(touched, config.ctx_buffer_size).drop("rn").unionByName(more)
    return both_ways(contributions(pairs(near, config.ctx_buffer_size, after), config))


def limited(edges: DataFrame, config: EngineConfig) -> DataFrame:
    """The limits that hold whenever events come in: support and neighbours."""
    return prune(edges, config.max_neighbors_per_item, config.min_support)


def merge_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Sum of two edge tables."""
    return edges.unionByName(more).groupBy("item1", "item2").agg(F.sum("score").alias("score"))


def floor_of(min_support: float) -> float:
    return min_support if min_support > 0 else LEAST_SCORE


def decay(edges: DataFrame, alpha: float, min_support: float = 0.0, cycles: int = 1) -> DataFrame:
    """Every score times ``alpha``, ``cycles`` times; small ones go.

    Magnitudes only fall, so an edge outlives all cycles if it outlives the last.
    """
    if not 0 <= alpha <= 1:
        return edges
    faded = edges.withColumn("score", F.col("score") * F.lit(float(alpha) ** cycles))
    return faded.where(F.abs("score") >= floor_of(min_support)) if alpha else edges.limit(0)


def prune(edges: DataFrame, max_neighbors: int = 0, min_support: float = 0.0) -> DataFrame:
    """Edges with enough support that are among both ends' largest."""
    kept = edges.where(F.abs("score") >= min_support) if min_support > 0 else edges
    if not max_neighbors:
        return kept
    rank = F.row_number().over(Window.partitionBy("item1").orderBy(F.desc(F.abs("score")), "item2"))
    mine = kept.withColumn("__rank", rank).where(F.col("__rank") <= max_neighbors).drop("__rank")
    other = mine.select(F.col("item2").alias("item1"), F.col("item1").alias("item2"))
    return mine.join(other, ["item1", "item2"], "left_semi")


def maintain(edges: DataFrame, config: EngineConfig, cycles: int, done: int = 0) -> DataFrame:
    """What ``cycles`` more decay intervals leave, with a pruning after each tenth."""
    cycles += done
    while done < cycles:
        step = min(PRUNE_EVERY - done % PRUNE_EVERY, cycles - done)
        edges = decay(edges, config.decay_alpha, config.min_support, step)
        done += step
        if done % PRUNE_EVERY == 0:
            edges = prune(edges, config.max_neighbors_per_item, config.min_support)
    return edges


def pair_score(edges: DataFrame, item1: str, item2: str) -> DataFrame:
    """One row: the pair's score, 0 if there is none."""
    return edges.where((F.col("item1") == item1) & (F.col("item2") == item2)).agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))


def neighbor_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("item1").agg(F.count(F.lit(1)).alias("neighbors")).withColumnRenamed("item1", "item_id")


def neighbors(edges: DataFrame, item: str) -> DataFrame:
    return edges.where(F.col("item1") == item).select(F.col("item2").alias("item_id"), "score")


def all_items(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("item1").alias("item_id")).distinct()


def set_scores(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """``scores`` (item1, item2, score) in place of both directions' scores."""
    ends = F.explode(F.array(F.struct("item1", "item2"), F.struct(F.col("item2").alias("item1"), F.col("item1").alias("item2")))).alias("e")
    new = scores.select(ends, F.col("score").cast("double").alias("score")).select("e.item1", "e.item2", "score").distinct()
    return edges.join(new, ["item1", "item2"], "left_anti").unionByName(new)


def graph_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.countDistinct("item1").alias("tracked_items"), F.floor(F.count(F.lit(1)) / 2).alias("pairs"))

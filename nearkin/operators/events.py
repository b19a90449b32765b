"""Acceptance of events: validation, deduplication, and each context's buffer.

Events are rows (ctx, item_id, score, ts, type, seq); ``seq`` is the order of
arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearkin.config import EngineConfig

EVENT_COLUMNS = ("ctx", "item_id", "score", "ts", "type", "seq")
#: Rows of a context that are ranked in one group, about.
RANK_SPAN = 100_000


def reject_reason() -> F.Column:
    """Why an event is refused; null where it is valid."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return (
        F.when(blank("ctx"), "empty context")
        .when(blank("item_id"), "empty item")
        .when(F.col("type").isNull() | ~F.col("type").isin("ADD", "SET", "DEL"), "unknown type")
        .when((F.col("type") != "DEL") & (F.col("score").isNull() | ~F.col("score").between(0, 100)), "score out of range")
    )


def validate(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); a deletion's score becomes 0, rejected rows get ``reason``."""
    marked = events.withColumn("reason", reject_reason())
    valid = marked.where("reason is null").drop("reason")
    return valid.withColumn("score", F.when(F.col("type") == "DEL", 0).otherwise(F.col("score")).cast("int")), marked.where("reason is not null")


def scan_adds(window: int):
    """Rows sorted by key and arrival to the same rows with ``dup``.

    A repeat is one no later than the last accepted event's time plus the
    window; it doesn't move that time. Only the current key's time is kept. Keys
    that stand once are passed over; where a key's times ascend, a search jumps
    to the next event that is accepted.
    """

    def repeats(ts: np.ndarray, dup: np.ndarray, anchor: int) -> int:
        """Marks one key's rows after the accepted one; the last accepted time."""
        if (ts[1:] < ts[:-1]).any():
            for i, t in enumerate(ts.tolist()):
                if t <= anchor + window:
                    dup[i] = True
                else:
                    anchor = t
            return anchor
        at = 0
        while at < len(ts):
            to = at + int(np.searchsorted(ts[at:], anchor + window, "right"))
            dup[at:to] = True
            if to < len(ts):
                anchor = int(ts[to])
            at = to + 1
        return anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchor = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            ts, dup = b.column(3).to_numpy(), np.zeros(b.num_rows, bool)
            same = np.ones(b.num_rows, bool)
            for c in b.columns[:3]:
                same[1:] &= pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            same[0] = key == tuple(c[0].as_py() for c in b.columns[:3])
            if same[0]:
                to = int(np.argmin(same)) if not same.all() else b.num_rows
                anchor = repeats(ts[:to], dup[:to], anchor)
            edges = np.append(np.flatnonzero(~same), b.num_rows)
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if high - low > 1:
                    anchor = repeats(ts[low + 1 : high], dup[low + 1 : high], int(ts[low]))
                elif high == b.num_rows:
                    anchor = int(ts[low])
            key = tuple(c[-1].as_py() for c in b.columns[:3])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dup)], names=[*b.schema.names, "dup"])

    return run


def mark_adds(adds: DataFrame, window: int) -> DataFrame:
    """Additions with ``dup``; a time before the accepted one counts as a repeat."""
    key = ["ctx", "item_id", "score"]
    rows = adds.select(*EVENT_COLUMNS)
    if window <= 0:
        return rows.withColumn("dup", F.lit(False))
    ordered = rows.repartition(*key).sortWithinPartitions(*key, "seq")
    schema = "ctx string, item_id string, score int, ts long, type string, seq long, dup boolean"
    return ordered.mapInArrow(scan_adds(window), schema)


def mark_states(states: DataFrame) -> DataFrame:
    """Settings and deletions with ``dup``: the item's state is that already."""
    state = F.when(F.col("type") == "DEL", -1).otherwise(F.col("score"))
    before = F.lag(state).over(Window.partitionBy("ctx", "item_id").orderBy("seq"))
    return states.select(*EVENT_COLUMNS, F.coalesce(before == state, F.lit(False)).alias("dup"))


def mark_duplicates(events: DataFrame, config: EngineConfig) -> DataFrame:
    """Valid events with ``dup``. A cache size of 0 turns deduplication off."""
    if not config.dedup_cache_size:
        return events.select(*EVENT_COLUMNS, F.lit(False).alias("dup"))
    adds = mark_adds(events.where("type = 'ADD'"), config.dedup_window_sec)
    return adds.unionByName(mark_states(events.where("type <> 'ADD'")))


def accept(events: DataFrame, config: EngineConfig) -> DataFrame:
    """The events that are stored."""
    return mark_duplicates(validate(events)[0], config).where("not dup").drop("dup")


def arrival_rank(events: DataFrame, span: int = RANK_SPAN) -> DataFrame:
    """Adds ``rn``, an event's number in its context from 1.

    A context is ranked in stretches of the arrival order and the stretches'
    counts are added up, so a context with most of the rows is no single task.
    """
    # dealt once here: counts, ranks and every later use share this exchange
    cut = events.withColumn("__span", F.floor(F.col("seq") / span)).repartition("ctx", "__span")
    counts = cut.groupBy("ctx", "__span").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("ctx").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("ctx", "__span", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("ctx", "__span").orderBy("seq"))
    return cut.withColumn("rn", inside).join(counts, ["ctx", "__span"]).withColumn("rn", F.col("rn") + F.col("__before")).drop("__span", "__before")


def ring_buffer(accepted: DataFrame, size: int) -> DataFrame:
    """The last ``size`` events of each context."""
    ranked = arrival_rank(accepted)
    counts = accepted.groupBy("ctx").agg(F.count(F.lit(1)).alias("__n"))
    return ranked.join(counts, "ctx").where(F.col("rn") > F.col("__n") - size).drop("__n")


def live_contexts(accepted: DataFrame, max_contexts: int) -> DataFrame:
    """(ctx, last_seq) of the contexts that stay: those touched last."""
    last = accepted.groupBy("ctx").agg(F.max("seq").alias("last_seq"))
    return last.orderBy(F.desc("last_seq"), "ctx").limit(max_contexts) if max_contexts else last


def event_stats(events: DataFrame, config: EngineConfig) -> DataFrame:
    """total (repeats too), deduped, stored (in buffers), active contexts."""
    marked = mark_duplicates(validate(events)[0], config)
    per = marked.groupBy("ctx").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dup").cast("long")).alias("d"))
    kept = F.col("n") - F.col("d")
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("deduped_events"),
        F.coalesce(F.sum(F.least(kept, F.lit(config.ctx_buffer_size))), F.lit(0)).alias("stored_events"),
        F.sum((kept > 0).cast("long")).alias("active_contexts"),
    )

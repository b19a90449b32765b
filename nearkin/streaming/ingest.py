"""Events as a stream: the same acceptance and graph as in batch.

State is kept per context: the last events, the times of accepted additions and
the items' states. A batch's accepted events leave it with what their contexts
held before; their pairs' parts are summed and written under the batch's number, so a batch that is run again
replaces itself. There is no watermark: late events count as they arrive. A timed
job folds the parts into a stored graph and fades it, so a read never sums more
than the batches since.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from nearkin.config import EngineConfig
from nearkin.operators import cooccurrence
from nearkin.operators.events import EVENT_COLUMNS, validate
from nearkin.sources import scratch

EDGES = "item1 string, item2 string, score double"
#: Accepted events, numbered from 0 in their context's batch; those of the buffer
#: before it are numbered below 0 and have no type.
TAKEN = "ctx string, item_id string, score int, ts long, type string, seq long"


class ContextState:
    """One context's buffer and what acceptance remembers.

    ``added`` and ``held`` keep at most ``dedup_cache_size`` keys, the least
    recently used go first.
    """

    def __init__(self, config: EngineConfig, text: str | None = None):
        self.config = config
        kept = json.loads(text) if text else {"buffer": [], "added": {}, "held": {}}
        self.buffer: list[list] = kept["buffer"]
        self.added: dict[str, int] = kept["added"]
        self.held: dict[str, int] = kept["held"]

    def text(self) -> str:
        return json.dumps({"buffer": self.buffer, "added": self.added, "held": self.held})

    def remember(self, into: dict[str, int], key: str, value: int) -> None:
        into.pop(key, None)
        into[key] = value
        while len(into) > self.config.dedup_cache_size:
            into.pop(next(iter(into)))

    def repeated(self, item: str, score: int, ts: int, kind: str) -> bool:
        if not self.config.dedup_cache_size:
            return False
        if kind != "ADD":
            state = -1 if kind == "DEL" else score
            if self.held.get(item) == state:
                return True
            self.remember(self.held, item, state)
            return False
        if self.config.dedup_window_sec <= 0:
            return False
        key = f"{score}:{item}"
        if key in self.added and ts <= self.added[key] + self.config.dedup_window_sec:
            return True
        self.remember(self.added, key, ts)
        return False

    def keep(self, events: list[list]) -> None:
        """Put accepted events (item, score, time) into the buffer."""
        self.buffer = [*self.buffer, *events][-self.config.ctx_buffer_size :]

    def take(self, item: str, score: int, ts: int, kind: str) -> list[tuple]:
        """The pairs that an event makes; none if it is a repeat."""
        if self.repeated(item, score, ts, kind):
            return []
        met = [(*old, item, score, ts, kind) for old in self.buffer if old[0] != item]
        self.keep([[item, score, ts]])
        return met


def folding(config: EngineConfig) -> Callable:
    names = [p.split()[0] for p in TAKEN.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = ContextState(config, state.get[0] if state.exists else None)
        rows = [r for f in frames for r in zip(f["seq"].tolist(), f["item_id"].tolist(), f["score"].tolist(), f["ts"].tolist(), f["type"].tolist(), strict=True)]
        rows.sort(key=lambda r: r[0])
        new = [(item, int(score), int(ts), kind) for _, item, score, ts, kind in rows if not kept.repeated(item, int(score), int(ts), kind)]
        old = kept.buffer if new else []
        out = [(key[0], *r, None, i - len(old)) for i, r in enumerate(old)] + [(key[0], *r, i) for i, r in enumerate(new)]
        kept.keep([list(r[:3]) for r in new])
        state.update((kept.text(),))
        yield pd.DataFrame(out, columns=names)

    return run


def taken_stream(events: DataFrame, config: EngineConfig) -> DataFrame:
    """Streaming accepted events, numbered in each context, after what it held before."""
    valid, _ = validate(events.select(*EVENT_COLUMNS))
    return valid.groupBy("ctx").applyInPandasWithState(folding(config), TAKEN, "kept string", "append", GroupStateTimeout.NoTimeout)


def start(events: DataFrame, config: EngineConfig, deltas: str, checkpoint: str) -> StreamingQuery:
    """Follow a stream of events, adding edge parts below ``deltas``. Only events
    leave the state, not their pairs; these are met in the planner's join."""

    def write(batch: DataFrame, number: int) -> None:
        place = f"{deltas}/taken={number}"
        batch.write.mode("overwrite").parquet(place)  # it is read twice, and the state must move once
        taken = batch.sparkSession.read.schema(TAKEN).parquet(place)
        met = cooccurrence.pairs(taken, config.ctx_buffer_size, after=-1)
        cooccurrence.both_ways(cooccurrence.contributions(met, config)).write.mode("overwrite").parquet(f"{deltas}/batch={number}")
        scratch.remove(batch.sparkSession, place)

    return taken_stream(events, config).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_batches(spark: SparkSession, deltas: str) -> list[int]:
    """Numbers of the batches that can't be run again: all but the newest."""
    return sorted(int(n.removeprefix("batch=")) for n in scratch.folders(spark, deltas) if n.startswith("batch="))[:-1]


def generation(spark: SparkSession, deltas: str) -> tuple[int, int, int, int] | None:
    """(number, last batch in it, time of its last decay, decays so far) of the folded graph."""
    names = [n for n in scratch.folders(spark, f"{deltas}/graph") if n.startswith("sealed=")]
    if not names:
        return None
    number, batches, faded, cycles = map(int, names[-1].removeprefix("sealed=").split("-"))
    return number, batches - 1, faded, cycles


def seal(deltas: str, number: int, last: int, faded: int, cycles: int) -> str:
    return f"{deltas}/graph/sealed={number:08d}-{last + 1}-{faded}-{cycles}"


def fold(spark: SparkSession, deltas: str, config: EngineConfig, now: int) -> DataFrame:
    """Fold closed batches into the stored graph, fade it by the decay intervals
    that have passed, and hold its limits. To be run on a timer.

    A generation counts once its seal, which names what it holds, is there; only
    then are the batches in it and the generation before it deleted, so a run that
    breaks off is simply run again.
    """
    before = generation(spark, deltas)
    number, last, faded, cycles = before or (0, -1, now, 0)
    graph = spark.read.schema(EDGES).parquet(f"{deltas}/graph/edges={number:08d}") if before else spark.createDataFrame([], EDGES)
    batches = [b for b in closed_batches(spark, deltas) if b > last]
    if batches:
        parts = spark.read.schema(EDGES).parquet(*(f"{deltas}/batch={b}" for b in batches))
        graph = cooccurrence.limited(cooccurrence.merge_edges(graph, parts), config)
    due = max(0, now - faded) // config.decay_interval_sec
    graph = cooccurrence.maintain(graph, config, due, cycles)
    scratch.remove(spark, f"{deltas}/graph/edges={number + 1:08d}")  # of a run that broke off
    held = scratch.written(graph, f"{deltas}/graph/edges={number + 1:08d}", "item1")
    target, files = scratch.place(spark, seal(deltas, number + 1, max(batches, default=last), faded + due * config.decay_interval_sec, cycles + due))
    files.mkdirs(target)
    for b in batches:
        scratch.remove(spark, f"{deltas}/batch={b}")
    if before:
        scratch.remove(spark, f"{deltas}/graph/edges={number:08d}")
        scratch.remove(spark, seal(deltas, *before))
    return held


def edges(spark: SparkSession, deltas: str) -> DataFrame:
    """The graph so far: what is folded, and the batches since summed."""
    before = generation(spark, deltas)
    last = before[1] if before else -1
    paths = [f"{deltas}/{n}" for n in scratch.folders(spark, deltas) if n.startswith("batch=") and int(n.removeprefix("batch=")) > last]
    parts = spark.read.schema(EDGES).parquet(*paths) if paths else spark.createDataFrame([], EDGES)
    if before:
        parts = parts.unionByName(spark.read.schema(EDGES).parquet(f"{deltas}/graph/edges={before[0]:08d}"))
    return parts.groupBy("item1", "item2").agg(F.sum("score").alias("score"))

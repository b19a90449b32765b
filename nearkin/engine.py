"""The engine: its stores as DataFrames, and its requests as methods.

Stores are immutable tables below one folder that driver and executors share; a
change gives a new one and a new generation, so a result that is kept never
outlives what it came from. Single changes are gathered on the driver, written to
the change log, and take effect together when they are asked for; loads of any
size come in as DataFrames.

The graph is never built anew: events that come in add their own pairs to the
stored edges, so what decay, pruning, set scores and loaded snapshots made of
these stays. Limits on neighbours, support and contexts hold after each flush.
"""

from __future__ import annotations

import json
import math
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.config import EngineConfig, EngineError
from nearkin.functions.meta import META_TYPE
from nearkin.functions.vector import norm
from nearkin.operators import ann, cooccurrence, events, filters, search, vectors
from nearkin.plans import command
from nearkin.plans.cache import ResultCache, cache_key
from nearkin.sources import changelog, scratch, snapshot

EVENTS = "ctx string, item_id string, score int, ts long, type string, seq long"
VECTORS = "id string, vec array<float>, norm double"
EDGES = "item1 string, item2 string, score double"
#: Single changes gathered before they are folded into the stores.
PENDING = 10_000


class Engine:
    """Stores' tables go with the session. The change log stays where a ``folder``
    for it is given; from there ``recover`` brings the stores back."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, folder: str | None = None):
        self.spark = spark
        self.config = (config or EngineConfig()).validate()
        self.home = scratch.shared(spark, "engine")
        self.folder = folder or self.home
        self.events = spark.createDataFrame([], EVENTS)
        self.edges = spark.createDataFrame([], EDGES)
        self.vectors = spark.createDataFrame([], VECTORS)
        self.metadata = spark.createDataFrame([], f"id string, meta {META_TYPE}")
        self.pending: dict[str, list[tuple]] = {"events": [], "vectors": [], "metadata": []}
        self.log: list[dict] = []
        self.tables = 0
        self.segment = 0
        self.generation = 0
        self.seq = 0
        self.cycles = 0
        self.snapshots: list[tuple[str, int]] = []
        self.debug = False
        self.last_search: dict[str, str] = {}
        self.cells: ann.CellIndex | None = None
        self.cache = ResultCache(self.config.cache_max_entries, self.config.cache_ttl_seconds, self.config.cache_min_query_cost_ms)
        self.cache.enabled = self.config.cache_enabled

    def store(self, df: DataFrame, name: str, sort_by: str | None = None) -> DataFrame:
        """A store's next state, written."""
        self.tables += 1
        return scratch.written(df, f"{self.home}/{name}-{self.tables:08d}", sort_by)

    # -- loads ---------------------------------------------------------------

    def load_events(self, rows: DataFrame) -> Engine:
        """All events of the engine, from any table of events."""
        self.events = self.live(self.store(events.accept(rows, self.config), "events"))
        self.edges = self.store(cooccurrence.limited(cooccurrence.build_edges(self.events, self.config), self.config), "edges", "item1")
        self.seq = max(self.seq, rows.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0])
        return self.changed()

    def load_vectors(self, rows: DataFrame, metadata: DataFrame | None = None) -> Engine:
        """Vectors (id, vec) and metadata (id, meta) of the engine. Rows that are
        no valid vectors are left out; different widths are an error."""
        good = rows.where(vectors.valid_vector()).select("id", "vec", F.lit(0).cast("long").alias("seq"))
        vectors.check_dimension(good)
        self.vectors = self.store(good.select("id", "vec", norm(F.col("vec")).alias("norm")), "vectors")
        if metadata is not None:
            self.metadata = metadata
        self.cells = None
        return self.changed()

    def live(self, accepted: DataFrame) -> DataFrame:
        """Events of the contexts that stay where their number is limited."""
        if not self.config.max_contexts:
            return accepted
        return accepted.join(F.broadcast(events.live_contexts(accepted, self.config.max_contexts)).select("ctx"), "ctx", "left_semi")

    def changed(self) -> Engine:
        self.generation += 1
        self.cache.clear()
        return self

    # -- single changes ------------------------------------------------------

    def gather(self, store: str, row: tuple, **logged) -> None:
        self.pending[store].append(row)
        if logged:
            self.log.append({"seq": self.seq, "ts_us": int(time.time() * 1e6), **logged})
        if sum(map(len, self.pending.values())) >= PENDING:
            self.flush()

    def event(self, ctx: str, kind: str, item: str, score: int = 0, ts: int | None = None) -> None:
        if not ctx or not item or kind not in ("ADD", "SET", "DEL") or not (kind == "DEL" or 0 <= score <= 100):
            raise EngineError("an event needs a context, an item, a type, and a score from 0 to 100")
        self.seq += 1
        score, ts = 0 if kind == "DEL" else score, ts or int(time.time())
        self.gather("events", (ctx, item, score, ts, kind, self.seq), op="EVENT", ctx=ctx, item_id=item, score=score, ts=ts, type=kind)

    def set_vector(self, item: str, vec: list[float]) -> None:
        vec = [float(x) for x in vec]
        if not item or not 0 < len(vec) <= vectors.MAX_DIMENSION or not all(map(math.isfinite, vec)):
            raise EngineError("a vector needs an id and 1 to 4096 finite components")
        self.seq += 1
        self.gather("vectors", (item, vec, self.seq), op="VECSET", id=item, vec=vec)

    def delete_vector(self, item: str) -> None:
        self.flush()
        search.fetch_vector(self.vectors, item)
        self.seq += 1
        self.gather("vectors", (item, None, self.seq), op="VECDEL", id=item)
        self.gather("metadata", (item, None, self.seq))

    def set_metadata(self, item: str, pairs: dict[str, filters.Value]) -> None:
        self.flush()
        search.fetch_vector(self.vectors, item)
        kinds = {bool: ("b", 3), int: ("i", 1), float: ("d", 2), str: ("s", 0)}
        held = {}
        for k, v in pairs.items():
            kind, place = kinds[type(v)]
            held[k] = (kind, *(v if i == place else None for i in range(4)))
        self.seq += 1
        self.gather("metadata", (item, held, self.seq), op="METASET", id=item, meta=held)

    def flush(self) -> Engine:
        """Write the gathered changes to the log, then fold them into the stores."""
        p, self.pending = self.pending, {k: [] for k in self.pending}
        if not any(p.values()):
            return self
        more = self.spark.createDataFrame(p["vectors"], "id string, vec array<float>, seq long")
        if p["vectors"]:  # a width that doesn't fit is refused before it is logged
            some = self.vectors.select("id", "vec").limit(1).withColumn("seq", F.lit(0).cast("long"))
            try:
                vectors.check_dimension(some.unionByName(more))
            except EngineError:
                self.log = []
                raise
        self.write_log()
        if p["events"]:
            self.add_events(self.spark.createDataFrame(p["events"], EVENTS))
        zero = F.lit(0).cast("long").alias("seq")
        if p["vectors"]:
            self.vectors = self.store(vectors.vector_store(self.vectors.select("id", "vec", zero).unionByName(more)), "vectors")
            if self.cells is not None:
                self.cells = self.cells.changed(more, self.config, self.next_cells)
        if p["metadata"]:
            more = self.spark.createDataFrame(p["metadata"], f"id string, meta {META_TYPE}, seq long")
            kept = vectors.latest(self.metadata.select("id", "meta", zero).unionByName(more)).where("meta is not null").select("id", "meta")
            self.metadata = self.store(kept, "metadata")
        return self.changed()

    def add_events(self, more: DataFrame) -> None:
        """Accept events and add their pairs, and only theirs, to the graph."""
        before = self.events.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        near = self.events.join(more.select("ctx").distinct(), "ctx", "left_semi")
        taken = events.accept(near.unionByName(more), self.config).where(F.col("seq") > before)
        taken = self.store(taken, "accepted")
        added = cooccurrence.added_edges(self.events, taken, before, self.config)
        self.edges = self.store(cooccurrence.limited(cooccurrence.merge_edges(self.edges, added), self.config), "edges", "item1")
        self.events = self.store(self.live(self.events.unionByName(taken)), "events")

    def write_log(self) -> None:
        if self.log:
            self.segment += 1
            rows, self.log = self.spark.createDataFrame(self.log, changelog.FIELDS), []
            changelog.append(rows, f"{self.folder}/log", self.segment)

    def maintain(self, cycles: int = 1) -> Engine:
        """``cycles`` decay intervals; every tenth of the engine's prunes as well."""
        self.flush()
        for _ in range(cycles):
            self.seq += 1
            self.log.append({"seq": self.seq, "ts_us": int(time.time() * 1e6), "op": "MAINTAIN"})
        self.write_log()
        self.edges = self.store(cooccurrence.maintain(self.edges, self.config, cycles, self.cycles), "edges", "item1")
        self.cycles += cycles
        return self.changed()

    def set_scores(self, scores: DataFrame) -> Engine:
        """Overwrite edges (item1, item2, score) in both directions."""
        self.flush()
        self.edges = self.store(cooccurrence.set_scores(self.edges, scores), "edges", "item1")
        return self.changed()

    def recover(self, path: str | None = None) -> Engine:
        """The stores of a snapshot, if there is one, and of the log after it.

        Limits, which held after every flush before, hold for the whole again.
        """
        base = {}
        if path is not None:
            base, self.seq = snapshot.load(self.spark, path)
        held = changelog.segments(self.spark, f"{self.folder}/log")
        if held:
            log = changelog.read(self.spark, f"{self.folder}/log", self.seq)
            self.seq = max(self.seq, changelog.check(log))
            self.segment = max(int(n.removeprefix("segment=")) for n in held)
            base = changelog.replay(log, self.config, base, f"{self.home}/replay-{self.segment:08d}", accepted=False)
        if base:
            self.events = self.live(self.store(base["events"], "events"))
            self.edges = self.store(cooccurrence.limited(base["edges"], self.config), "edges", "item1")
            self.vectors, self.metadata = self.store(base["vectors"], "vectors"), self.store(base["metadata"], "metadata")
        self.cells = None
        return self.changed()

    # -- searches ------------------------------------------------------------

    def sim(self, item: str, k: int | None = None, using: str = "fusion", filter: str = "", min_score: float | None = 0.0, adaptive: bool | None = None) -> DataFrame:
        """(item_id, score) of the items most similar to one."""
        self.flush()
        k = search.check_top_k(self.config.default_top_k if k is None else k, self.config)
        run = {
            "events": lambda: search.by_events(self.edges, item, k, self.config, self.metadata, filter),
            "vectors": lambda: self.vector_search(search.fetch_vector(self.vectors, item), k, filter, item),
            "fusion": lambda: search.by_fusion(self.edges, self.vectors, item, k, self.config, self.metadata, filter, adaptive),
        }
        if using not in run:
            raise EngineError(f"using must be one of {', '.join(run)}")
        return search.min_score(run[using](), min_score)

    def simv(self, vector: list[float], k: int | None = None, filter: str = "", min_score: float | None = 0.0) -> DataFrame:
        self.flush()
        k = search.check_top_k(self.config.default_top_k if k is None else k, self.config)
        return search.min_score(self.vector_search(vector, k, filter, None), min_score)

    def vector_search(self, query: list[float], k: int, filter_text: str, without: str | None) -> DataFrame:
        index = self.index() if self.config.index_type == "ivf" else None
        if index is not None:
            return index.search(query, k, self.config, self.metadata, filter_text, without=without)
        return search.by_vector(self.vectors, query, k, self.config, self.metadata, filter_text, without=without)

    def next_cells(self) -> str:
        self.tables += 1
        return f"{self.home}/cells-{self.tables:08d}"

    def index(self) -> ann.CellIndex | None:
        """The cells, trained and written at the first search of enough vectors;
        none while there are fewer, which an exact search serves."""
        if self.cells is None and self.vectors.count() >= self.config.ivf_train_threshold:
            self.cells = ann.CellIndex.build(self.vectors, self.config, self.next_cells)
        return self.cells

    def answer(self, item: str, k: int, **options) -> list[tuple[str, float]]:
        """``sim`` collected, from the cache where it has it."""
        self.flush()
        least = options.pop("min_score", 0.0)
        key = cache_key(self.generation, item, k, sorted(options.items()))
        rows = self.cache.get(key)
        if rows is None:
            began = time.perf_counter()
            rows = [tuple(r) for r in self.sim(item, k, min_score=None, **options).collect()]
            kind = "filtered" if options.get("filter") else "item"
            self.cache.put(key, rows, (time.perf_counter() - began) * 1000, kind, frozenset([item, *(r[0] for r in rows)]))
        return [r for r in rows if least is None or r[1] >= least]

    # -- snapshots and introspection -----------------------------------------

    def save(self, path: str) -> None:
        """Write a snapshot; log segments that it holds are deleted."""
        self.flush()
        held = {"events": self.events, "edges": self.edges, "vectors": self.vectors, "metadata": self.metadata.where(F.size("meta") > 0)}
        snapshot.save(held, path, int(time.time()), self.seq)
        self.snapshots.append((path, self.seq))
        changelog.truncate(self.spark, f"{self.folder}/log", self.seq)

    def save_automatic(self, folder: str) -> str:
        """A snapshot named by its time; only the newest few of these stay."""
        path = f"{folder}/auto_{int(time.time() * 1000):016d}"
        self.save(path)
        snapshot.prune(self.spark, folder, self.config.snapshot_retain)
        return path

    def load(self, path: str) -> Engine:
        """Go back to a snapshot: what was logged before no longer counts."""
        stores, seq = snapshot.load(self.spark, path)
        self.events, self.edges, self.vectors, self.metadata = (stores[n] for n in ("events", "edges", "vectors", "metadata"))
        self.seq = max(self.seq, seq)
        self.pending, self.log, self.cells = {k: [] for k in self.pending}, [], None
        scratch.remove(self.spark, f"{self.folder}/log")
        return self.changed()

    def info(self) -> DataFrame:
        """One row of counts."""
        self.flush()
        return info(self.events, self.edges, self.vectors, self.metadata, self.config)

    def execute(self, line: str) -> DataFrame:
        """A command in text form, to its result as a table."""
        c = command.parse(line)
        a = c.args
        if c.name == "SIM":
            return self.observed(a.get("using", "fusion"), lambda: search.rounded(self.sim(a.pop("id"), a.pop("k"), **a)))
        if c.name == "SIMV":
            return self.observed("vectors", lambda: search.rounded(self.simv(a.pop("vector"), a.pop("k"), **a)))
        if c.name == "EVENT":
            self.event(a["ctx"], a["type"], a["item_id"], a["score"], a["ts"])
        elif c.name == "VECSET":
            self.set_vector(a["id"], a["vector"])
        elif c.name == "VECDEL":
            self.delete_vector(a["id"])
        elif c.name == "METASET":
            self.set_metadata(a["id"], filters.parse_metadata(a["pairs"]))
        elif c.name == "INFO":
            return self.info()
        elif c.name == "SET":
            self.config = self.config.with_variable(a["name"], a["value"])
            self.cache.enabled, self.cache.ttl, self.cache.least_ms = self.config.cache_enabled, self.config.cache_ttl_seconds, self.config.cache_min_query_cost_ms
        elif c.name in ("GET", "SHOW VARIABLES"):
            shown = self.config.variables(a.get("prefix", a.get("name", "")))
            if c.name == "GET":
                shown = {k: v for k, v in shown.items() if k == a["name"]}
            return self.table(shown)
        elif c.name in ("DUMP SAVE", "DUMP LOAD", "DUMP VERIFY", "DUMP INFO"):
            path = command.exactly(c.name, a["rest"], "path")["path"]
            if c.name == "DUMP VERIFY":
                return snapshot.verify(self.spark, path)
            if c.name == "DUMP INFO":
                return snapshot.info(self.spark, path)
            self.save(path) if c.name == "DUMP SAVE" else self.load(path)
        elif c.name in ("CACHE CLEAR", "CACHE ENABLE", "CACHE DISABLE", "CACHE STATS"):
            if c.name == "CACHE STATS":
                return self.table({k: str(v) for k, v in self.cache.stats().items()})
            if c.name == "CACHE CLEAR":
                self.cache.clear()
            else:
                self.cache.enabled = c.name == "CACHE ENABLE"
        elif c.name == "DUMP STATUS":
            return self.table({path: str(seq) for path, seq in self.snapshots})
        elif c.name in ("DEBUG ON", "DEBUG OFF"):
            self.debug = c.name == "DEBUG ON"
        elif c.name == "DEBUG SHOW":
            return self.table(self.last_search)
        elif c.name == "CONFIG SHOW":
            return self.table(self.config.variables())
        elif c.name == "CONFIG HELP":
            return self.table(EngineConfig.help())
        elif c.name == "CONFIG VERIFY":
            self.config.validate()
        else:
            raise EngineError(f"unknown command: {c.name}")
        return self.table({"status": "OK"})

    def observed(self, mode: str, run) -> DataFrame:
        """A search's result; while debugging, what it took as well (``DEBUG SHOW``)."""
        if not self.debug:
            return run()
        began = time.perf_counter()
        found = run()
        rows = found.collect()
        candidates = self.edges.select("item1").distinct().count() if mode == "events" else self.vectors.count()
        self.last_search = {"mode": mode, "query_time_us": str(int((time.perf_counter() - began) * 1e6)), "candidates": str(candidates), "results": str(len(rows))}
        return self.spark.createDataFrame(rows, found.schema)

    def request(self, route: str, body: str) -> DataFrame:
        """A change or search whose arguments are a JSON object."""
        try:
            a = json.loads(body)
        except ValueError:
            raise EngineError("a body must be JSON") from None
        if not isinstance(a, dict):
            raise EngineError("a body must be an object")
        try:
            if route == "event":
                score = a.get("score", 0)
                if type(score) is not int:
                    raise EngineError("a score must be an integer")
                self.event(a["ctx"], str(a["type"]).upper(), a["id"], score, a.get("timestamp"))
            elif route == "vecset":
                self.set_vector(a["id"], a["vector"])
                if a.get("metadata"):
                    self.set_metadata(a["id"], a["metadata"])
            elif route == "vecdel":
                self.delete_vector(a["id"])
            elif route == "metaset":
                self.set_metadata(a["id"], a["metadata"])
            elif route == "sim":
                return search.rounded(self.sim(a["id"], a.get("top_k"), a.get("mode", "fusion"), a.get("filter", ""), a.get("min_score", 0.0), a.get("adaptive")))
            elif route == "simv":
                return search.rounded(self.simv(a["vector"], a.get("top_k"), a.get("filter", ""), a.get("min_score", 0.0)))
            elif route == "info":
                return self.info()
            else:
                raise EngineError(f"unknown route: {route}")
        except (KeyError, TypeError) as wrong:
            raise EngineError(f"a missing or wrong field: {wrong}") from None
        return self.table({"status": "OK"})

    def table(self, pairs: dict[str, str]) -> DataFrame:
        return self.spark.createDataFrame(list(pairs.items()), "name string, value string")


def info(accepted: DataFrame, edges: DataFrame, vecs: DataFrame, metadata: DataFrame, config: EngineConfig) -> DataFrame:
    """One row: contexts, stored events, vectors, items with metadata, edges."""
    per = accepted.groupBy("ctx").agg(F.count(F.lit(1)).alias("n"))
    counts = per.agg(F.count(F.lit(1)).alias("ctx_count"), F.coalesce(F.sum(F.least("n", F.lit(config.ctx_buffer_size))), F.lit(0)).alias("event_count"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    for part in (one(vecs, "vector_count"), one(metadata, "metadata_count"), cooccurrence.graph_stats(edges).select(F.col("tracked_items").alias("id_count"), F.col("pairs").alias("pair_count"))):
        counts = counts.crossJoin(part)  # one row each
    return counts

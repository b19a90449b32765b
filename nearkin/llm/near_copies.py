"""Near copies: texts whose sets of five-word shingles are at least 0.8 alike.

SimHash links most copies cheaply but misses many pairs of short texts, so here
its links only come first and are checked; an exact set-similarity join finds
the rest:

* prefix: a set's shingles stand in one global order, the common ones (by a
  sample, which only steers the order) last. Two sets that are alike share at
  least m of their first shingles, all but ceil(threshold * size) - m of each,
  with m about a twentieth of the size, so chance phrases make no pairs;
* size: a pair whose sizes can't give the overlap is left out;
* place: the sizes of a pair say how far into each set the shared ones have to begin,
  and how many there are up to which place;
* crowds: by a shingle of many rows, two meet only if nothing rarer needs to be shared,
  so the rows of a large group that are further than the limit from its middle, whose
  first shingles are their own, don't meet by what all of the group have;

and what is left is verified on whole sets. Components are all that is asked
for, so every shared shingle's rows are first compared with one of them (the one with
the fewest rarer shingles), in rounds with another one each; only rows that are
still in different components then meet in pairs.

Rows are told apart by a 64-bit hash of the text, shingles by one of theirs.
Texts without words are like each other and like nothing else. The links of
fingerprints are a tree, so a link that fails the check says nothing about the
others in its component; those are left to the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearkin.llm import simhash
from nearkin.llm.chunks import slices
from nearkin.llm.shared import BROADCAST_ROWS, Workspace, text_key, text_of

SHINGLE = 5
ALIKE = 0.8
#: Texts that common shingles are looked for in, about: so many, or this share of larger
#: tables (what stays unknown then has no more rows than in small ones); and in how many
#: of them they stand.
SAMPLE_ROWS = 1 << 14
SAMPLE_SHARE = 0.25
COMMON = 4
#: Links up to which the driver finds their components (4 MB).
DRIVER_LINKS = 1 << 18
#: Rows of a shingle beyond which it is crowded.
CROWD = 64
#: Rounds of comparing with one row of each shared shingle.
ROUNDS = 1
#: Size of a set for each further shared shingle that is asked for.
PER_SHARED = 20
#: Pairs of one row that a task verifies, about.
PAIR_ROWS = 1000


def shingle_set(text: str, shingle: int = SHINGLE, seed: int = simhash.SEED) -> np.ndarray:
    return np.unique(simhash.shingle_hashes(text, shingle, seed))


def sets(shingle: int, seed: int):
    """(node, text) to (node, whole set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                held = [shingle_set(t.as_py(), shingle, seed).view(np.int64) for t in texts]
                edges = np.cumsum([0, *map(len, held)])
                flat = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(held)))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["node", "held"])

    return run


def prefixes(common, shingle: int, seed: int, alike: float):
    """(node, text) to (node, fp, n, keys): fingerprint, size and first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = common.value
        for batch in batches:
            for part, texts in slices(batch):
                prints, sizes, keys = [], [], []
                for t in texts:
                    hashes = simhash.shingle_hashes(t.as_py(), shingle, seed)
                    prints.append(simhash.print_of(hashes))
                    held = np.unique(hashes)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, held), len(known) - 1)
                        held = held[np.argsort(np.where(known[at] == held, number[at], 0), kind="stable")]
                    sizes.append(len(held))
                    keys.append(held[: len(held) - math.ceil(alike * len(held) - 1e-9) + 1 + len(held) // PER_SHARED].view(np.int64))
                edges = np.cumsum([0, *map(len, keys)])
                flat = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), flat], names=["node", "fp", "n", "keys"])

    return run


def counting(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch):
                held = np.concatenate([shingle_set(t.as_py(), shingle, seed) for t in texts])
                yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64))], names=["key"])

    return run


def are_alike(x: Column, y: Column, alike: float) -> Column:
    """Whether two whole sets are; without members only like each other."""
    both, total = F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)
    return (total == 0) | (both > 0) & (both >= F.ceil(F.lit(alike / (1 + alike)) * total - F.lit(1e-9)))


def candidates(placed: DataFrame, alike: float, work: Workspace | None = None) -> DataFrame:
    """(a, b) of different roots that share enough first shingles, a not the larger set.

    The pair's sizes give the overlap asked for. In the global order, j of what two
    sets share lie in the prefixes behind which that overlap less j is left of each;
    this is asked for j = 1, for m of the smaller set, and for one between. By a
    crowded shingle rows meet for j = 1 only, so what both may have of such ones counts
    as shared for the other two; and those of its commonest root don't meet at all.
    """
    work = work or Workspace(placed.sparkSession, "candidates")
    if "crowd" not in placed.columns:
        placed = placed.withColumn("crowd", crowded())
    dense = placed.where("crowd").groupBy("key", "root").count()
    main = work.table(dense.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main")), "main")
    hidden = work.table(placed.where("crowd").groupBy("node").agg(F.count(F.lit(1)).alias("hidden")), "hidden")
    for named, by in ((main, "key"), (hidden, "node")):
        placed = placed.join(F.broadcast(named) if named.count() <= BROADCAST_ROWS else named, by, "left")
    placed = placed.withColumns({"main": F.coalesce(F.col("main") == F.col("root"), F.lit(False)), "hidden": F.coalesce("hidden", F.lit(0))})

    share = 2 * alike / (1 + alike)
    least = lambda part, n: F.ceil(F.lit(part) * n - F.lit(1e-9))
    asked = lambda n: F.when(F.col("crowd"), 1).otherwise(1 + F.floor(F.col(n) / PER_SHARED))
    more = 1 + F.floor(F.col("n_1") / PER_SHARED)
    # as a's partners aren't smaller, a shorter prefix of it is looked at
    few = placed.where(F.col("pos") < F.col("n") - least(share, F.col("n")) + asked("n"))
    sides = F.when(F.col("crowd") & ~F.col("main"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    few = few.select("key", *(F.col(c).alias(f"{c}_1") for c in ("node", "n", "root", "pos", "hidden")), F.explode(sides).alias("main"))
    placed = placed.where(F.col("pos") < F.col("n") - least(alike, F.col("n")) + asked("n"))
    smaller = (F.col("n_1") < F.col("n")) | (F.col("n_1") == F.col("n")) & (F.col("node_1") < F.col("node"))
    sized = smaller & (F.col("n_1") >= F.lit(alike) * F.col("n") - F.lit(1e-9))
    # the least j whose prefixes hold the shingle
    level = F.greatest(F.col("pos_1") - F.col("n_1"), F.col("pos") - F.col("n")) + least(share / 2, F.col("n") + F.col("n_1")) + 1
    met = placed.join(few, ["key", "main"]).where(sized & (F.col("root") != F.col("root_1")) & (level <= asked("n_1")))
    met = met.select(F.col("node_1").alias("a"), F.col("node").alias("b"), "crowd", level.alias("level"), more.alias("more"), F.least("hidden", "hidden_1").alias("hidden"))
    within = lambda j: F.sum((~F.col("crowd") & (F.col("level") <= j)).cast("int")) + F.col("hidden")
    half = F.ceil(F.col("more") / 2)
    met = met.groupBy("a", "b", "more", "hidden").agg(F.min("level").alias("first"), within(half).alias("some"), within(F.col("more")).alias("all"))
    return met.where((F.col("first") <= 1) & (F.col("some") >= half) & (F.col("all") >= F.col("more")))


def crowded() -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy("key")) > CROWD


def verified(pairs: DataFrame, held: DataFrame, alike: float) -> DataFrame:
    """The pairs (a, b), a written table, that are alike. A row with many pairs is dealt
    to many tasks: its set is repeated for them."""
    many = pairs.groupBy("a").count().where(F.col("count") > PAIR_ROWS).select("a", F.ceil(F.col("count") / PAIR_ROWS).cast("int").alias("chunks"))
    left = needed(held, pairs, "a", "x").join(F.broadcast(many), "a", "left")
    left = left.select("a", "x", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"))
    dealt = pairs.join(F.broadcast(many), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("chunks", F.lit(1))).cast("int").alias("chunk"))
    met = dealt.join(needed(held, pairs, "b", "y"), "b").join(left, ["a", "chunk"])
    return met.where(are_alike(F.col("x"), F.col("y"), alike)).select("a", "b")


def needed(held: DataFrame, pairs: DataFrame, side: str, name: str) -> DataFrame:
    """The sets of one side of the pairs; only these are moved."""
    nodes = pairs.select(side).distinct()
    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes
    return held.select(F.col("node").alias(side), F.col("held").alias(name)).join(nodes, side, "left_semi")


def joined(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """node, root as ``simhash.components`` gives them for a written table; few links take no rounds."""
    if edges.count() > DRIVER_LINKS:
        return simhash.components(edges, Workspace(edges.sparkSession, f"near-copies-{name}"))
    held = edges.select("a", "b").toArrow()
    nodes, at = np.unique(np.concatenate([held["a"].to_numpy(), held["b"].to_numpy()]), return_inverse=True)
    parent = np.arange(len(nodes))
    simhash.join_links(parent, at[: held.num_rows], at[held.num_rows :])
    below = np.flatnonzero(parent != np.arange(len(nodes)))
    found = pa.table({"node": nodes[below], "root": nodes[parent[below]]})
    return work.table(edges.sparkSession.createDataFrame(found), f"roots-{name}")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, alike: float = ALIKE, seed: int = simhash.SEED, work: Workspace | None = None) -> DataFrame:
    """doc_id, text_key, component_id (its smallest id) for every row."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "near-copies")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_key(docs, text_col).alias("node"), text_of(docs, text_col).alias("text"))
    texts = rows.select("node", "text")
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_ROWS / max(1, rows.count())))
    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    common = some.mapInArrow(counting(shingle, seed), "key long").groupBy("key").count().where(F.col("count") >= COMMON).toPandas()
    known = common["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    common = spark.sparkContext.broadcast((known[order], common["count"].to_numpy(np.int64)[order]))

    first = work.table(texts.mapInArrow(prefixes(common, shingle, seed, alike), "node long, fp long, n int, keys array<long>"), "prefixes")
    common.unpersist()
    whole = Window.partitionBy("key")
    entries = first.select("node", "n", F.posexplode("keys").alias("pos", "key")).withColumns({"low": F.min("node").over(whole), "high": F.max("node").over(whole)})
    shared = work.table(entries.where("low <> high").select("key", "node", "n", "pos").distinct(), "sharing")
    # as the sizes of a pair are alike, the smaller set's m is at least this
    fewest = 1 + F.floor(F.ceil(F.col("n") * F.lit(alike) - F.lit(1e-9)) / PER_SHARED)
    enough = shared.groupBy("node", "n").count().where(F.col("count") >= fewest).select("node")
    enough = work.table(enough, "enough")
    shared = work.table(shared.join(F.broadcast(enough) if enough.count() <= BROADCAST_ROWS else enough, "node", "left_semi"), "shared")
    work.drop("sharing")

    # SimHash's links: of rows to the smallest with their fingerprint, and of these to their root's
    prints = work.table(first.groupBy("fp").agg(F.min("node").alias("a")), "prints")
    links = work.table(simhash.links(prints.select("fp"), prints.count(), simhash.RADIUS, work), "links")
    roots = joined(links, work, "prints")
    same = first.select(F.col("node").alias("b"), "fp").join(prints, "fp").where("a <> b").select("a", "b").distinct()
    tops = prints.select(F.col("fp").alias("root"), "a")
    pairs = roots.withColumnRenamed("node", "fp").join(prints.withColumnRenamed("a", "b"), "fp").join(tops, "root").select("a", "b")
    pairs = work.table(same.union(pairs), "pairs-prints")

    # whole sets of the rows that can be in a pair
    wanted = shared.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = work.table(wanted, "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    held = texts.join(wanted, "node", "left_semi").mapInArrow(sets(shingle, seed), "node long, held array<long>")
    if first.select("node").distinct().count() < first.count():
        held = held.dropDuplicates(["node"])
    held = work.table(held, "sets")
    work.drop("prefixes")

    edges = work.table(verified(pairs, held, alike), "edges-prints")
    for turn in range(ROUNDS + 1):
        placed = shared.withColumn("root", F.col("node"))
        if turn:
            found = joined(edges, work, f"{turn}")
            placed = shared.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
            placed = placed.withColumns({"low": F.min("root").over(whole), "high": F.max("root").over(whole), "crowd": crowded()}).where("low <> high").drop("low", "high")
            placed = work.table(placed, f"placed-{turn}")
        if turn < ROUNDS:
            # first the row that has least of its own before the shingle: of a group, its middle
            one = whole.orderBy(*(["pos"] if turn == 0 else []), F.xxhash64("node", F.lit(turn)))
            pairs = placed.withColumns({f"{c}_1": F.first(c).over(one) for c in ("node", "n", "root")})
            sized = F.least("n", "n_1") >= F.lit(alike) * F.greatest("n", "n_1") - F.lit(1e-9)
            pairs = pairs.where("root <> root_1").where(sized).groupBy(F.col("node_1").alias("a"), F.col("node").alias("b"), F.least("n", "n_1").alias("n")).count()
            pairs = pairs.where(F.col("count") >= 1 + F.floor(F.col("n") / PER_SHARED))
        else:
            pairs = candidates(placed, alike, work)
        pairs = work.table(pairs.select("a", "b"), f"pairs-{turn}")
        edges = work.table(edges.union(verified(pairs, held, alike)), f"edges-{turn}")
    found = work.table(joined(edges, work, "last"), "components")

    # named apart, so that the rows without copies are left as they are
    found = found.union(found.select(F.col("root").alias("node"), "root").distinct())
    ids = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).join(found, "node", "left").where("root is not null or copies > 1")
    ids = work.table(ids.select("node", F.coalesce("root", "node").alias("root"), "least"), "linked")
    least = work.table(ids.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    least = F.broadcast(least) if least.count() <= BROADCAST_ROWS else least
    named = work.table(ids.join(least, "root").select("node", "component_id", F.lit(True).alias("linked")), "named")
    named = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    out = rows.select("doc_id", "node").join(named, "node", "left")
    return out.select("doc_id", F.col("node").alias("text_key"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))

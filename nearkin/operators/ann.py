"""Approximate search by cells, scalar quantisation, and tiered stores.

A graph index has no form as a plan over partitions; where one is asked for,
exact search answers instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.config import EngineConfig, EngineError
from nearkin.functions import vector as V
from nearkin.operators import blocks, search
from nearkin.operators.vectors import latest
from nearkin.sources import scratch

# Limits of training.
MAX_LISTS = 1024
ITERATIONS = 10
LEAST_MOVE = 1e-3
#: Rows that training looks at, at most.
SAMPLE_ROWS = 10_000
#: Rows of it that the number of probed cells is measured on.
TUNING_QUERIES = 256


def list_count(n: int, asked: int = 0) -> int:
    """How many cells: as asked, or the square root of the rows, within limits."""
    return max(1, min(asked or min(math.isqrt(n), MAX_LISTS), n))


def similarity_matrix(x: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return -(np.add.outer((x**2).sum(1), (c**2).sum(1)) - 2 * x @ c.T)
    if metric == "dot":
        return x @ c.T
    scale = np.maximum(np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(c, axis=1)), V.TINY_NORM)
    return x @ c.T / scale


def train(vectors: DataFrame, metric: str, nlist: int = 0, seed: int = 42) -> list[list[float]]:
    """Centroids from a bounded sample: nearest by the metric, moved to the mean."""
    n = vectors.count()
    if not n:
        raise EngineError("no vectors to train on")
    k = list_count(n, nlist)
    x = sample(vectors, max(SAMPLE_ROWS, k), seed)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ITERATIONS):
        cell = similarity_matrix(x, c, metric).argmax(axis=1)
        size = np.bincount(cell, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, cell, x)
        new = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), len(c))])
        move = np.linalg.norm(new - c, axis=1).max()
        c = new
        if move < LEAST_MOVE:
            break
    return c.tolist()


def sample(vectors: DataFrame, rows: int, seed: int) -> np.ndarray:
    """At most so many vectors, chosen by a hash of the id."""
    return np.array([r["vec"] for r in vectors.orderBy(F.xxhash64("id", F.lit(seed))).limit(rows).select("vec").collect()], float)


def tuned_probes(vectors: DataFrame, centroids: list[list[float]], metric: str, k: int = 10, reach: float = 0.95, seed: int = 42) -> int:
    """The fewest cells to look into for a share ``reach`` of the true k nearest,
    measured on the sample that the cells were trained on. Where vectors don't
    gather around centroids, that is most of the cells."""
    x, c = sample(vectors, SAMPLE_ROWS, seed), np.array(centroids, float)
    cell = similarity_matrix(x, c, metric).argmax(axis=1)
    queries = np.arange(min(TUNING_QUERIES, len(x)))
    scores = similarity_matrix(x[queries], x, metric)
    scores[queries, queries] = -np.inf
    near = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    order = np.argsort(np.argsort(-similarity_matrix(x[queries], c, metric), axis=1, kind="stable"), axis=1)
    place = np.sort(np.take_along_axis(order, cell[near], axis=1).ravel())
    return int(place[max(0, math.ceil(reach * len(place)) - 1)]) + 1 if len(place) else 1


def assigning(centroids: np.ndarray, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(1).to_pylist(), float)
            cell = np.round(similarity_matrix(x, centroids, metric), 9).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=["id", "vec", "norm", "cell"])

    return run


def assign(vectors: DataFrame, centroids: list[list[float]], metric: str) -> DataFrame:
    """Vectors with their nearest centroid's number; the first of equals."""
    return vectors.select("id", "vec", "norm").mapInArrow(assigning(np.array(centroids, float), metric), "id string, vec array<float>, norm double, cell int")


def probe(centroids: list[list[float]], query: list[float], metric: str, nprobe: int) -> list[int]:
    """The cells nearest to a query, the nearest first."""
    near = np.round(similarity_matrix(np.array([query], float), np.array(centroids, float), metric)[0], 9)
    return sorted(range(len(centroids)), key=lambda i: (-near[i], i))[:nprobe]


def cell_search(celled: DataFrame, centroids: list[list[float]], query: list[float], k: int, config: EngineConfig, metadata: DataFrame | None = None, filter_text: str = "", buffer: DataFrame | None = None, without: str | None = None) -> DataFrame:
    """Top k among the probed cells; stored by cell, only their files are read.

    ``buffer`` holds vectors that have no cell yet: all of them are compared,
    and an id that is there hides its older row.
    """
    cells = probe(centroids, query, config.distance_metric, config.ivf_nprobe)
    rows = celled.where(F.col("cell").isin(cells)).select("id", "vec", "norm")
    if buffer is not None:
        rows = rows.join(buffer.select("id"), "id", "left_anti").unionByName(buffer.select("id", "vec", "norm"))
    return search.by_vector(rows, query, k, config, metadata, filter_text, without=without)


def probing(centroids: np.ndarray, metric: str, nprobe: int):
    """(id, vec) to (id, vec, cell), a row for each of the nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = np.round(similarity_matrix(np.array(b.column(1).to_pylist(), float), centroids, metric), 9)
                cells = np.argsort(-near, axis=1, kind="stable")[:, :nprobe]
                again = b.take(pa.array(np.repeat(np.arange(b.num_rows), cells.shape[1])))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(cells.ravel(), pa.int32())], names=["id", "vec", "cell"])

    return run


def batch_cell_search(celled: DataFrame, centroids: list[list[float]], queries: DataFrame, k: int, config: EngineConfig) -> DataFrame:
    """``cell_search`` of many queries: each meets the rows of its cells only.

    A cell's queries are dealt into groups of bounded size, and each group reads
    the cell's rows once, as a stream of matrices.
    """
    asked = queries.select("id", "vec").mapInArrow(probing(np.array(centroids, float), config.distance_metric, config.ivf_nprobe), "id string, vec array<float>, cell int")
    return blocks.block_search(asked, celled, k, config.distance_metric, key="cell")


def stored_cells(vectors: DataFrame, centroids: list[list[float]], metric: str, path: str) -> DataFrame:
    """Assigned vectors, written by cell: a search reads its cells' folders only."""
    cells = assign(vectors, centroids, metric).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(blocks.PACKERS)))
    return scratch.written(cells, path, partition_by="cell")


@dataclass(frozen=True)
class CellIndex:
    """Trained cells on shared files, and the changes that came since as a buffer.

    A change hides the row of its id in the cells. All of the buffer is compared
    in a search; once it holds ``ivf_seal_threshold`` rows it is sealed: the cells
    are written anew with it, under the same centroids.
    """

    centroids: list[list[float]]
    celled: DataFrame
    buffer: DataFrame | None = None

    @classmethod
    def build(cls, vectors: DataFrame, config: EngineConfig, folder: Callable[[], str]) -> CellIndex:
        centroids = train(vectors, config.distance_metric, config.ivf_nlist)
        return cls(centroids, stored_cells(vectors, centroids, config.distance_metric, folder()))

    def changed(self, more: DataFrame, config: EngineConfig, folder: Callable[[], str]) -> CellIndex:
        """After changes (id, vec, seq); a null vector deletes."""
        held = more if self.buffer is None else self.buffer.select("id", "vec", "seq").unionByName(more)
        held = scratch.written(latest(held).select("id", "vec", V.norm(F.col("vec")).alias("norm"), "seq"), folder())
        if not config.ivf_seal_threshold or held.count() < config.ivf_seal_threshold:
            return replace(self, buffer=held)
        whole = self.celled.drop("cell").join(held.select("id"), "id", "left_anti").unionByName(held.where("vec is not null").drop("seq"))
        return replace(self, celled=stored_cells(whole, self.centroids, config.distance_metric, folder()), buffer=None)

    def search(self, query: list[float], k: int, config: EngineConfig, metadata: DataFrame | None = None, filter_text: str = "", without: str | None = None) -> DataFrame:
        return cell_search(self.celled, self.centroids, query, k, config, metadata, filter_text, self.buffer, without)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and the share of their exact answers (query_id, item_id)
    that were found."""
    both = exact.select("query_id", "item_id").join(found.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def quantizer(vectors: DataFrame) -> DataFrame:
    """One row: each dimension's least and largest value (low, high)."""
    dims = vectors.select(F.posexplode(V.doubles(F.col("vec"))).alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "low", "high")))
    return dims.agg(ordered.alias("all")).select(F.transform("all", lambda s: s["low"]).alias("low"), F.transform("all", lambda s: s["high"]).alias("high"))


def quantized(vectors: DataFrame, bounds: DataFrame) -> DataFrame:
    """(id, codes, low, high): a byte's worth per component."""
    return vectors.crossJoin(F.broadcast(bounds)).select("id", V.quantize(F.col("vec"), F.col("low"), F.col("high")).alias("codes"), "low", "high")


def quantized_search(codes: DataFrame, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """A full-precision query against quantised rows."""
    back = V.dequantize(F.col("codes"), F.col("low"), F.col("high"))
    rows = codes.select(F.col("id").alias("item_id"), F.round(V.similarity(metric, back, search.literal(query)), 9).alias("score"))
    return search.best(rows, k)


def tiered(main: DataFrame, delta: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """One store of two: the delta's rows hide the main store's."""
    rows = main.join(delta.select("id"), "id", "left_anti").unionByName(delta)
    return rows.join(deleted.select("id"), "id", "left_anti") if deleted is not None else rows


def merge_due(main_rows: int, delta_rows: int, most: int = 50_000, share: float = 0.1) -> bool:
    """Whether the delta should be written into the main store."""
    return delta_rows >= most or (main_rows > 0 and delta_rows >= share * main_rows)


def label_centroids(vectors: DataFrame, label: Column) -> list[list[float]]:
    """Means of labelled rows, in the labels' order: fixed cells for tests."""
    dims = vectors.select(label.alias("label"), F.posexplode(V.doubles(F.col("vec"))).alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("x"))
    rows = dims.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).orderBy("label").collect()
    return [[p["x"] for p in r["v"]] for r in rows]

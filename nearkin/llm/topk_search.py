"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Components are quantised to floor(1024 x). Query rows and candidate rows are
packed into blocks on shared files. Every query block meets every candidate
block: for each term (dimension), the block's postings (row, weight) are
scattered, weighted by the queries' values, into a dense queries-by-rows score
array; zero weights have no posting and zero query values touch nothing. The k
best of a block are found by partition selection, and a window merges blocks.

The queries are a stated set, so queries against rows in blocks is the task and
no pair is formed row by row. Blocks have at most ``BLOCK`` rows, which bounds a
task's memory; neither side is broadcast unless the planner finds it small.

Defined results: vectors that are null or hold null, NaN or infinite components
take no part, nor do rows without an id; missing trailing components count as
zero; an empty vector scores zero; a row is never its own query's answer, but
another row with the same id is; query rows with the same id, repeated ones too,
each have their own ranks from 1; of equal scores the smaller id comes first and
repeated rows each take a rank; an empty table, or one without able rows, gives
an empty result, and very long vectors only make blocks larger; other columns
are never looked at. As rows with the same id and weights give the same answer
lines, which of them is the query's own doesn't matter: one is left out. Sums that could pass 63 bits are done in Python
integers and then must fit a long.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearkin.llm.shared import Workspace

BLOCK = 2048
SCALE = 1024.0


def quantise(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        return np.array([int(x) for x in scaled.ravel()], dtype=object).reshape(scaled.shape)
    return scaled.astype(np.int64)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) rows to blocks: number, ids, lengths and float64 components."""
    number = itertools.count(TaskContext.get().partitionId() << 24)
    ids: list[np.ndarray] = []
    lens: list[np.ndarray] = []
    data: list[np.ndarray] = []

    def block(i, n, v):
        order = np.argsort(i, kind="stable")
        starts = np.concatenate([[0], np.cumsum(n)])
        v = np.concatenate([v[starts[o] : starts[o + 1]] for o in order]) if len(order) else v
        return pa.RecordBatch.from_arrays(
            [pa.array([next(number)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (i[order].astype("<i8"), n[order].astype("<i4"), v.astype("<f8")))], names=["number", "ids", "lens", "data"]
        )

    def drain(last: bool):
        nonlocal ids, lens, data
        if not ids:
            return
        i, n, v = np.concatenate(ids), np.concatenate(lens), np.concatenate(data)
        ends, at = np.concatenate([[0], np.cumsum(n)]), 0
        while len(i) - at >= BLOCK or (last and at < len(i)):
            to = min(at + BLOCK, len(i))
            yield block(i[at:to], n[at:to], v[ends[at] : ends[to]])
            at = to
        ids, lens, data = [i[at:]], [n[at:]], [v[ends[at] :]]

    for b in batches:
        if not b.num_rows:
            continue
        vec = b.column(1)
        ids.append(b.column(0).to_numpy(zero_copy_only=False))
        lens.append(np.diff(vec.offsets.to_numpy()))
        data.append(vec.flatten().to_numpy(zero_copy_only=False))
        if sum(map(len, ids)) >= BLOCK:
            yield from drain(False)
    yield from drain(True)


class Block:
    def __init__(self, ids: bytes, lens: bytes, data: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        n = np.frombuffer(lens, "<i4").astype(np.int64)
        self.values = values = quantise(np.frombuffer(data, "<f8"))
        self.ends = np.concatenate([[0], np.cumsum(n)])
        self.row = np.repeat(np.arange(len(n)), n)
        self.term = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
        some = values != 0
        self.row, self.term, self.weight = self.row[some], self.term[some], values[some]
        order = np.argsort(self.term, kind="stable")
        self.row, self.term, self.weight = self.row[order], self.term[order], self.weight[order]
        self.terms = int(self.term[-1]) + 1 if len(order) else 0
        self.edge = np.searchsorted(self.term, np.arange(self.terms + 1))
        self.top = max((abs(int(x)) for x in (self.weight.min(), self.weight.max())), default=0) if len(order) else 0

    def vector(self, row: int) -> np.ndarray:
        """A row's weights without the zeros at its end."""
        held = self.values[self.ends[row] : self.ends[row + 1]]
        some = np.flatnonzero(held)
        return held[: some[-1] + 1] if len(some) else held[:0]

    def twins(self, queries: Block) -> dict[int, list[int]]:
        """Query rows to the rows here with the same id and weights."""
        low, high = (np.searchsorted(self.ids, queries.ids, side) for side in ("left", "right"))
        return {j: [r for r in range(low[j], high[j]) if np.array_equal(self.vector(r), queries.vector(j))] for j in np.flatnonzero(low < high).tolist()}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.edge[term], self.edge[term + 1]
        return self.row[a:b], self.weight[a:b]


def accumulate(queries: Block, rows: Block) -> np.ndarray:
    wide = queries.top * rows.top * max(1, min(queries.terms, rows.terms)) >= 2**62
    kind = object if wide or object in (queries.weight.dtype, rows.weight.dtype) else np.int64
    scores = np.zeros((len(rows.ids), len(queries.ids)), dtype=kind)
    for term in range(min(queries.terms, rows.terms)):
        q, qw = queries.postings(term)
        r, rw = rows.postings(term)
        if len(q) and len(r):
            part = np.multiply.outer(rw.astype(kind), qw.astype(kind))
            if len(q) == scores.shape[1] and len(r) == scores.shape[0]:
                scores += part
            else:
                scores[np.ix_(r, q)] += part
    return scores


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best, ties to the smaller row."""
    able = np.arange(len(scores))
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k] if scores.dtype != object else sorted(scores)[-k]
        above = np.flatnonzero(scores > edge)
        able = np.concatenate([above, np.flatnonzero(scores == edge)[: k - len(above)]])
    return able


def search_blocks(k: int):
    """(query block, row block) to each query row's k + 1 best, its twins marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[int, Block] | None = None
        for b in batches:
            for i in range(b.num_rows):
                number, *q = (b.column(c)[i].as_py() for c in range(4))
                if kept is None or kept[0] != number:
                    kept = (number, Block(*q))
                queries, rows = kept[1], Block(*(b.column(c)[i].as_py() for c in range(4, 7)))
                scores, twins = accumulate(queries, rows), rows.twins(queries)
                out: list[list] = [[], [], [], [], []]
                for j, query in enumerate(queries.ids.tolist()):
                    best = select(scores[:, j], k + 1)
                    out[0].append(np.full(len(best), number * BLOCK + j))
                    out[1].append(np.full(len(best), query))
                    out[2].append(rows.ids[best])
                    found, twin = scores[best, j], np.zeros(len(best), bool)
                    if j in twins:
                        twin = np.isin(best, twins[j])
                        found[twin] = np.minimum(found[twin], np.iinfo(np.int64).max)
                    out[3].append(found.astype(np.int64))
                    out[4].append(twin)
                kinds = (*[pa.int64()] * 4, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, kinds, strict=True)], names=["query_row", "query_id", "vec_id", "score", "twin"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", work: Workspace | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for each row of ``queries`` over ``vectors``."""
    spark = vectors.sparkSession
    work = work or Workspace(spark, "topk")

    def packed(df: DataFrame, name: str) -> DataFrame:
        vec = df[vec_col].cast("array<double>")
        bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        able = df.where(vec.isNotNull() & df[id_col].isNotNull() & ~F.coalesce(bad, F.lit(True)))
        return work.table(able.select(df[id_col].cast("long"), vec).mapInArrow(pack, "number long, ids binary, lens binary, data binary"), name)

    q, c = packed(queries, "queries"), packed(vectors, "candidates")
    both = q.select(*(F.col(x).alias(f"q_{x}") for x in q.columns)).crossJoin(c.drop("number"))
    best = both.mapInArrow(search_blocks(k), "query_row long, query_id long, vec_id long, score long, twin boolean")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", F.desc("twin"))
    best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    twins = F.sum(F.col("twin").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    best = best.withColumn("twins", twins).where("not (twin and twins = 1)")
    rank = (F.col("place") - F.least("twins", F.lit(1))).cast("int")
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


OP8_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.own <> c.own
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

"""Exact nearest neighbours of many queries, a group of queries at a time.

Queries are dealt into groups of bounded size. A task holds one group and reads
the rows that the group meets once, in the order of their ids, as a stream: a
batch of rows is multiplied with the queries as matrices, only pairs that can be
among a query's k best so far are scored in full, and k rows per query leave the
task. So a task's memory depends on neither the number of rows nor that of the
queries; what is moved is the rows, once for each of about ``TASKS`` groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.functions.vector import TINY_NORM

#: Tasks that a search is dealt into, about, whatever the number of rows.
TASKS = 48
#: Queries of a group: at least, at most, and megabytes of them at most.
LEAST_GROUP, MOST_GROUP, GROUP_MB = 256, 1 << 15, 64
#: Rows that a share of the rows has at least, where few queries meet many.
LEAST_PART = 8192
#: Pairs of a batch and some queries that are looked at as one matrix.
STRIP_PAIRS = 1 << 21
#: Components of pairs that are scored in full at once.
EXACT_VALUES = 1 << 21
#: Decimals that scores are rounded to before they are ranked, so that ties
#: don't depend on the order of a sum.
DECIMALS = 9
#: Tasks that the rows of one key are packed by, so that a crowded one is no single task.
PACKERS = 8


def exact_scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Scores of pairs of rows, rounded."""
    if metric == "l2":
        score = 1.0 / (1.0 + np.sqrt(((q - x) ** 2).sum(axis=1)))
    else:
        score = np.einsum("ij,ij->i", q, x)
        if metric == "cosine":
            qn, xn = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
            small = (qn < TINY_NORM) | (xn < TINY_NORM)
            score = np.where(small, 0.0, score / np.where(small, 1.0, qn * xn))
    return np.round(score, DECIMALS)


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows at length one, in single precision; those without length are zero."""
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.where(n < TINY_NORM, 0.0, v / np.where(n < TINY_NORM, 1.0, n)).astype(np.float32)


def first_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows, sorted by id, less those after ``k + 1`` ids with the same
    vector: these score alike, and a query's own id can take one place only."""
    rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, same = np.unique(rows, return_inverse=True)
    if same.max() + 1 == len(same):
        return np.arange(len(same))
    order = np.argsort(same, kind="stable")
    group, names = same[order], ids[order]
    start = np.r_[True, group[1:] != group[:-1]]
    number = np.cumsum(start | np.r_[True, names[1:] != names[:-1]])
    number -= number[np.maximum.accumulate(np.where(start, np.arange(len(start)), 0))]
    return np.sort(order[number <= k])


class Best:
    """A group of queries and the k best rows of each so far."""

    def __init__(self, ids: list[str], q: np.ndarray, k: int, metric: str):
        self.ids, self.q, self.k, self.metric = np.array(ids, object), q, k, metric
        self.scores = np.full((len(q), k), -np.inf)
        self.items = np.full((len(q), k), None, object)
        self.finite = bool(np.isfinite(q).all())
        if metric == "cosine":
            self.screen = scaled(q)
        else:
            self.screen, self.norm = q, np.linalg.norm(q, axis=1)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Rows in the order of their ids, all after those before."""
        at = first_copies(ids, x, self.k) if x.shape[1] else np.arange(len(x))
        ids, x = ids[at], x[at]
        plain = self.finite and bool(np.isfinite(x).all()) and x.shape[1] > 0
        if plain:
            change = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True])
            self.own = int(np.diff(change).max(initial=1))
            near, norm = (scaled(x), None) if self.metric == "cosine" else (x, np.linalg.norm(x, axis=1))
        strip = max(1, STRIP_PAIRS // max(1, len(x)))
        for low in range(0, len(self.q), strip):
            high = min(low + strip, len(self.q))
            who, what = self.able(low, high, near, norm) if plain else np.divmod(np.arange((high - low) * len(x)), max(1, len(x)))
            if len(who):
                self.take(who + low, what, ids, x)

    def able(self, low: int, high: int, x: np.ndarray, norm: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs, by query and row, that can be among the k best. The
        matrix ascends with the score; ``slack`` is more than its errors."""
        near, worst = self.screen[low:high] @ x.T, self.scores[low:high, -1]
        if self.metric == "cosine":
            slack = np.full(high - low, (x.shape[1] + 16) * 1.2e-7)
            least = worst
        elif self.metric == "dot":
            slack = 1e-9 + 1e-12 * self.norm[low:high] * norm.max()
            least = worst
        else:  # half the squared distance less the query's share, negative
            near -= norm**2 / 2
            square = self.norm[low:high] ** 2
            shown = worst - 2 * 10.0**-DECIMALS
            far = np.where(shown > 0, 1.0 / np.where(shown > 0, shown, 1.0) - 1.0, np.inf)
            least, slack = (square - far**2) / 2, 1e-9 * (1 + square + norm.max() ** 2)
        least = least - slack
        at = near.shape[1] - self.k - self.own  # a query's own rows may be among the largest
        if at >= 0 and np.isneginf(worst).any():
            least = np.maximum(least, np.partition(near, at, axis=1)[:, at] - 2 * slack)
        return np.nonzero(near >= least.astype(near.dtype)[:, None])

    def take(self, who: np.ndarray, what: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        each = max(1, EXACT_VALUES // max(1, x.shape[1]))
        found = np.concatenate([exact_scores(self.q[who[i : i + each]], x[what[i : i + each]], self.metric) for i in range(0, len(who), each)])
        named = ids[what]
        # not a query itself, nothing that isn't a number, nothing that the k best keep out
        kept = (self.ids[who] != named) & (found > self.scores[who, -1])
        who, found, named = who[kept], found[kept], named[kept]
        if not len(who):
            return
        asked = np.unique(who)
        old = np.repeat(asked, self.k)
        who, found, named = np.r_[old, who], np.r_[self.scores[asked].ravel(), found], np.r_[self.items[asked].ravel(), named]
        order = np.lexsort((-found, who))  # stable: of equal ones what came first
        who, found, named = who[order], found[order], named[order]
        start = np.searchsorted(who, asked)
        pick = (start[:, None] + np.arange(self.k)).ravel()
        self.scores[asked], self.items[asked] = found[pick].reshape(-1, self.k), named[pick].reshape(-1, self.k)

    def results(self) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(self.q), 1024):
            who, place = np.nonzero(self.scores[low : low + 1024] > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[low + who].tolist(), pa.string()), pa.array(self.items[low + who, place].tolist(), pa.string()), pa.array(self.scores[low + who, place])], names=["query_id", "item_id", "score"])


def searching(k: int, metric: str):
    """(task, side, id, vec) of whole tasks, queries (side 0) before rows, these by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, names, held, best = None, [], [], None
        for b in batches:
            tasks, sides = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (tasks[1:] != tasks[:-1]) | (sides[1:] != sides[:-1])]) if b.num_rows else []
            for low, high in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                part = b.slice(low, high - low)
                x = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(high - low, len(part.column(3)[0]))
                if tasks[low] != task:
                    if best is not None:
                        yield from best.results()
                    task, names, held, best = tasks[low], [], [], None
                if sides[low] == 0:
                    names += part.column(2).to_pylist()
                    held.append(x)
                elif held or best is not None:
                    if best is None:
                        best, held = Best(names, np.concatenate(held), k, metric), []
                    best.add(np.array(part.column(2).to_pylist(), object), x)
        if best is not None:
            yield from best.results()

    return run


def dealing(counts: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(key, width, groups of queries, shares of rows, first task) from
    (key, width, queries, rows): about ``TASKS`` tasks of even work, at least one a key."""
    total = sum(q * x for _, _, q, x in counts)
    out, first = [], 0
    for key, width, q, x in counts:
        share = TASKS * q * x / total
        most = max(1, min(MOST_GROUP, (GROUP_MB << 17) // max(1, width)))
        groups = max(math.ceil(q / most), min(math.ceil(share), math.ceil(q / min(LEAST_GROUP, most))))
        parts = max(1, min(math.ceil(share / groups), math.ceil(x / LEAST_PART)))
        out.append((key, width, groups, parts, first))
        first += groups * parts
    return out


def block_search(queries: DataFrame, vectors: DataFrame, k: int, metric: str, key: str | None = None) -> DataFrame:
    """(query_id, item_id, score, rank): each query over all vectors of its width,
    with a ``key`` column over those of its key alone. A query that stands under
    several keys has one ranking."""
    from nearkin.operators.search import top_per_query

    spark = queries.sparkSession
    kind = "array<float>" if all(dict(df.dtypes)["vec"] == "array<float>" for df in (queries, vectors)) else "array<double>"
    sides = [df.where("vec is not null").select((F.col(key) if key else F.lit(0)).cast("int").alias("key"), F.size("vec").alias("width"), "id", F.col("vec").cast(kind).alias("vec")) for df in (queries, vectors)]
    # a row for each cell and width, so few
    counts = [df.groupBy("key", "width").agg(F.count(F.lit(1)).alias(n)) for df, n in zip(sides, ("q", "x"), strict=True)]
    met = dealing(sorted(map(tuple, counts[0].join(counts[1], ["key", "width"]).select("key", "width", "q", "x").collect())))
    plan = F.broadcast(spark.createDataFrame(met, "key int, width int, groups int, parts int, first int"))
    group, part = F.pmod(F.xxhash64("id"), F.col("groups")), F.pmod(F.xxhash64("id"), F.col("parts"))
    task = F.col("first") + F.col("group") * F.col("parts") + F.col("part")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = sides[0].join(plan, ["key", "width"]).withColumn("group", group).withColumn("part", every("parts"))
    rows = sides[1].join(plan, ["key", "width"]).withColumn("part", part).withColumn("group", every("groups"))
    dealt = [df.select(task.cast("int").alias("task"), F.lit(i).alias("side"), "id", "vec") for i, df in enumerate((asked, rows))]
    tasks = max(1, sum(g * p for _, _, g, p, _ in met))
    dealt = dealt[0].union(dealt[1]).repartitionById(tasks, "task").sortWithinPartitions("task", "side", "id")
    return top_per_query(dealt.mapInArrow(searching(k, metric), "query_id string, item_id string, score double"), k)


def batch_vectors(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, item_id, score, rank) for each query over all vectors.

    Narrow to cells first (see ``ann``) where all pairs are too many.
    """
    return block_search(queries, vectors, k, metric)

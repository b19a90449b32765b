"""Packing of tokenised documents into sequences by linear grouping.

Lengths are integers up to the capacity, so a histogram of bounded size tells
all that the plan depends on; the driver plans from it alone, whatever the
number of documents:

1. Pieces longer than ``LARGE`` of the capacity are large. Sorted by length,
   they are cut into groups of equal cardinality and each length is rounded up
   to the longest of its group, which leaves few sizes.
2. Configurations (multisets of sizes that fit) are chosen for the longest
   remaining size by an exact subset-sum programme, each used as often as the
   remaining counts allow.
3. Actual lengths take the rounded ones' places; since a group's lengths are
   known in order, each sequence's true room is known as well.
4. Small pieces go, longest first, where they leave the least room, into that
   room or into new sequences.

The plan says, per length, which ranks go to which sequences. Ranks are counted
inside each write task and added up over tasks by a window per length that sees
one row per task, so no task holds the pieces of a length.

Defined results: a null text counts as empty (its end id alone is packed); a
null id is carried along; repeated rows are packed each; a document longer than
the capacity is cut, its last piece may be shorter; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearkin.llm.chunks import encoder, ended, slices
from nearkin.llm.shared import BROADCAST_ROWS, Workspace, id_and_text

#: Share of the capacity above which a piece is large.
LARGE = 1 / 8
#: Groups of equal cardinality that large lengths are rounded in.
GROUPS = 256


@dataclass
class Plan:
    """Segments: pieces of ``length`` with ranks from ``low`` on stand ``per``
    to a sequence in the sequences from ``sequence`` on, the first at ``offset``."""

    sequences: int = 0
    segments: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    taken: defaultdict = field(default_factory=lambda: defaultdict(int))

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def place(self, length: int, n: int, sequence: int, per: int, offset: int) -> None:
        self.segments.append((length, self.taken[length], sequence, per, offset))
        self.taken[length] += n


def linear_groups(large: list[tuple[int, int]], groups: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded length, runs [length, count]) of groups of equal cardinality;
    ``large`` is sorted from the longest."""
    total = sum(n for _, n in large)
    each = max(1, -(-total // groups))
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length, n in large:
        while n:
            if not room:
                out.append((length, []))
                room = each
            part = min(n, room)
            out[-1][1].append([length, part])
            n, room = n - part, room - part
    merged: dict[int, list[list[int]]] = {}
    for rounded, runs in out:
        merged.setdefault(rounded, []).extend(runs)
    return list(merged.items())


def best_fill(room: int, sizes: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """(index, multiplicity) whose sizes sum to the most that ``room`` holds,
    longer sizes first; sizes descend."""
    mask = (1 << room + 1) - 1
    able = [i for i in range(len(sizes) - 1, -1, -1) if counts[i] and sizes[i] <= room]
    reach = [1]
    for i in able:
        bits = reach[-1]
        for _ in range(min(counts[i], room // sizes[i])):
            bits |= bits << sizes[i] & mask
        reach.append(bits)
    left = reach[-1].bit_length() - 1
    out = []
    for k in range(len(able) - 1, -1, -1):
        i = able[k]
        for m in range(min(counts[i], left // sizes[i]), -1, -1):
            if reach[k] >> left - m * sizes[i] & 1:
                break
        if m:
            out.append((i, m))
            left -= m * sizes[i]
    return out


def make_plan(histogram: dict[int, int], capacity: int, large_share: float = LARGE, groups: int = GROUPS) -> Plan:
    plan = Plan()
    if n := histogram.get(capacity):
        plan.place(capacity, n, plan.open(n), 1, 0)
    large = [(v, histogram[v]) for v in range(capacity - 1, int(large_share * capacity), -1) if histogram.get(v)]
    grouped = linear_groups(large, groups)
    sizes, runs = [g[0] for g in grouped], [g[1][::-1] for g in grouped]  # a group's longest run is last
    counts = [sum(n for _, n in r) for r in runs]

    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (sequences, first)
    for lead in range(len(sizes)):
        while counts[lead]:
            counts[lead] -= 1
            config = {lead: 1}
            for i, m in best_fill(capacity - sizes[lead], sizes, counts):
                config[i] = config.get(i, 0) + m
            counts[lead] += 1
            times = min(counts[i] // m for i, m in config.items())
            slots = [i for i, m in config.items() for _ in range(m)]
            for i, m in config.items():
                counts[i] -= m * times
            while times:
                # so many sequences that every slot takes pieces of one run
                part = min(times, *(max(1, runs[i][-1][1] // m) for i, m in config.items()))
                first, fill = plan.open(part), 0
                for i in slots:
                    run = runs[i][-1]
                    plan.place(run[0], part, first, 1, fill)
                    fill += run[0]
                    run[1] -= part
                    if not run[1]:
                        runs[i].pop()
                rooms[capacity - fill].append((part, first))
                times -= part

    open_rooms = 0
    for room in rooms:
        open_rooms |= 1 << room
    for length in range(int(large_share * capacity), 0, -1):
        n = histogram.get(length, 0) if length < capacity else 0
        while n:
            above = open_rooms >> length
            if not above:
                each = capacity // length
                more = -(-n // each)
                rooms[capacity].append((more, plan.open(more)))
                open_rooms |= 1 << capacity
                continue
            room = length + (above & -above).bit_length() - 1
            many, first = rooms[room].pop()
            per = min(room // length, n)
            part = min(many, n // per)
            if part < many:
                rooms[room].append((many - part, first + part))
            if not rooms[room]:
                open_rooms &= ~(1 << room)
            plan.place(length, part * per, first, per, capacity - room)
            n -= part * per
            left = room - per * length
            rooms[left].append((part, first))
            open_rooms |= 1 << left
    return plan


def cutting(path: str, kind: str, end: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = encoder(path, kind)
        task, seen, rows = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), 0
        for batch in batches:
            for part, texts in slices(batch):
                edges, ids = ended(*gather(texts), end)
                size = np.diff(edges)
                number = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                held = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
                low = 4 * (edges[doc] + start)
                own = [held[a:b] for a, b in zip(low.tolist(), (low + 4 * length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order)) - np.searchsorted(length[order], length[order])
                place += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = {
                    "task": pa.array(np.full(len(doc), task), pa.int32()),
                    "row": pa.array((task << 40) + rows + doc, pa.int64()),
                    "doc_id": part.column(0).take(pa.array(doc)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int32()),
                    "ids_crc32": pa.array(list(map(zlib.crc32, own)), pa.int64()),
                    "place": pa.array(place, pa.int64()),
                    "ids": pa.array(map(bytes, own) if with_ids else [None] * len(own), pa.binary(), size=len(own)),
                }
                rows += len(size)
                yield pa.RecordBatch.from_pydict(columns)

    return run


def placing(plan: Plan):
    seg = np.array(sorted(plan.segments), np.int64).reshape(-1, 5)
    keys = seg[:, 0] << 45 | seg[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column(3).to_numpy().astype(np.int64), b.column(5).to_numpy()
            _, low, sequence, per, offset = seg[np.searchsorted(keys, length << 45 | rank, "right") - 1].T
            at = rank - low
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence + at // per), pa.array(offset + at % per * length), b.column(6)], names=[*b.schema.names[:5], "sequence_id", "offset", "row"])

    return run


def pack(docs: DataFrame, path: str, kind: str, end: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, work: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """(pieces, places): the written pieces, and a row per piece with doc_id,
    piece, start, length, ids_crc32, sequence_id, offset and row (tells documents
    apart, whatever their ids). Pieces hold their ids only if asked to."""
    work = work or Workspace(docs.sparkSession, "packing")
    schema = "task int, row long, doc_id long, piece int, start long, length int, ids_crc32 long, place long, ids binary"
    pieces = work.table(id_and_text(docs, id_col, text_col).mapInArrow(cutting(path, kind, end, capacity, with_ids), schema), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = work.table(counts.withColumn("before", F.coalesce(before, F.lit(0))), "counts")
    plan = make_plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = counts.select("task", "length", "before")
    # told to broadcast, as a guess from its files' size deals and sorts all pieces, in large pages of memory
    before = F.broadcast(before) if counts.count() <= BROADCAST_ROWS else before
    ranked = pieces.drop("ids").join(before, ["task", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"), "row")
    return pieces, ranked.mapInArrow(placing(plan), "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long, row long")


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves."""
    whole = places.join(pieces.select("row", "piece", "ids"), ["row", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b""), lambda a, x: F.concat(a, x))
    return whole.groupBy("sequence_id").agg(joined.alias("ids"))


def packed(docs: DataFrame) -> DataFrame:
    """All documents in sequences of at most 2048 tokens of the word vocabulary."""
    import public_tokenizers

    _, places = pack(docs, public_tokenizers.path("word_bpe_49k.json"), "word", 0, 2048, with_ids=False)
    return places.drop("row").withColumn("length", F.col("length").cast("long"))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))

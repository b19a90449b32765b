"""Token ids written in a binary format and read back.

Ids are replaced by their rank among all ids of the corpus, the commonest
first, so most take one byte. A rank takes one to four bytes; the number less
one stands in two bits of a separate control byte that four ranks share. Reading
looks a control byte up in a table of lengths and gathers the bytes with numpy.

Layout, all below one folder on shared storage: ``ranks`` (rank, id) and
``blocks``, whose rows are (first, n_docs, n_ids, doc_ids, lengths, control,
data): up to ``BLOCK_IDS`` ids of consecutive documents, with ``first`` the number of
ids of all documents before them. Documents ascend by id inside and across
blocks.

Documents are spread over ranges of (id, number of the row in the scan), so even
the rows of one id go to many tasks. Bounds come from a sample of at most
``SAMPLED`` x ``MAX_RANGES`` ids, so no text is read for them; a task sorts its
range, with spilling, and keeps one block in memory. What meets on the driver is
that sample, a total per range and a count per vocabulary entry, all bounded.

Defined results: a null text counts as empty and is its end id alone; a null id
comes before all others; rows with the same id stand side by side, in the
order of the scan; an empty table gives no block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.chunks import encoder, ended, slices, vocabulary_size
from nearkin.llm.shared import Workspace, id_and_text

BLOCK_IDS = 1 << 19
#: Bytes of text encoded at once.
SLICE_BYTES = 4 << 20
#: Ids of a range of documents at most, roughly: what one task sorts and writes.
RANGE_DOCS = 1 << 15

#: Ranges at most: their bounds and totals go to every task.
MAX_RANGES = 1 << 14
#: Rows that bounds are taken from, for each range.
SAMPLED = 64

#: Lengths of the four ranks that a control byte stands for.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def code(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of some ranks."""
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = extra
    control = four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    bytes_ = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.sum(axis=1, dtype=np.uint8).tobytes(), bytes_[np.arange(4) <= extra[:, None]].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    held = np.frombuffer(data + b"\0\0\0", np.uint8)
    words = np.ndarray((max(len(data), 1),), "<u4", held if len(data) else np.zeros(4, np.uint8), strides=(1,))
    return words[np.cumsum(length) - length] & MASKS[length - 1]


def encoding(path: str, kind: str, end: int, bounds: list[tuple[int, int]]):
    ids, rows = (np.array([b[k] for b in bounds], np.int64) for k in (0, 1))

    def range_of(doc: np.ndarray, row: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(ids, doc), np.searchsorted(ids, doc, "right")
        for i in np.flatnonzero(low < high):  # an id that is a bound itself: its rows are told apart
            low[i] += np.searchsorted(rows[low[i] : high[i]], row[i], "right")
        return low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = encoder(path, kind)
        kept = id_type(path, end)
        for batch in batches:
            for part, texts in slices(batch, 2, SLICE_BYTES):
                edges, held = ended(*gather(texts), end)
                held = held.astype(kept)
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((edges * kept.itemsize).astype(np.int32)), pa.py_buffer(held)])
                doc, row = part.column(0), part.column(1)
                where = range_of(pc.fill_null(doc, np.iinfo(np.int64).min).to_numpy(), row.to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), doc, row, binary], names=["range", "doc_id", "row", "ids"])

    return run


def id_type(path: str, end: int) -> np.dtype:
    """The narrowest integers that hold all ids on their way to the blocks."""
    return np.dtype("<u2" if max(vocabulary_size(path), end + 1) <= 1 << 16 else "<u4")


def blocking(kept: np.dtype):
    """Sorted documents to blocks of raw ids; ``before`` counts inside the range."""
    width = kept.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, before, docs, lengths, held, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def block():
            columns = {
                "range": pa.array([where], pa.int32()),
                "before": pa.array([before], pa.int64()),
                "n_ids": pa.array([n], pa.int64()),
                "doc_ids": pa.ListArray.from_arrays(pa.array([0, sum(map(len, docs))], pa.int32()), pa.concat_arrays(docs)),
                "lengths": pa.array([np.concatenate(lengths)], pa.list_(pa.int64())),
                "ids": pa.array([b"".join(held)], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            size = pc.binary_length(batch.column(1)).to_numpy().astype(np.int64) // width
            edges = np.concatenate([[0], np.cumsum(size)])
            at = 0
            while at < batch.num_rows:
                room = BLOCK_IDS - n
                to = max(at, int(np.searchsorted(edges, edges[at] + room, "right")) - 1)
                if to == at and not n:
                    to = at + 1  # longer than a block: a block alone
                if to > at:
                    part = batch.slice(at, to - at)
                    docs.append(part.column(0))
                    lengths.append(size[at:to])
                    held += part.column(1).to_pylist()
                    n += int(edges[to] - edges[at])
                if to < batch.num_rows:
                    yield block()
                    before, docs, lengths, held, n = before + n, [], [], [], 0
                at = to
        if docs:
            yield block()

    return run


def counting(kept: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                n = np.bincount(np.frombuffer(ids.as_buffer(), kept), minlength=len(total))
                n[: len(total)] += total
                total = n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])

    return run


def coding(kept: np.dtype, rank_of: np.ndarray, base: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [base[w] + b for w, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            coded = [code(rank_of[np.frombuffer(ids.as_buffer(), kept)]) for ids in batch.column(5)]
            columns = {
                "first": pa.array(first, pa.int64()),
                "n_docs": pc.cast(pc.list_value_length(batch.column(3)), pa.int64()),
                "n_ids": batch.column(2),
                "doc_ids": batch.column(3),
                "lengths": batch.column(4),
                "control": pa.array([c for c, _ in coded], pa.binary()),
                "data": pa.array([d for _, d in coded], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


BLOCKS = "first long, n_docs long, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary"
RANKS = "rank long, id long"


def range_bounds(keys: DataFrame, n: int, ranges: int) -> list[tuple[int, int]]:
    """(id, row) that ranges of about equal numbers of documents start at, from a sample of bounded size."""
    some = keys.sample(min(1.0, SAMPLED * ranges / n), 0).collect()
    some = sorted((np.iinfo(np.int64).min if r["doc_id"] is None else r["doc_id"], r["row"]) for r in some)
    return sorted({some[i * len(some) // ranges] for i in range(1, ranges)}) if some else []


def write_tokens(docs: DataFrame, path: str, kind: str, end: int, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> str:
    """Encode all documents and write them; returns the folder."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "tokens", keep=True)
    kept = id_type(path, end)
    # rows are numbered as they are scanned, so that those of one id can be dealt to many ranges
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    n = rows.count()
    ranges = min(MAX_RANGES, max(1, -(-n // RANGE_DOCS), min(n // 256, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    bounds = range_bounds(rows.select("doc_id", "row"), n, ranges) if ranges > 1 else []
    coded = rows.mapInArrow(encoding(path, kind, end, bounds), "range int, doc_id long, row long, ids binary")
    ordered = coded.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "row").select("doc_id", "ids")
    raw = work.table(ordered.mapInArrow(blocking(kept), "range int, before long, n_ids long, doc_ids array<long>, lengths array<long>, ids binary"), "raw", codec="lz4")

    counts = raw.select("ids").mapInArrow(counting(kept), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ranked = [r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))]
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    held = {r["range"]: r["n"] for r in raw.groupBy("range").agg(F.sum("n_ids").alias("n")).collect()}
    base = np.concatenate([[0], np.cumsum([held.get(i, 0) for i in range(len(bounds) + 1)])]).tolist()
    work.table(spark.createDataFrame(list(enumerate(ranked)), RANKS).coalesce(1), "ranks")
    work.table(raw.mapInArrow(coding(kept, rank_of, base), BLOCKS), "blocks", codec="uncompressed")
    work.drop("raw")
    return work.path


def reading(id_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, docs, lengths, control, data in zip(*(batch.column(i) for i in range(6)), strict=True):
                ids = id_of[decode(control.as_py(), data.as_py(), n.as_py())]
                size = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(size)
                held = [ids[a:b].tobytes() for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(first.as_py() + ends - size, pa.int64()), pa.array(held, pa.binary())], names=["doc_id", "start", "ids"])

    return run


def read_tokens(spark, folder: str) -> DataFrame:
    """doc_id, start, ids (little-endian 32-bit integers) of each document."""
    ranks = spark.read.schema(RANKS).parquet(f"{folder}/ranks").collect()
    id_of = np.zeros(max(1, len(ranks)), "<u4")
    for r in ranks:
        id_of[r["rank"]] = r["id"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").select("first", "n_ids", "doc_ids", "lengths", "control", "data")
    return blocks.mapInArrow(reading(id_of), "doc_id long, start long, ids binary")


def op6_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte", 0, work=Workspace(spark, "tokens"))
    return read_tokens(spark, folder).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

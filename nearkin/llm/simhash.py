"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: ASCII letters in lower case, words between ASCII white space,
``SHINGLE``-word shingles with repeats, XXH64; a bit is set where it is in over
half the shingles.

Candidates: the 64 bits are split into ``radius + extra`` parts; two
fingerprints within the radius agree on at least ``extra`` whole parts, so every
choice of ``extra`` parts is a table and its bits a bucket key. All rows of a
bucket are compared: nothing is lost and no bucket is capped. More ``extra``
means more tables of smaller buckets, and is chosen from the number of distinct
fingerprints.

Comparison: rows of a task stand in 64 vertical bit planes, 64 rows to a word. A
block of work is (one fingerprint, one word of rows). Plane by plane the
differing bits are added into carry-save counters of all blocks at once, and
blocks in which every row has passed the radius are abandoned.

Buckets with more than ``CHUNK_ROWS`` rows are split by hash into chunks, and
pairs of chunks are compared in tasks of their own. A task returns, for its
rows, a tree of links (each row to the smallest of its connected rows), never
the pairs. Components over these links are found by alternating large-star and
small-star rounds on written tables.

Defined results: a null text counts as empty; texts without words have
fingerprint zero and link like others; rows repeated with the same id share a
row's result; null ids are reached through their fingerprint and never give a
component its name unless nothing else does (then it is null); an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.chunks import slices
from nearkin.llm.shared import Workspace, text_key, text_of

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Rows of a bucket compared in one task, and of either side of a pair of chunks.
CHUNK_ROWS = 1 << 14
#: Blocks compared at once.
BLOCKS = 1 << 15
#: Candidates per fingerprint at which another choice of parts pays.
CANDIDATES = 1 << 11
#: Shingles whose bits are spread out at once.
SPREAD = 1 << 14


def shingle_hashes(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the text's shingles, with repeats; none without words."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, "<u8")
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length)[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], "<u8", n)


def print_of(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SPREAD):
        bits = np.unpackbits(hashes[at : at + SPREAD].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return print_of(shingle_hashes(text, shingle, seed))


def fingerprinting(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 2):
                prints = np.array([fingerprint(t.as_py(), shingle, seed) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(prints)], names=["doc_id", "text_key", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_key, fp (the 64 bits as a signed long)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_key(docs, text_col).alias("text_key"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(fingerprinting(shingle, seed), "doc_id long, text_key long, fp long")


def parts_for(n: int, radius: int) -> int:
    """How many parts must agree: as few as keep buckets small on ``n`` rows."""
    for extra in range(1, 5):
        bits = 64 * extra // (radius + extra)
        if comb(radius + extra, extra) * n / 2**bits <= CANDIDATES:
            break
    return extra


def table_masks(radius: int, extra: int) -> list[int]:
    edges = [64 * i // (radius + extra) for i in range(radius + extra + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(parts, extra)]


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Vertical bit planes: [64, words], bit r of word w is row 64 w + r."""
    held = np.zeros(-(-len(prints) // 64) * 64, "<u8")
    held[: len(prints)] = prints
    bits = np.unpackbits(held.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def ones_from(lo: np.ndarray) -> np.ndarray:
    """Words with bits lo and above set (lo in 0..64)."""
    shift = np.minimum(lo, 63).astype(np.uint64)
    return np.where(lo > 63, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) << shift)


def near(prints: np.ndarray, planes: np.ndarray, who: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, hits): blocks with rows within the radius, and those rows' bits."""
    alive = np.arange(len(who))
    n = len(who)
    query = prints[who]
    counters = [np.zeros(n, np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(n, np.uint64)
    exceeded = np.zeros(n, np.uint64)
    for plane in range(64):
        carry = planes[plane][word] ^ (np.uint64(0) - (query >> np.uint64(plane) & np.uint64(1)))
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        over |= carry
        if plane % 4 == 3 and plane >= 11 or plane == 63:
            exceeded = over.copy()  # more than the radius, digit by digit from the top
            same = ~over
            for i in range(len(counters) - 1, -1, -1):
                if radius >> i & 1:
                    same &= counters[i]
                else:
                    exceeded |= same & counters[i]
                    same &= ~counters[i]
            keep = exceeded != np.uint64(0xFFFFFFFFFFFFFFFF)
            if plane < 63 and keep.mean() < 0.8:
                alive, query, word, over = alive[keep], query[keep], word[keep], over[keep]
                counters = [c[keep] for c in counters]
                if not len(alive):
                    return alive, over
    return alive, ~exceeded


def join_links(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of a[i] and b[i]; roots are the smallest of their trees."""
    while True:
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
        x, y = parent[a], parent[b]
        some = x != y
        if not some.any():
            return
        a, b, x, y = a[some], b[some], x[some], y[some]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def link(prints: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: int) -> np.ndarray:
    """Components (smallest position) when row i is compared with lo[i]..hi[i]-1."""
    parent = np.arange(len(prints))
    planes = planes_of(prints)
    first, last = lo // 64, np.maximum(lo // 64, (hi - 1) // 64)
    number = np.where(hi > lo, last - first + 1, 0)
    ends = np.cumsum(number)
    for at in range(0, int(ends[-1]) if len(ends) else 0, BLOCKS):
        block = np.arange(at, min(at + BLOCKS, int(ends[-1])))
        who = np.searchsorted(ends, block, "right")
        word = first[who] + block - (ends - number)[who]
        kept, hits = near(prints, planes, who, word, radius)
        who, word = who[kept], word[kept]
        low, high = np.clip(lo[who] - 64 * word, 0, 64), np.clip(hi[who] - 64 * word, 0, 64)
        hits &= ones_from(low) & ~ones_from(high)
        some = np.flatnonzero(hits)
        if len(some):
            bits = np.unpackbits(hits[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, r = np.nonzero(bits)
            join_links(parent, who[some][k], 64 * word[some][k] + r)
    join_links(parent, parent, parent)
    return parent


def comparing(radius: int):
    """Rows (bucket, side, fp) of whole tasks, sorted by bucket and side, to links.

    Rows of side 0 are compared with all that follow in the bucket, rows of
    side 1 only serve; a bucket that is one chunk has side 0 alone. In a pair of
    different chunks rows of side 0 meet those of side 1 only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush():
            table = pa.Table.from_batches(held)
            bucket = table.column(0).to_numpy()
            side = table.column(1).to_numpy()
            prints = table.column(2).to_numpy().view(np.uint64)
            n = len(prints)
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            stop = np.repeat(np.r_[edge[1:], n], np.diff(np.r_[edge, n]))
            served = np.repeat(np.add.reduceat(side == 0, edge), np.diff(np.r_[edge, n])) + np.repeat(edge, np.diff(np.r_[edge, n]))
            paired = np.repeat(np.maximum.reduceat(side, edge) > 0, np.diff(np.r_[edge, n]))
            lo = np.where(paired, served, np.arange(n) + 1)
            hi = np.where(side == 0, stop, lo)
            root = link(prints, lo, hi, radius)
            linked = root != np.arange(n)
            return pa.RecordBatch.from_arrays([pa.array(prints[linked].view(np.int64)), pa.array(prints[root[linked]].view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # whole buckets only: what follows the last change of bucket waits
            bucket = batch.column(0).to_numpy()
            change = np.flatnonzero(bucket[1:] != bucket[:-1])
            if held and held[-1].column(0)[-1].as_py() != bucket[0]:
                cut = 0
            elif len(change):
                cut = int(change[-1]) + 1
            else:
                cut = None
            if cut is not None and rows >= CHUNK_ROWS:
                if cut:
                    held.append(batch.slice(0, cut))
                yield flush()
                held, rows = [], 0
                batch = batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield flush()

    return run


def links(prints: DataFrame, n: int, radius: int, work: Workspace) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the radius; ``prints``
    is a written table of ``n`` distinct fingerprints."""
    masks = table_masks(radius, parts_for(n, radius))
    tables = F.explode(F.array(*(F.struct(F.lit(i).alias("table"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("mask")) for i, m in enumerate(masks)))).alias("t")
    rows = prints.select("fp", tables).select("fp", F.xxhash64("t.table", F.col("fp").bitwiseAND(F.col("t.mask"))).alias("bucket"))
    # only crowded buckets are listed, so the list stays short
    crowded = rows.groupBy("bucket").count().where(F.col("count") > CHUNK_ROWS).select("bucket", F.ceil(F.col("count") / CHUNK_ROWS).cast("int").alias("chunks"))
    crowded = work.table(crowded, "crowded")
    if crowded.isEmpty():
        dealt = rows.select("bucket", F.lit(0).alias("side"), "fp")
    else:
        split = rows.join(F.broadcast(crowded) if crowded.count() <= 100_000 else crowded, "bucket", "left")
        own = F.pmod(F.xxhash64("fp", F.lit(1)), F.coalesce("chunks", F.lit(1))).cast("int")
        split = split.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
        pair = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
        dealt = split.select(
            F.when(F.col("chunks").isNull(), F.col("bucket")).otherwise(pair).alias("bucket"),
            F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
            "fp",
        )
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "side").mapInArrow(comparing(radius), "a long, b long")


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """node, root: the smallest node of each linked node's component.

    Alternates large-star (a node's larger neighbours move to its smallest) and
    small-star (its smaller ones do), each on a table written to shared storage,
    until every link goes straight to a root. The smallest neighbours are written
    before they are joined back, so that a node with very many links is joined
    from two plain exchanges, which adaptive execution can split.
    """

    def settled(df: DataFrame) -> bool:
        n, children = df.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
        return n == children and df.select("b").distinct().join(df.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()

    def star(df: DataFrame, large: bool, name: str) -> DataFrame:
        """(a, b) with a > b to the same form, every node's links moved to its smallest."""
        both = df.select("a", "b").union(df.select(F.col("b"), F.col("a"))) if large else df
        low = work.table(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), f"low-{name}")
        joined = both.join(low, "a")
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        return work.table(out.where("a <> b").distinct(), name)

    now, turn = work.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links-0"), 0
    while not settled(now):
        turn += 1
        wide = star(now, True, f"wide-{turn}")
        after = star(wide, False, f"links-{turn}")
        for name in (f"links-{turn - 1}", f"wide-{turn}", f"low-wide-{turn}", f"low-links-{turn}"):
            work.drop(name)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, work: Workspace | None = None) -> DataFrame:
    """doc_id, text_key, fp, component_id for every row."""
    work = work or Workspace(docs.sparkSession, "simhash")
    rows = work.table(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = work.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), distinct.count(), radius, work), work)
    named = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written, so that a root with very many fingerprints is joined from two plain exchanges
    least = work.table(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_key", "fp", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""BPE encoding by a segment tree over adjacent pair ranks, and decoding.

A piece's symbols stand at the leaves of a tree whose inner nodes hold the
smallest (rank, place) below them, so the root yields the leftmost pair of the
lowest rank. A merge changes three leaves, and the paths above them are brought
up to date in logarithmic time, until no pair can be merged. Pieces of about the
same length are worked on together: the trees are the rows of one array, and
each step merges once in every row that still has a pair. A long piece is worked
on alone, and a step merges all its pairs of the root's rank from the left: a pair
that a merge makes has a higher rank, so none of them could have come in between
(checked for the vocabulary; where it doesn't hold, one pair is merged at a time).

Decoding gathers the bytes of each id from one flat table; bytes that are no
UTF-8 become the replacement character, as in the library.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to itself; repeated rows each give a row; an empty table gives an empty
result. Ids outside the vocabulary are an error.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.chunks import ALPHABET, Cache, Gatherer, pieces, slices
from nearkin.llm.shared import id_and_text

#: Leaves of the trees worked on together.
LEAVES = 1 << 19
#: Bits of the number of leaves from which a piece is worked on alone.
LONG_BITS = 12
NONE = np.iinfo(np.int64).max


class Bpe:
    """Merges and vocabulary of a byte-level tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocab = whole["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        code = left << 32 | right
        self.order = np.argsort(code)
        self.codes = code[self.order]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # whether a merge only ever makes pairs of higher ranks than its own
        last = np.full(len(vocab) + 1, -1, np.int64)
        last[self.made] = np.arange(len(pairs))
        self.ascends = bool((np.maximum(last[left], last[right]) < np.arange(len(pairs))).all())
        self.of_byte = np.array([vocab[ALPHABET[b]] for b in range(256)], np.int64)
        self.added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        byte = {c: b for b, c in ALPHABET.items()}
        spelt = {i: bytes(byte[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        self.size = np.zeros(max(spelt) + 1, np.int64)
        for i, b in spelt.items():
            self.size[i] = len(b)
        self.table = np.frombuffer(b"".join(spelt.get(i, b"") for i in range(len(self.size))), np.uint8)
        self.first = np.cumsum(self.size) - self.size
        self.memo = Cache(lambda new: self.merge([p.encode() for p in new]))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``NONE`` for what can't be merged."""
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (a >= 0) & (b >= 0), self.order[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        width = np.array([max(1, (len(w) - 1).bit_length()) for w in words])
        for bits in np.unique(width).tolist():
            mine = np.flatnonzero(width == bits)
            if bits >= LONG_BITS:
                for i in mine.tolist():
                    out[i] = self.merge_long(words[i], bits)
                continue
            rows = max(1, LEAVES >> bits)
            for at in range(0, len(mine), rows):
                part = mine[at : at + rows]
                for i, ids in zip(part.tolist(), self.merge_rows([words[i] for i in part.tolist()], bits), strict=True):
                    out[i] = ids
        return out

    def merge_rows(self, words: list[bytes], bits: int) -> list[bytes]:
        n, leaves = len(words), 1 << bits
        length = np.fromiter(map(len, words), np.int64, n)
        symbol = np.full((n, leaves + 1), -1, np.int64)
        row = np.repeat(np.arange(n), length)
        symbol[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, leaves + 2), (n, 1))
        before = np.tile(np.arange(-1, leaves), (n, 1))
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        place = np.arange(leaves)

        def key(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(rank == NONE, NONE, (rank << bits) | at)

        tree[:, leaves:] = key(self.rank(symbol[:, :-1], symbol[:, 1:]), place)
        for level in range(bits - 1, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])

        live = np.arange(n)
        while True:
            root = tree[live, 1]
            some = root != NONE
            live, root = live[some], root[some]
            if not len(live):
                break
            at = root & (leaves - 1)
            gone = after[live, at]
            symbol[live, at] = new = self.made[root >> bits]
            symbol[live, gone] = -1
            follows = np.minimum(after[live, gone], leaves)
            after[live, at] = follows
            before[live, follows] = at
            prior = before[live, at]
            tree[live, leaves + np.minimum(gone, leaves - 1)] = NONE
            tree[live, leaves + at] = key(self.rank(new, symbol[live, follows]), at)
            has = prior >= 0
            first = np.where(has, prior, at)
            tree[live[has], leaves + prior[has]] = key(self.rank(symbol[live[has], prior[has]], new[has]), prior[has])
            for leaf in (gone, at, first):
                node = leaves + leaf
                for _ in range(bits):
                    node = node >> 1
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
        left = symbol >= 0
        ids = symbol[left].astype("<u4")
        edges = np.concatenate([[0], np.cumsum(left.sum(axis=1))]).tolist()
        return [ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def merge_long(self, word: bytes, bits: int) -> bytes:
        """A long word's ids: all pairs of the root's rank in one step."""
        n, leaves = len(word), 1 << bits
        symbol = np.full(leaves + 1, -1, np.int64)
        symbol[:n] = self.of_byte[np.frombuffer(word, np.uint8)]
        after, before = np.arange(1, leaves + 2), np.arange(-1, leaves)
        tree = np.full(2 * leaves, NONE, np.int64)
        tree[leaves:] = self.rank(symbol[:-1], symbol[1:])
        for level in range(bits - 1, -1, -1):
            a = 1 << level
            tree[a : 2 * a] = np.minimum(tree[2 * a : 4 * a : 2], tree[2 * a + 1 : 4 * a : 2])
        while tree[1] != NONE:
            rank, node = tree[1], np.array([1])
            for _ in range(bits):  # down to the leaves of the root's rank, from the left
                node = np.stack([2 * node, 2 * node + 1], axis=1).ravel()
                node = node[tree[node] == rank] if self.ascends else node[tree[node] == rank][:1]
            at = node - leaves
            if len(at) > 1:  # of pairs that share a symbol every other one, from the left
                fresh = np.r_[True, after[at[:-1]] != at[1:]]
                run = np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                at = at[run % 2 == 0]
            gone = after[at]
            symbol[at], symbol[gone] = self.made[rank], -1
            follows = np.minimum(after[gone], leaves)
            after[at], before[follows] = follows, at
            tree[leaves + np.minimum(gone, leaves - 1)] = NONE
            prior = before[at]
            here = np.concatenate([at, prior[prior >= 0]])
            tree[leaves + here] = self.rank(symbol[here], symbol[np.minimum(after[here], leaves)])
            node = np.unique(np.concatenate([here, np.minimum(gone, leaves - 1)])) + leaves
            while node[0] > 1:
                node = node >> 1
                node = node[np.r_[True, node[1:] != node[:-1]]]
                tree[node] = np.minimum(tree[2 * node], tree[2 * node + 1])
        return symbol[:leaves][symbol[:leaves] >= 0].astype("<u4").tobytes()

    def segments(self, chunk: str) -> list[str]:
        """The chunk's pieces; added tokens' strings stand by themselves."""
        at, token = min(((chunk.find(s), s) for s in self.added if s in chunk), default=(-1, ""))
        if at < 0:
            return pieces(chunk) if chunk else []
        return [*self.segments(chunk[:at]), token, *self.segments(chunk[at + len(token) :])]

    def __call__(self, chunks: list[str]) -> list[bytes]:
        parts = [self.segments(c) for c in chunks]
        wanted = list(dict.fromkeys(p for q in parts for p in q if p not in self.added))
        known = dict(zip(wanted, self.memo.get_many(wanted), strict=True))
        known |= {s: np.array([i], "<u4").tobytes() for s, i in self.added.items()}
        return [b"".join([known[p] for p in q]) for q in parts]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The ids' bytes on end."""
        ids = ids.astype(np.int64)
        if ids.size and (ids.max() >= len(self.size) or (self.size[ids] == 0).any()):
            raise ValueError("an id is not in the vocabulary")
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.table[np.repeat(self.first[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> tuple[Bpe, Gatherer]:
    bpe = Bpe(path)
    return bpe, Gatherer(bpe, "<u4", "byte", list(bpe.added))


def encoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, gather = codec(path)
        for batch in batches:
            for part, texts in slices(batch):
                start, length, ids = gather(texts)
                held = [ids[a : a + n].tobytes() for a, n in zip(start.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(length, pa.int64()), pa.array(held, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def decoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = codec(path)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x.as_py(), "<u4")).tobytes().decode("utf-8", "replace") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers)."""
    return id_and_text(docs, id_col, text_col).mapInArrow(encoding(path), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` to what ``encode`` returns."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(decoding(path), "doc_id long, n_tokens long, ids binary, decoded string")


def round_tripping(path: str):
    encoded, decoded = encoding(path), decoding(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from decoded(encoded(batches))

    return run


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one Python worker, with one copy of the tables."""
    return id_and_text(docs, id_col, text_col).mapInArrow(round_tripping(path), "doc_id long, n_tokens long, ids binary, decoded string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

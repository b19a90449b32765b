"""Exact token counts at every prefix, by prefix dynamic programming.

A byte-pair encoding of a pre-tokenizer piece is the one sequence of tokens in
which every neighbouring pair encodes to itself. So the encoding of a prefix is
that of a shorter prefix and one more token: the only token that ends the
prefix and agrees with the shorter prefix's last one. The programme keeps count
and last token at each prefix of a piece; prefixes that pieces share are worked
out once. Rules for prefixes that end in white space, a contraction or an added
token's string turn counts in pieces into counts in texts.

Kept per text: the change in count that each character brings (counts may fall: a
longer prefix can need fewer tokens), a byte per character, or four where one is
beyond a byte. Truncation and budget
questions are then sums over those bytes (``count_at``, ``longest_within``); the
text is never encoded again.

Defined results: a null text counts as empty; an empty text has no prefix and no
tokens; repeated rows each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import operator
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from nearkin.llm.chunks import WHITE, Cache, Gatherer, added_tokens, load, pieces, slices, spelled
from nearkin.llm.shared import id_and_text

CONTRACTIONS = ("'re", "'ve", "'ll")
#: Longer prefixes are worked out each time and not kept.
KEPT_PREFIX = 24
KEPT = 400_000


def changes(counts: list[int]) -> bytes:
    """Differences of neighbouring counts as signed integers."""
    return struct.pack(f"<{len(counts)}i", *map(operator.sub, counts, [0, *counts[:-1]]))


def signed(held: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(held) // 4}i", held)


def narrow(change: np.ndarray) -> np.ndarray:
    """As bytes where all fit."""
    return change.astype(np.int8) if not len(change) or -128 <= change.min() and change.max() <= 127 else change


class PrefixCounts:
    """Counts at the prefixes of chunks, for a byte-level vocabulary."""

    def __init__(self, path: str):
        self.tokenize = load(path).model.tokenize
        self.vocab = load(path).get_vocab(with_added_tokens=False)
        self.token = {i: s for s, i in self.vocab.items()}
        # lengths of the tokens that end in one or two given characters
        ends: dict[str, set[int]] = {}
        for token in self.vocab:
            ends.setdefault(token[-2:], set()).add(len(token))
        self.lengths = {e: sorted(n) for e, n in ends.items()}
        self.special = list(added_tokens(path))
        self.agreed: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, tuple[int, int]] = {}
        self.memo = Cache(self.pieces)

    def agrees(self, before: int, token: int) -> bool:
        """Whether the two side by side encode to themselves (before < 0: alone)."""
        known = self.agreed.get((before, token))
        if known is None:
            if len(self.agreed) > KEPT:
                self.agreed.clear()
            want = [token] if before < 0 else [before, token]
            known = [t.id for t in self.tokenize("".join(self.token[i] for i in want))] == want
            self.agreed[before, token] = known
        return known

    def step(self, s: str, i: int, last: list[int], count: list[int]) -> tuple[int, int]:
        for n in (1, *self.lengths.get(s[max(0, i - 2) : i], ())):
            if n > i:
                break
            token = self.vocab.get(s[i - n : i])
            if token is not None and self.agrees(last[i - n], token):
                return count[i - n] + 1, token
        raise AssertionError("every byte is a token")

    def piece(self, text: str) -> list[int]:
        """Counts at the prefixes of a piece, in characters, from 1."""
        s = spelled(text)
        last, count, kept = [-1], [0], self.kept
        for i in range(1, len(s) + 1):
            got = kept.get(s[:i]) if i <= KEPT_PREFIX else None
            if got is None:
                got = self.step(s, i, last, count)
                if i <= KEPT_PREFIX:
                    kept[s[:i]] = got
            count.append(got[0])
            last.append(got[1])
        if text in CONTRACTIONS:  # cut short, it is an apostrophe and a letter
            count[2] = self.piece("'")[0] + self.piece(text[1])[0]
        if len(s) == len(text):
            return count[1:]
        ends = itertools.accumulate(len(c.encode()) for c in text)
        return [count[e] for e in ends]

    def pieces(self, new: list[str]) -> list[bytes]:
        if len(self.kept) > KEPT:
            self.kept.clear()
        return [changes(self.piece(p)) for p in new]

    def plain(self, chunk: str) -> bytes:
        """Changes along a chunk without added tokens."""
        blank = len(chunk) - len(chunk.lstrip(WHITE))
        found = self.memo.get_many(pieces(chunk))
        if blank < 2:
            return b"".join(found)
        # a prefix that ends in the white space has it as a single piece
        run = self.memo.get_many([chunk[:blank]])[0]
        counts = list(itertools.accumulate(signed(b"".join(found))))
        return changes([*itertools.accumulate(signed(run)), *counts[blank:]])

    def chunk(self, chunk: str) -> bytes:
        at, token = min(((chunk.find(s), s) for s in self.special if s in chunk), default=(-1, ""))
        if at < 0:
            return self.plain(chunk)
        counts = list(itertools.accumulate(signed(self.plain(chunk[: at + len(token) - 1]))))
        counts.append(sum(signed(self.plain(chunk[:at]))) + 1)
        rest = chunk[at + len(token) :]
        return changes(counts) + (self.chunk(rest) if rest else b"")

    def __call__(self, chunks: list[str]) -> list[bytes]:
        easy = [None if (c[:2].isspace() and len(c) > 1) or any(s in c for s in self.special) else pieces(c) for c in chunks]
        wanted = list(dict.fromkeys(p for q in easy if q for p in q))
        known = dict(zip(wanted, self.memo.get_many(wanted), strict=True))
        return [self.chunk(c) if q is None else b"".join([known[p] for p in q]) for c, q in zip(chunks, easy, strict=True)]


@functools.lru_cache(maxsize=2)
def gatherer(path: str) -> Gatherer:
    make = PrefixCounts(path)
    return Gatherer(make, "<i4", "byte", make.special)


def count_at(changes: bytes, n_chars: int, width: int = 1) -> int:
    """Tokens of the text's first ``n_chars`` characters; ``width`` bytes stand for each."""
    return int(np.frombuffer(changes, f"<i{width}")[:n_chars].sum(dtype=np.int64))


def longest_within(changes: bytes, budget: int, width: int = 1) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    within = np.flatnonzero(np.cumsum(np.frombuffer(changes, f"<i{width}"), dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def prefixes(path: str, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = gatherer(path)
        for batch in batches:
            for part, texts in slices(batch):
                start, length, change = work(texts)
                ends = start + length
                total = np.concatenate([[0], np.cumsum(change, dtype=np.int64)])
                n = total[ends] - total[start]
                small = narrow(change)  # as a rule all fit
                kept = [narrow(small[a:b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)]
                width = [c.itemsize for c in kept]
                kept = [c.tobytes() for c in kept]
                within = [len(c) // w if m <= budget else longest_within(c, budget, w) for c, w, m in zip(kept, width, n.tolist(), strict=True)]
                columns = {
                    "doc_id": part.column(0),
                    "n_bytes": pc.cast(pc.binary_length(texts), pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()),
                    "chars_within": pa.array(within, pa.int64()),
                    "changes": pa.array(kept, pa.binary()),
                    "width": pa.array(width, pa.int32()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return run


def token_prefixes(docs: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, chars_within (the longest prefix of at most
    ``budget`` tokens, in characters) and changes (``width`` bytes per character)."""
    schema = "doc_id long, n_bytes long, n_tokens long, chars_within long, changes binary, width int"
    return id_and_text(docs, id_col, text_col).mapInArrow(prefixes(path, budget), schema)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = token_prefixes(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "chars_within")

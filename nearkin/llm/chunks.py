"""Encoding of whole texts by their chunks, a batch at a time.

A chunk is a stretch of text that the tokenizer encodes without regard to what
stands around it. Texts are cut into chunks by Arrow kernels, distinct chunks of
a slice are looked up in a bounded cache, and a text's values are gathered from
those of its chunks. Only chunks that are not in the cache are worked out.

``byte`` tokenizers (byte-level, white space kept) are cut between a character
that isn't white space and white space after it, and before a comma or stop
that follows a letter or digit; ``word`` tokenizers (small letters, white space
dropped) at white space and before such a comma or stop. All cuts are exact for
any text.
"""

from __future__ import annotations

import ctypes
import functools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of text handled at once in a task (one longer text is a slice alone).
SLICE_BYTES = 2 << 20
#: Entries of each of the cache's two generations.
CACHE_ROOM = 120_000
#: The same for the library's ids, which have no second cache of pieces.
IDS_ROOM = {"byte": 350_000, "word": 150_000}
#: Chunks that the library encodes as one text.
JOINED = 200
#: Longer keys are worked out each time and not kept.
CACHE_KEY = 64

# The tokenizer's white space (code points), its pre-tokenizer
# pattern, and the characters its byte alphabet stands for.
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Digits and letters that no normaliser turns into anything but letters.
STAYS = "0-9A-Za-zÀ-ÖØ-öø-įı-ʯͰ-ͳͶͷͻ-ͽΆΈ-ΊΌΎ-ΡΣ-ϵϷ-ҁҊ-ӿ"
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Latin letters for which the built-in ``re`` gives the same pieces faster.
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ƺ"
LATIN_ONLY = re.compile("[\n -~¡-±´-¸»¿-ƺ]*")
LATIN_PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")
ANY_PIECE = regex.compile(PIECE.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))


def byte_alphabet() -> dict[int, str]:
    """Byte to the character that stands for it."""
    others = iter(range(256, 512))
    return {b: chr(b) if b in set(PLAIN_BYTES) else chr(next(others)) for b in range(256)}


ALPHABET = byte_alphabet()


def spelled(text: str) -> str:
    """``text`` in the tokenizer's byte alphabet."""
    return text.encode().decode("latin-1").translate(ALPHABET)


def pieces(chunk: str) -> list[str]:
    """What a byte tokenizer's pre-tokenizer makes of text without added tokens."""
    return LATIN_PIECE.findall(chunk) if LATIN_ONLY.fullmatch(chunk) else ANY_PIECE.findall(chunk)


@functools.lru_cache(maxsize=4)
def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def added_tokens(path: str) -> dict[str, int]:
    return {t.content: i for i, t in load(path).get_added_tokens_decoder().items()}


def vocabulary_size(path: str) -> int:
    """One more than the largest id."""
    return max(load(path).get_vocab(with_added_tokens=True).values()) + 1


#: The C library's call for it, where it has one.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


class Cache:
    """Two generations of results: what is used again outlives what is not."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], room: int = CACHE_ROOM):
        self.make, self.room = make, room
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get_many(self, keys: list[str]) -> list[bytes]:
        found = list(map(self.young.get, keys))
        missing = [i for i, v in enumerate(found) if v is None]
        new = []
        for i in missing:
            v = self.old.get(keys[i])
            if v is None:
                new.append(i)
            else:
                found[i] = self.young[keys[i]] = v
        if new:
            for i, v in zip(new, self.make([keys[i] for i in new]), strict=True):
                found[i] = v
                if len(keys[i]) <= CACHE_KEY:
                    self.young[keys[i]] = v
        if len(self.young) > self.room:
            self.old, self.young = self.young if self.room else {}, {}
        return found


class Gatherer:
    """Values of whole texts from the values of their chunks."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], dtype, kind: str, special: list[str] = (), room: int = CACHE_ROOM):
        self.cache, self.dtype, self.kind = Cache(make, room), np.dtype(dtype), kind
        odd = [rf"[{WHITE}]{{2}}", r"[\t\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x00]"]
        odd.append(r"[^\p{L}\p{N}][,.]")  # here a stop is no piece's start
        if kind == "word":  # marks may compose otherwise once letters are small
            odd = [r"\p{M}", f"[^{STAYS}][,.]"]
        self.odd = "|".join([*odd, *(f"(?i:{re.escape(s)})" for s in special)])

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All chunks, each text's first chunk and its number of chunks."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        if self.kind == "word":
            plain, between, find = pc.ascii_lower(plain), " ", lambda t: t.replace("\n", " ").split(" ")
            cuts = (("\n", " "), (",", " ,"), (".", " ."))
        else:
            between, find = "\0", CHUNK.findall
            cuts = (("\n", "\0\n\0"), (" ", "\0 "), (",", "\0,"), (".", "\0."))
        for at, cut in cuts:
            plain = pc.replace_substring(plain, at, cut)
        lists = pc.split_pattern(plain, between)
        edges = lists.offsets.to_numpy().astype(np.int64)
        edges = edges - edges[0]
        first, number = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        first[~odd], number[~odd] = edges[:-1], np.diff(edges)
        more = [find(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        number[odd] = n = np.fromiter(map(len, more), np.int64, len(more))
        first[odd] = edges[-1] + np.cumsum(n) - n
        return pa.concat_arrays([lists.flatten(), pa.array([c for m in more for c in m], lists.type.value_type)]), first, number

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, values): text i has values[start[i]:start[i] + length[i]]."""
        chunks, first, number = self.cut(texts)
        coded = chunks.dictionary_encode()
        index = coded.indices.to_numpy()
        made = self.cache.get_many(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, made), np.int64, len(made)) // self.dtype.itemsize
        values = np.frombuffer(b"".join(made), self.dtype)
        lengths = size[index]
        edges = np.concatenate([[0], np.cumsum(lengths)])
        shift = (np.cumsum(size) - size)[index] - edges[:-1]
        out = values[np.repeat(shift, lengths) + np.arange(edges[-1])]
        return edges[first], edges[first + number] - edges[first], out


def ended(start: np.ndarray, length: np.ndarray, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, values): a gatherer's texts on end in their order, an end id after each."""
    edges = np.concatenate([[0], np.cumsum(length + 1)])
    inside = np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)
    out = np.full(edges[-1], end, values.dtype)
    out[np.repeat(edges[:-1], length) + inside] = values[np.repeat(start, length) + inside]
    return edges, out


def release() -> None:
    """Give freed memory back, so that a worker's next stage starts small."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def slices(batch: pa.RecordBatch, text: int = 1, size: int | None = None) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch of about ``SLICE_BYTES`` of text each, and their texts."""
    size = size or SLICE_BYTES
    if not batch.num_rows:
        return
    texts = pc.fill_null(batch.column(text), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to
    release()


class Library:
    """Token ids of chunks by the tokenizers library, many in one call.

    The chunks are joined by an added token's string, which the library takes
    out before anything else, so each is encoded as if it stood alone.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.special = list(added_tokens(path))
        alone = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if not (t.normalized or t.single_word or t.lstrip or t.rstrip)]
        self.stop_id, self.stop = alone[-1] if alone else (-1, "")

    def joined(self, chunks: list[str]) -> list[bytes]:
        if not self.stop:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        out: list[bytes] = []
        texts = [self.stop.join(chunks[i : i + JOINED]) for i in range(0, len(chunks), JOINED)]
        for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(found.ids, "<u4")
            stops = np.flatnonzero(ids == self.stop_id)
            held, ends = ids.tobytes(), (4 * stops).tolist()
            out += [held[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(held)], strict=True)]
        return out

    def __call__(self, chunks: list[str]) -> list[bytes]:
        odd = {i for i, c in enumerate(chunks) if any(s in c for s in self.special)}
        plain = [c for i, c in enumerate(chunks) if i not in odd]
        out = self.joined(plain) if plain else []
        for i in sorted(odd):  # these hold an added token's string themselves
            out.insert(i, np.array(self.tokenizer.encode(chunks[i], add_special_tokens=False).ids, "<u4").tobytes())
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> Gatherer:
    """The task's encoder, kept while its Python worker lives."""
    make = Library(path)
    return Gatherer(make, "<u4", kind, make.special, IDS_ROOM[kind])

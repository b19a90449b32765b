import hashlib
import random
import string
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearkin.llm import bpe, chunks, packing, token_counts, token_output

from .conftest import ODD

P = pytest.importorskip("public_tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")

PARTS = [*"abcABC .,!?'\n\t", "  ", "\r\n", "\x1c", "\x85", "\xa0", " ", "'s", "'re", "é", "é", "İ", "Σ", "中", "½", "Ⅷ", "😀", "1234", "<|endoftext|>", "<|end", "\x00", " the", " ,", "..", "3.14"]
texts = st.lists(st.sampled_from(PARTS), max_size=30).map("".join)


def ids(path, text):
    return chunks.load(path).encode(text, add_special_tokens=False).ids


def gathered(gather, texts):
    start, length, values = gather(pa.array(texts, pa.string()))
    return [values[a : a + n].tolist() for a, n in zip(start, length, strict=True)]


def rng_texts(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_chunks_encode_as_the_library(path, kind):
    held = rng_texts(1, 2000)
    assert gathered(chunks.encoder(path, kind), held) == [ids(path, t) for t in held]


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text_encodes_as_the_library(text):
    for path, kind in ((BYTE, "byte"), (WORD, "word")):
        assert gathered(chunks.encoder(path, kind), [text]) == [ids(path, text)]
    assert gathered(bpe.codec(BYTE)[1], [text]) == [ids(BYTE, text)]


def test_cache_keeps_what_is_used():
    made = []
    cache = chunks.Cache(lambda new: made.extend(new) or [k.encode() for k in new], room=4)
    for i in range(20):
        assert cache.get_many(["hot", f"k{i}"]) == [b"hot", f"k{i}".encode()]
    assert made.count("hot") == 1 and len(cache.young) + len(cache.old) <= 12


def test_slices_hold_whole_texts(monkeypatch):
    monkeypatch.setattr(chunks, "SLICE_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["abc", None, "x" * 50, "de"])], names=["i", "t"])
    parts = [(b.column(0).to_pylist(), t.to_pylist()) for b, t in chunks.slices(batch)]
    assert [i for b, _ in parts for i in b] == [1, 2, 3, 4] and [t for _, x in parts for t in x] == ["abc", "", "x" * 50, "de"]


# -- prefix counts -----------------------------------------------------------


@given(texts)
@settings(max_examples=150, deadline=None)
def test_every_prefix_has_its_exact_count(text):
    change = np.array(gathered(token_counts.gatherer(BYTE), [text])[0], np.int32)
    want = [len(ids(BYTE, text[:i])) for i in range(len(text) + 1)]
    for held, width in ((token_counts.narrow(change), 1), (change, 4)):
        assert held.itemsize == width
        assert [token_counts.count_at(held.tobytes(), i, width) for i in range(len(text) + 1)] == want
        for budget in (0, 1, 3, 10):
            assert token_counts.longest_within(held.tobytes(), budget, width) == max(i for i, n in enumerate(want) if n <= budget)


def test_wide_changes_are_kept_whole(spark, frame, monkeypatch):
    change = np.array([1, 300, -200, 0], np.int32)
    assert token_counts.narrow(change) is change and token_counts.count_at(change.tobytes(), 2, 4) == 301
    assert token_counts.longest_within(change.tobytes(), 101, 4) == 4


def test_a_megabyte_without_white_space_takes_seconds():
    rnd = random.Random(9)
    held = ["".join(rnd.choices(string.ascii_letters, k=1 << 20)), "x" * (1 << 20), "ab" * (1 << 19)]
    _, gather = bpe.codec(BYTE)
    began = time.process_time()
    found = gathered(gather, held)
    assert time.process_time() - began < 60
    assert found == [ids(BYTE, t) for t in held]
    small = held[0][: 1 << 17]
    began = time.process_time()
    change = np.array(gathered(token_counts.gatherer(BYTE), [small])[0])
    assert time.process_time() - began < 30 and change.sum() == len(ids(BYTE, small))


def test_long_pieces_merge_as_the_library(monkeypatch):
    code, _ = bpe.codec(BYTE)
    rnd = random.Random(3)
    held = ["".join(rnd.choices("abcde", k=n)) for n in (2, 3, 50, 300)] + ["a" * n for n in (2, 3, 4, 5, 17)] + ["é" * 40]
    for ascends in (True, False):
        monkeypatch.setattr(code, "ascends", ascends)
        for t in held:
            word = t.encode()
            assert np.frombuffer(code.merge_long(word, max(1, (len(word) - 1).bit_length())), "<u4").tolist() == ids(BYTE, t)


def test_token_counts_of_odd_rows(odd, empty):
    rows = token_counts.token_prefixes(odd, BYTE, 100).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, len(r.changes)) for r in rows), key=repr)
    assert got == sorted(((i, len((t or "").encode()), len(ids(BYTE, t or "")), len(t or "")) for i, t in ODD), key=repr)
    assert token_counts.token_prefixes(empty, BYTE, 100).count() == 0


# -- segment-tree BPE --------------------------------------------------------


@given(texts)
@settings(max_examples=150, deadline=None)
def test_segment_tree_merges_as_the_library(text):
    assert gathered(bpe.codec(BYTE)[1], [text]) == [ids(BYTE, text)]


def test_long_pieces_and_decoding():
    code, gather = bpe.codec(BYTE)
    held = ["ab" * 3000, "x" * 7001, "\t" * 500 + "é" * 300, "", "<|endoftext|>" * 3]
    assert gathered(gather, held) == [ids(BYTE, t) for t in held]
    for t in [*held, *rng_texts(2, 200)]:
        own = ids(BYTE, t)
        assert code.decode(np.array(own)).tobytes().decode("utf-8", "replace") == chunks.load(BYTE).decode(own, skip_special_tokens=False) == t
    rnd = np.random.default_rng(1)
    for _ in range(50):
        own = rnd.integers(0, 50256, 20).tolist()
        assert code.decode(np.array(own)).tobytes().decode("utf-8", "replace") == chunks.load(BYTE).decode(own, skip_special_tokens=False)
    with pytest.raises(ValueError, match="vocabulary"):
        code.decode(np.array([10**6]))


def test_round_trip_of_odd_rows(odd, empty):
    key = lambda df: sorted((tuple(r) for r in df.select("doc_id", "n_tokens", "ids", "decoded").collect()), key=repr)
    got = key(bpe.round_trip(odd, BYTE))
    assert got == key(bpe.decode(bpe.encode(odd, BYTE), BYTE))
    want = [(i, len(ids(BYTE, t or "")), bytearray(np.array(ids(BYTE, t or ""), "<u4").tobytes()), t or "") for i, t in ODD]
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(empty, BYTE).count() == 0


# -- token files -------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 2000])
def test_ranks_survive_coding(n):
    rnd = np.random.default_rng(n)
    for top in (10, 1 << 8, 1 << 16, (1 << 16) + 1, 1 << 24, 1 << 32):
        ranks = rnd.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        control, data = token_output.code(ranks)
        assert len(control) == -(-n // 4)
        assert (token_output.decode(control, data, n) == ranks).all()
    edges = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], np.uint32)
    assert (token_output.decode(*token_output.code(edges), len(edges)) == edges).all()


@pytest.mark.parametrize("block", [1 << 19, 50])
def test_token_files_hold_all_in_order(spark, odd, empty, monkeypatch, block):
    monkeypatch.setattr(token_output, "BLOCK_IDS", block)
    monkeypatch.setattr(token_output, "RANGE_DOCS", 4)
    folder = token_output.write_tokens(odd, BYTE, "byte", 0)
    rows = sorted(token_output.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    held = [(i, np.array([*ids(BYTE, t or ""), 0], "<u4").tobytes()) for i, t in ODD]
    held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [r.doc_id for r in rows] == [i for i, _ in held]
    at = 0
    for r in rows:
        assert r.start == at
        at += len(r.ids) // 4
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in rows) == sorted((i is None, i or 0, b) for i, b in held)
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(len(ranks)))
    assert token_output.read_tokens(spark, token_output.write_tokens(empty, BYTE, "byte", 0)).count() == 0


# -- packing -----------------------------------------------------------------


def check_plan(histogram, capacity, plan):
    keys = sorted(plan.segments)
    held = {}
    for length, n in histogram.items():
        for rank in range(n):
            _, low, first, per, offset = max(s for s in keys if s[0] == length and s[1] <= rank)
            at = rank - low
            held.setdefault(first + at // per, []).append((offset + at % per * length, length))
    assert len(held) == plan.sequences
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity


@given(st.sampled_from([8, 32, 256]), st.lists(st.integers(1, 256), max_size=120), st.sampled_from([1, 3, 256]))
@settings(max_examples=120, deadline=None)
def test_plans_are_gapless_and_within_capacity(capacity, lengths, groups):
    histogram = {}
    for v in lengths:
        v = min(v, capacity)
        histogram[v] = histogram.get(v, 0) + 1
    plan = packing.make_plan(histogram, capacity, groups=groups)
    check_plan(histogram, capacity, plan)
    total = sum(v * n for v, n in histogram.items())
    if groups == 256:  # a group to each piece, so nothing is rounded: no two sequences could share one
        assert plan.sequences <= 2 * (total // capacity) + 1


def test_plan_is_near_the_bound():
    rnd = random.Random(6)
    histogram = {}
    for _ in range(20_000):
        v = min(2048, int(rnd.expovariate(1 / 600)) + 1)
        histogram[v] = histogram.get(v, 0) + 1
    plan = packing.make_plan(histogram, 2048)
    assert plan.sequences <= 1.005 * -(-sum(v * n for v, n in histogram.items()) // 2048)


def test_groups_have_equal_cardinality():
    groups = packing.linear_groups([(10, 3), (9, 4), (7, 1)], 4)
    assert [(size, [tuple(r) for r in runs]) for size, runs in groups] == [(10, [(10, 2), (10, 1), (9, 1)]), (9, [(9, 2), (9, 1), (7, 1)])]


def test_packing_of_odd_rows(odd, empty):
    pieces, places = packing.pack(odd, WORD, "word", 0, 64)
    rows = places.collect()
    whole = {}
    for i, t in ODD:
        own = [*ids(WORD, t or ""), 0]
        for k, a in enumerate(range(0, len(own), 64)):
            key = (i, k, a, len(own[a : a + 64]), zlib.crc32(np.array(own[a : a + 64], "<u4").tobytes()))
            whole[key] = whole.get(key, 0) + 1
    found = {}
    for r in rows:
        found[tuple(r)[:5]] = found.get(tuple(r)[:5], 0) + 1
    assert found == whole
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 64
    assert packing.pack(empty, WORD, "word", 0, 64)[1].count() == 0


def test_packed_sequences_hold_the_ids(frame):
    rows = [(i, f"alpha beta {i} " * (i % 9)) for i in range(40)]
    pieces, places = packing.pack(frame(rows), WORD, "word", 0, 32)
    held = b"".join(bytes(r.ids) for r in packing.sequences(pieces, places).collect())
    want = [x for _, t in rows for x in [*ids(WORD, t), 0]]
    assert sorted(np.frombuffer(held, "<u4").tolist()) == sorted(want)


def test_packed_sequences_of_null_ids(frame):
    rows = [(None, f"alpha beta {i} " * (i % 9)) for i in range(12)] + [(3, "one two"), (3, "one two")]
    pieces, places = packing.pack(frame(rows), WORD, "word", 0, 32)
    held = b"".join(bytes(r.ids) for r in packing.sequences(pieces, places).collect())
    want = [x for _, t in rows for x in [*ids(WORD, t), 0]]
    assert sorted(np.frombuffer(held, "<u4").tolist()) == sorted(want)


# -- registered queries ------------------------------------------------------


def test_queries_over_tokens_give_what_their_contracts_ask(spark, frame, tmp_path):
    rows = [r for r in ODD if r[0] is not None] + [(20, "word " * 3000)]
    frame(rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    raw = lambda own: np.array(own, "<u4").tobytes()
    own = {(i, t): ids(BYTE, t or "") for i, t in rows}
    found = token_counts.op1_token_counts(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == sorted((i, len((t or "").encode()), len(own[i, t]), len(own[i, t]) > 1024) for i, t in rows)
    found = token_output.op6_token_output(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == sorted((i, len(own[i, t]) + 1, zlib.crc32(raw([*own[i, t], 0]))) for i, t in rows)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert ordered == sorted(ordered)
    found = bpe.op7_bpe(spark, str(tmp_path)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted((i, len(own[i, t]), sha(raw(own[i, t])), sha((t or "").encode())) for i, t in rows)
    found = packing.op10_packing(spark, str(tmp_path))
    kinds = dict(found.dtypes)
    assert [kinds[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")] == ["bigint", "int", "bigint", "bigint", "bigint", "bigint", "bigint"]
    want = []
    for i, t in rows:
        whole = [*ids(WORD, t or ""), 0]
        want += [(i, k, a, len(whole[a : a + 2048]), zlib.crc32(raw(whole[a : a + 2048]))) for k, a in enumerate(range(0, len(whole), 2048))]
    assert sorted(tuple(r)[:5] for r in found.collect()) == sorted(want)


@pytest.mark.parametrize("ranges", [1, 2])
def test_rows_of_one_id_go_to_many_ranges(spark, frame, monkeypatch, ranges):
    monkeypatch.setattr(token_output, "RANGE_DOCS", 8)
    monkeypatch.setattr(token_output, "MAX_RANGES", 6 * ranges)
    rows = [(7, f"the same id {i % 3}") for i in range(60)] + [(i, f"text {i}") for i in range(5)]
    folder = token_output.write_tokens(frame(rows), BYTE, "byte", 0)
    found = sorted(token_output.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted(i for i, _ in rows)
    assert sorted((r.doc_id, bytes(r.ids)) for r in found) == sorted((i, np.array([*ids(BYTE, t), 0], "<u4").tobytes()) for i, t in rows)


def test_packing_deals_no_pieces_for_the_counts(spark, frame):
    from nearkin.llm import packing

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        places = packing.packed(frame([(i, "some words " * i) for i in range(30)]).repartition(7))
        plan = places._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert places.count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)

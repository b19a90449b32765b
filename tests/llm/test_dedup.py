import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from nearkin.llm import exact_dedup, simhash
from nearkin.llm.shared import Workspace, exclusive_prefix

from .conftest import ODD


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out, kept = [], set()
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        first = i == keep and (t or "") not in kept
        if first:
            kept.add(t or "")
        out.append((i, keep, len(ids), first, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def shape(df):
    return rows_of(df.selectExpr("doc_id", "keep_id", "group_size", "kept", "lower(hex(sha))"))


@pytest.mark.parametrize("bucket_keys", [1 << 20, 2])
def test_exact_dedup_equals_brute_force(odd, bucket_keys):
    assert shape(exact_dedup.exact_dedup(odd, bucket_keys=bucket_keys)) == brute_exact(ODD)


def test_exact_dedup_of_many_copies(frame):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["hot", "hot", f"t{rnd.randint(0, 60)}"])) for i in range(400)]
    assert shape(exact_dedup.exact_dedup(frame(rows), bucket_keys=5)) == brute_exact(rows)


def test_colliding_keys_are_chained(odd):
    rows = exact_dedup.exact_dedup(odd, bucket_keys=2, key_of=lambda t: F.lit(7).cast("long"))
    assert shape(rows) == brute_exact(ODD)
    _, index = exact_dedup.exact_groups(odd, bucket_keys=2, key_of=lambda t: F.pmod(F.length(t), F.lit(3)).cast("long"))
    chains = {}
    for r in index.collect():
        chains.setdefault(r.key, []).append((r.link, bytes(r.sha)))
    texts = {t or "" for _, t in ODD}
    assert sorted(x for c in chains.values() for _, x in c) == sorted(hashlib.sha256(t.encode()).digest() for t in texts)
    assert all(sorted(n for n, _ in c) == list(range(1, len(c) + 1)) for c in chains.values()) and max(map(len, chains.values())) > 1


def test_the_index_has_many_buckets_in_order(spark, frame):
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    entries, index = exact_dedup.exact_groups(frame(rows), bucket_keys=32)
    found = index.collect()
    assert len(found) == 700 and len({r.bucket for r in found}) > 16
    assert all(n <= 32 for n in Counter(r.bucket for r in found).values())
    unsigned = sorted((r.key % (1 << 64), r.bucket) for r in found)
    assert [b for _, b in unsigned] == sorted(b for _, b in unsigned)
    assert {(r.key, r.bucket) for r in entries.collect()} == {(r.key, r.bucket) for r in found}


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_directory_doubles_until_buckets_fit():
    rnd = random.Random(2)
    keys = Counter(rnd.randrange(64) if rnd.random() < 0.5 else rnd.randrange(4) for _ in range(500))
    slots = exact_dedup.build_directory(keys, 20, max_depth=6)
    width = 64 // len(slots)
    held = Counter()
    for slot, bucket, depth in slots:
        held[bucket] += sum(keys[k] for k in range(slot * width, (slot + 1) * width))
        assert sum(b == bucket for _, b, _ in slots) == len(slots) >> depth
    deepest = {b for _, b, d in slots if d == 6}
    assert all(n <= 20 or b in deepest for b, n in held.items()) and sum(held.values()) == 500
    assert [b for _, b, _ in slots] == sorted(b for _, b, _ in slots)
    assert exact_dedup.build_directory({}, 20, max_depth=6) == [(0, 0, 0)]


def test_prefix_sums_over_spans(spark):
    rows = [(i * 1000, i + 1) for i in range(30)]
    got = {r.k: r.before for r in exclusive_prefix(spark.createDataFrame(rows, "k long, n long"), "k", "n", "before").collect()}
    assert got == {k: sum(n for q, n in rows if q < k) for k, _ in rows}


# -- SimHash -----------------------------------------------------------------


def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=4):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= radius:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in parent}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_near_duplicates_equal_brute_force(odd):
    got = rows_of(simhash.near_duplicates(odd).select("doc_id", "fp", "component_id"))
    prints = [slow_print(t) for _, t in ODD]
    root = slow_components(prints)
    least = {}
    for (i, _), p in zip(ODD, prints, strict=True):
        least[root[p]] = min((x for x in (i, least.get(root[p])) if x is not None), default=None)
    assert got == sorted(((i, signed(p), least[root[p]]) for (i, _), p in zip(ODD, prints, strict=True)), key=repr)


def test_near_duplicates_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_changed_words_still_link(frame):
    rnd = random.Random(3)
    words = [f"w{rnd.randint(0, 500)}" for _ in range(2000)]
    near = words.copy()
    near[700] = "other"
    other = [f"v{rnd.randint(0, 500)}" for _ in range(2000)]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(other))]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(rows)).collect()}
    assert found == {5: 3, 3: 3, 9: 9}


def clustered(seed, bases=60):
    rnd = random.Random(seed)
    out = set()
    for _ in range(bases):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            for b in rnd.sample(range(64), rnd.randint(0, 3)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("extra", "chunk"), [(1, 1 << 14), (2, 1 << 14), (3, 1 << 14), (1, 7)])
def test_links_connect_what_is_near(spark, monkeypatch, extra, chunk):
    monkeypatch.setattr(simhash, "parts_for", lambda n, radius: extra)
    monkeypatch.setattr(simhash, "CHUNK_ROWS", chunk)
    prints = clustered(extra)
    work = Workspace(spark, "test")
    table = work.table(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), "prints")
    rows = simhash.components(simhash.links(table, len(prints), 4, work), work).collect()
    found = {r.node: r.root for r in rows}
    want = slow_components(prints)
    pairs = {(found.get(signed(p), signed(p)), want[p]) for p in prints}
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


def test_bit_slices_equal_popcounts():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    prints[100:200] = prints[:100] ^ (np.uint64(1) << rng.integers(0, 63, 100).astype(np.uint64))
    planes = simhash.planes_of(prints)
    for radius in (0, 1, 4, 7):
        who, word = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(5)))
        block, hits = simhash.near(prints, planes, who, word, radius)
        got = {(int(who[b]), 64 * int(word[b]) + r) for b, h in zip(block, hits, strict=True) for r in range(64) if int(h) >> r & 1}
        want = {(i, j) for i in range(300) for j in range(300) if (int(prints[i]) ^ int(prints[j])).bit_count() <= radius}
        assert {p for p in got if p[1] < 300} == want


def test_more_rows_ask_for_more_parts():
    assert [simhash.parts_for(n, 4) for n in (100, 10**6, 10**8, 10**11)] == sorted(simhash.parts_for(n, 4) for n in (100, 10**6, 10**8, 10**11))
    for extra in (1, 2, 3, 4):
        masks = simhash.table_masks(4, extra)
        rnd = random.Random(extra)
        for _ in range(200):
            a = rnd.getrandbits(64)
            b = a
            for bit in rnd.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    rnd = random.Random(5)
    rnd.shuffle(edges)
    found = simhash.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()
    assert {r.node: r.root for r in found} == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}

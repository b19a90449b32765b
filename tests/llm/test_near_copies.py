import random

import pytest

import corpus_pipeline
from nearkin.llm import near_copies, simhash
from nearkin.llm.shared import Workspace

from .conftest import ODD


def slow_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def slow_near(rows):
    held = [slow_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(held):
        for j, y in enumerate(held[:i]):
            if alike(x, y):
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
    return [(i, least[root(k)]) for k, (i, _) in enumerate(rows)]


def changed(seed, copies=25):
    """Short texts with few to many words changed, on both sides of the limit."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(12):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(4, 120))]
        for _ in range(rnd.choice([1, 2, copies])):
            words = base.copy()
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = f"v{rnd.randint(0, 400)}"
            if rnd.random() < 0.3:
                words += "all of this ends with one common line of words".split()
            rows.append((rnd.randint(0, 10**6), " ".join(words)))
    return rows


@pytest.mark.parametrize(("common", "rounds"), [(8, 2), (2, 0)])
def test_near_copies_equal_brute_force(frame, monkeypatch, common, rounds):
    monkeypatch.setattr(near_copies, "COMMON", common)
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    monkeypatch.setattr(near_copies, "PAIR_ROWS", 3)
    rows = [*ODD, *changed(common)]
    want = sorted(slow_near(rows), key=repr)
    assert len({c for _, c in want}) < len(want)
    got = near_copies.near_copies(frame(rows)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_stage_drops_copies_beyond_four_bits(spark, frame):
    rnd = random.Random(9)
    rows = []
    for i in range(40):
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(60)]
        rows.append((2 * i, " ".join(words)))
        words[rnd.randrange(5, 55)] = "other"
        rows.append((2 * i + 1, " ".join(words)))
    left = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, frame(rows, clash=False), "")
    assert sorted(r.doc_id for r in left.collect()) == [2 * i for i in range(40)]


def test_near_copies_of_nothing(empty):
    assert near_copies.near_copies(empty).count() == 0


def test_pairs_that_share_only_late_shingles_are_no_candidates(spark):
    rows = [(100 * part + key, node, 100, key + first, node) for part, first, nodes in ((1, 17, (1, 2)), (2, 0, (3, 4))) for node in nodes for key in range(8)]
    placed = spark.createDataFrame(rows, "key long, node long, n int, pos int, root long")
    assert [(r.a, r.b) for r in near_copies.candidates(placed, 0.8).collect()] == [(3, 4)]


def group(seed, rows, length=100):
    """Copies of one text, each with words of its own: half of them beyond the limit from it."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(length)]
    found = [(0, " ".join(base))]
    for i in range(1, rows):
        words = base.copy()
        for at in rnd.sample(range(length), rnd.randint(1, 6)):
            words[at] = f"own{i}x{at}"
        found.append((i, " ".join(words)))
    return found


def test_pairs_of_a_large_group_grow_with_its_rows(spark, frame):
    rows = group(3, 300)
    work = Workspace(spark, "test-group")
    got = near_copies.near_copies(frame(rows), work=work).select("doc_id", "component_id").collect()
    want = sorted(slow_near(rows))
    assert sorted(map(tuple, got)) == want and 50 < sum(c == 0 for _, c in want) < 250
    assert sum(spark.read.parquet(f"{work.path}/pairs-{turn}").count() for turn in range(near_copies.ROUNDS + 1)) < 5 * len(rows)


@pytest.mark.parametrize("rounds", [0, 1])
def test_crowded_shingles_lose_no_link(frame, monkeypatch, rounds):
    monkeypatch.setattr(near_copies, "CROWD", 2)
    monkeypatch.setattr(near_copies, "COMMON", 3)
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    without_middle = [(i, t) for i, t in group(5, 60, 60) if i]
    rows = [*changed(4), *((2 * 10**6 + i, t) for i, t in without_middle)]
    got = near_copies.near_copies(frame(rows)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(slow_near(rows))


def test_components_of_few_links_are_those_of_rounds(spark):
    rnd = random.Random(8)
    rows = [(rnd.randint(-60, 60), rnd.randint(-60, 60)) for _ in range(50)]
    work = Workspace(spark, "test-links")
    links = work.table(spark.createDataFrame(rows, "a long, b long"), "few")
    want = sorted(map(tuple, simhash.components(links, Workspace(spark, "test-rounds")).collect()))
    assert want and sorted(map(tuple, near_copies.joined(links, work, "test").collect())) == want

import random
from dataclasses import replace

import pytest

from nearkin.config import EngineConfig
from nearkin.operators import cooccurrence, events
from nearkin.streaming import ingest
from nearkin.streaming.ingest import ContextState

EVENTS = "ctx string, item_id string, score int, ts long, type string, seq long"
CONFIG = EngineConfig()


def frame(spark, rows):
    """(ctx, item, score, ts, type) rows in order of arrival."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], EVENTS)


def graph(df):
    return {(r.item1, r.item2): r.score for r in df.collect()}


def adds(ctx, pairs, ts=0):
    return [(ctx, item, score, ts, "ADD") for item, score in pairs]


def test_products_of_scores_are_symmetric(spark):
    e = frame(spark, adds("c", [("item1", 10), ("item2", 20), ("item3", 15)]))
    g = graph(cooccurrence.build_edges(e, CONFIG))
    assert g == {(a, b): s for x, y, s in [("item1", "item2", 200), ("item1", "item3", 150), ("item2", "item3", 300)] for a, b in ((x, y), (y, x))}


def test_contexts_add_up(spark):
    e = frame(spark, adds("c", [("a", 10), ("b", 20)]) + adds("d", [("a", 5), ("b", 10)]))
    assert graph(cooccurrence.build_edges(e, CONFIG))["a", "b"] == 250


@pytest.mark.parametrize(("first", "later", "half", "low", "high"), [(1000, 1100, 100, 49.99, 50.01), (0, 1000, 10, 0, 0.01), (7, 7, 10, 100, 100)])
def test_temporal_weight(spark, first, later, half, low, high):
    e = frame(spark, [("c", "a", 10, first, "ADD"), ("c", "b", 10, later, "ADD")])
    config = replace(CONFIG, temporal_cooccurrence=True, temporal_half_life_sec=half)
    assert low <= graph(cooccurrence.build_edges(e, config))["a", "b"] <= high


def test_deletion_counts_against_earlier_items(spark):
    e = frame(spark, [("c", "a", 5, 0, "ADD"), ("c", "b", 5, 0, "ADD"), ("c", "a", 0, 1, "DEL")])
    config = replace(CONFIG, negative_signals=True, negative_weight=10)
    assert graph(cooccurrence.build_edges(e, config))["a", "b"] == 25 - 50
    # a deletion after a deletion leaves a zero edge, which counts as a neighbour
    e = frame(spark, [("c", "a", 0, 0, "DEL"), ("c", "b", 0, 1, "DEL")])
    assert graph(cooccurrence.build_edges(e, config)) == {("a", "b"): 0, ("b", "a"): 0}


def edges(spark, rows):
    both = [r for a, b, s in rows for r in ((a, b, float(s)), (b, a, float(s)))]
    return spark.createDataFrame(both, "item1 string, item2 string, score double")


def test_decay_drops_small_edges(spark):
    e = edges(spark, [("a", "b", 20), ("a", "c", 100)])
    assert graph(cooccurrence.decay(e, 0.4, 10)) == {("a", "c"): 40, ("c", "a"): 40}
    assert graph(cooccurrence.decay(e, 0.0)) == {}
    assert len(graph(cooccurrence.decay(e, 1.5))) == 4


def test_prune_keeps_what_is_large_at_both_ends(spark):
    e = edges(spark, [("q", "a", 10), ("q", "b", 100), ("q", "c", 200), ("q", "d", 30)])
    assert set(graph(cooccurrence.prune(e, 2, 50))) == {("q", "b"), ("b", "q"), ("q", "c"), ("c", "q")}


def test_maintenance_equals_single_cycles(spark):
    rnd = random.Random(4)
    e = edges(spark, [(f"i{i}", f"j{j}", rnd.randint(1, 1000)) for i in range(5) for j in range(6)])
    config = replace(CONFIG, decay_alpha=0.8, min_support=30.0, max_neighbors_per_item=4)
    one = e
    for cycle in range(1, 13):
        one = cooccurrence.decay(one, 0.8, 30.0)
        if cycle % 10 == 0:
            one = cooccurrence.prune(one, 4, 30.0)
    got, want = graph(cooccurrence.maintain(e, config, 12)), graph(one)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_set_score_replaces_both_directions(spark):
    e = edges(spark, [("a", "b", 1)])
    new = spark.createDataFrame([("b", "a", 9.0), ("a", "z", 2.0)], "item1 string, item2 string, score double")
    assert graph(cooccurrence.set_scores(e, new)) == {("a", "b"): 9, ("b", "a"): 9, ("a", "z"): 2, ("z", "a"): 2}


def fold(rows, config):
    """Acceptance one event at a time: indexes of what is stored."""
    added, held, out = {}, {}, []
    for i, (ctx, item, score, ts, kind) in enumerate(rows, 1):
        if kind == "ADD":
            key = (ctx, item, score)
            if config.dedup_window_sec and key in added and ts <= added[key] + config.dedup_window_sec:
                continue
            added[key] = ts
        else:
            state = -1 if kind == "DEL" else score
            if held.get((ctx, item)) == state:
                continue
            held[ctx, item] = state
        out.append(i)
    return out


def random_rows(rnd, n):
    ts, out = 0, []
    for _ in range(n):
        ts += rnd.choice([0, 1, 5, 20, 61, -3])
        kind = rnd.choice(["ADD", "ADD", "SET", "DEL"])
        out.append((rnd.choice("xy"), rnd.choice("abc"), 0 if kind == "DEL" else rnd.choice([1, 2]), ts, kind))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_acceptance_equals_a_fold(spark, seed):
    rows = random_rows(random.Random(seed), 300)
    got = sorted(r.seq for r in events.accept(frame(spark, rows), CONFIG).collect())
    assert got == fold(rows, CONFIG)
    stats = events.event_stats(frame(spark, rows), CONFIG).first()
    assert (stats.total_events, stats.deduped_events) == (300, 300 - len(got))


def test_mixed_types(spark):
    rows = adds("c", [("item1", 10), ("item2", 10), ("item1", 10), ("item3", 10), ("item2", 10)])
    stats = events.event_stats(frame(spark, rows), CONFIG).first()
    assert (stats.total_events, stats.deduped_events, stats.stored_events) == (5, 2, 3)


def test_dedup_off(spark):
    rows = adds("c", [("a", 1)] * 3)
    assert events.accept(frame(spark, rows), replace(CONFIG, dedup_window_sec=0)).count() == 3
    assert events.accept(frame(spark, rows), replace(CONFIG, dedup_cache_size=0)).count() == 3


def test_validation_names_reasons(spark):
    rows = [("", "a", 1, 0, "ADD"), ("c", None, 1, 0, "ADD"), ("c", "a", 101, 0, "SET"), ("c", "a", -1, 0, "ADD"), ("c", "a", 500, 0, "DEL"), ("c", "a", 1, 0, "PUT")]
    good, bad = events.validate(frame(spark, rows))
    assert [(r.type, r.score) for r in good.collect()] == [("DEL", 0)]
    assert {r.reason for r in bad.collect()} == {"empty context", "empty item", "score out of range", "unknown type"}


def test_rank_spans_don_t_change_ranks(spark):
    e = frame(spark, random_rows(random.Random(9), 200))
    want = {(r.seq, r.rn) for r in events.arrival_rank(e).collect()}
    assert {(r.seq, r.rn) for r in events.arrival_rank(e, span=7).collect()} == want


def one_by_one(rows, buffer):
    ring, out = {}, {}
    for ctx, item, score, _, _ in rows:
        for old, s in ring.get(ctx, []):
            if old != item and s * score:
                for k in ((old, item), (item, old)):
                    out[k] = out.get(k, 0) + s * score
        ring[ctx] = [*ring.get(ctx, []), (item, score)][-buffer:]
    return out


@pytest.mark.parametrize("buffer", [1, 3, 50])
def test_graph_equals_events_one_by_one(spark, buffer):
    rnd = random.Random(buffer)
    rows = [(rnd.choice("xyz"), f"i{rnd.randint(0, 8)}", rnd.randint(0, 100), i, "ADD") for i in range(150)]
    config = replace(CONFIG, ctx_buffer_size=buffer)
    assert graph(cooccurrence.build_edges(frame(spark, rows), config)) == one_by_one(rows, buffer)


@pytest.mark.parametrize("seed", [5, 6])
def test_stream_state_equals_batch(spark, seed):
    rows = random_rows(random.Random(seed), 200)
    config = replace(CONFIG, ctx_buffer_size=4)
    kept, got = {}, []
    for ctx, item, score, ts, kind in rows:
        state = ContextState(config, kept.get(ctx))
        got += [(ctx, *p) for p in state.take(item, score, ts, kind)]
        kept[ctx] = state.text()
    want = cooccurrence.pairs(events.accept(frame(spark, rows), config), 4).collect()
    assert sorted(got) == sorted(map(tuple, want))


def test_stream_equals_batch_over_files(spark, tmp_path):
    from nearkin.streaming import ingest

    rows = random_rows(random.Random(8), 120)
    e = frame(spark, rows)
    for i in range(3):
        e.where(f"seq > {40 * i} and seq <= {40 * i + 40}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
        ingest.start(stream, CONFIG, f"{tmp_path}/deltas", f"{tmp_path}/checkpoint").awaitTermination()
    want = graph(cooccurrence.build_edges(events.accept(e, CONFIG), CONFIG))
    assert graph(ingest.edges(spark, f"{tmp_path}/deltas")) == want


def test_stream_state_gives_events_and_no_pairs():
    import pandas as pd

    from nearkin.streaming import ingest

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state, run = State(), ingest.folding(replace(CONFIG, ctx_buffer_size=20))
    for n in range(3):
        rows = pd.DataFrame({"item_id": [f"i{i}" for i in range(100)], "score": 5, "ts": range(1000 * n, 1000 * n + 100), "type": "ADD", "seq": range(100 * n, 100 * n + 100)})
        (out,) = run(("c",), iter([rows.iloc[50:], rows.iloc[:50]]), state)
        assert out["seq"].tolist() == list(range(-20 if n else 0, 100)) and out["type"].isna().sum() == (20 if n else 0)
        assert out["item_id"].tolist() == [f"i{i}" for i in [*(range(80, 100) if n else ()), *range(100)]]
    (out,) = run(("c",), iter([rows]), state)  # repeats only
    assert not len(out)


def test_empty_tables(spark):
    e = spark.createDataFrame([], EVENTS)
    assert events.accept(e, CONFIG).count() == 0
    assert cooccurrence.build_edges(e, CONFIG).count() == 0
    stats = events.event_stats(e, CONFIG).first()
    assert (stats.total_events, stats.stored_events) == (0, 0)


def test_repeats_are_found_over_batch_ends():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = sorted((f"c{rng.integers(3)}", f"i{rng.integers(2)}", int(rng.integers(2)), n) for n in range(200))
    times = [int(t) for t in np.where(np.arange(200) < 100, np.arange(200) * 7, rng.integers(0, 900, 200))]
    want, last = [], {}
    for *key, n in rows:
        k = tuple(key)
        dup = k in last and times[n] <= last[k] + 30
        want.append(dup)
        if not dup:
            last[k] = times[n]
    names = ["ctx", "item_id", "score", "ts", "type", "seq"]
    whole = pa.RecordBatch.from_pydict(dict(zip(names, [*map(list, zip(*[r[:3] for r in rows], strict=True)), [times[r[3]] for r in rows], ["ADD"] * 200, [r[3] for r in rows]], strict=True)))
    for size in (1, 3, 50, 200):
        parts = [whole.slice(i, size) for i in range(0, 200, size)]
        assert [d for b in events.scan_adds(30)(iter(parts)) for d in b.column("dup").to_pylist()] == want


def test_batches_are_folded_into_a_fading_graph(spark, tmp_path):
    folder = f"file://{tmp_path}/deltas"
    config = EngineConfig(decay_interval_sec=10, decay_alpha=0.5)

    def batch(n, rows):
        spark.createDataFrame([r for a, b, s in rows for r in ((a, b, s), (b, a, s))], "item1 string, item2 string, score double").write.mode("overwrite").parquet(f"{folder}/batch={n}")

    graph = lambda: {(r.item1, r.item2): r.score for r in ingest.edges(spark, folder).collect() if r.item1 < r.item2}
    batch(0, [("a", "b", 8.0)])
    batch(1, [("a", "b", 4.0), ("a", "c", 2.0)])
    assert graph() == {("a", "b"): 12.0, ("a", "c"): 2.0}
    ingest.fold(spark, folder, config, 100)
    assert graph() == {("a", "b"): 12.0, ("a", "c"): 2.0} and ingest.generation(spark, folder) == (1, 0, 100, 0)
    batch(1, [("a", "b", 4.0), ("a", "c", 2.0)])  # the newest batch may be run again
    batch(2, [("b", "c", 1.0)])
    ingest.fold(spark, folder, config, 125)
    assert graph() == {("a", "b"): 3.0, ("a", "c"): 0.5, ("b", "c"): 1.0} and ingest.generation(spark, folder) == (2, 1, 120, 2)
    ingest.fold(spark, folder, config, 131)
    assert graph() == {("a", "b"): 1.5, ("a", "c"): 0.25, ("b", "c"): 1.0}
    assert sorted(p.name for p in (tmp_path / "deltas").iterdir()) == ["batch=2", "graph"]

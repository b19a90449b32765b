from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearkin.config import EngineConfig, EngineError
from nearkin.engine import Engine
from nearkin.functions import vector as V
from nearkin.functions.meta import meta_map, typed
from nearkin.operators import ann, blocks, filters, search, vectors

CONFIG = EngineConfig()


def store(spark, held):
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in held.items()], "id string, vec array<float>")
    return df.withColumn("norm", V.norm(F.col("vec")))


def edges(spark, rows):
    both = [r for a, b, s in rows for r in ((a, b, float(s)), (b, a, float(s)))]
    return spark.createDataFrame(both, "item1 string, item2 string, score double")


def got(df, digits=4):
    return [(r.item_id, round(r.score, digits)) for r in df.collect()]


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0])], "a array<float>, b array<float>")
    row = df.select(V.dot(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("a")), V.l2_distance(F.col("a"), F.col("b")), V.dot(F.col("a"), F.array(F.lit(1.0)))).first()
    assert row[0] == 32 and abs(row[1] - 1) < 1e-9 and abs(row[2] - 27**0.5) < 1e-9 and row[3] == 0
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    row = zero.select(V.cosine(F.col("a"), F.col("b")), V.normalized(F.col("a"))).first()
    assert row[0] == 0 and row[1] is None


def test_l2_ranks_near_first(spark):
    v = store(spark, {"q": [0, 0, 0], "near": [1, 0, 0], "far": [10, 0, 0]})
    assert got(search.by_item_vector(v, "q", 5, replace(CONFIG, distance_metric="l2"))) == [("near", 0.5), ("far", 0.0909)]


def test_ties_are_in_order_of_ids(spark):
    v = store(spark, {"q": [1, 0], **{c: [1, 0] for c in "dbca"}})
    assert [r[0] for r in got(search.by_item_vector(v, "q", 3, CONFIG))] == ["a", "b", "c"]
    assert [r[0] for r in got(search.by_events(edges(spark, [("q", c, 5) for c in "dbca"]), "q", 3, CONFIG))] == ["a", "b", "c"]


def test_unknown_items(spark):
    v, e = store(spark, {"a": [1, 0]}), edges(spark, [("x", "y", 1)])
    assert got(search.by_events(e, "none", 5, CONFIG)) == []
    with pytest.raises(EngineError):
        search.by_item_vector(v, "none", 5, CONFIG)
    with pytest.raises(EngineError):
        search.by_fusion(e, v, "none", 5, CONFIG)
    assert got(search.by_fusion(e, v, "x", 5, CONFIG)) == [("y", 1.0)]


@pytest.mark.parametrize("k", [0, -1, 10000])
def test_top_k_is_checked(spark, k):
    with pytest.raises(EngineError):
        search.by_events(edges(spark, [("a", "b", 1)]), "a", k, CONFIG)


@pytest.mark.parametrize("query", [[], [float("nan"), 1.0], [0.0, 0.0]])
def test_query_vectors_are_checked(spark, query):
    with pytest.raises(EngineError):
        search.by_vector(store(spark, {"a": [1, 0]}), query, 3, CONFIG)


def test_fusion_with_one_event_row(spark):
    v = store(spark, {"q": [1, 0, 0], "event_winner": [0.8, 0.6, 0], "vector_winner": [1, 0, 0]})
    e = edges(spark, [("q", "event_winner", 10), ("q", "vector_winner", 0)])
    found = dict(got(search.by_fusion(e, v, "q", 5, replace(CONFIG, fusion_alpha=0.25, fusion_beta=0.75))))
    assert found == {"event_winner": 0.75, "vector_winner": 0.25}


def test_fusion_of_equal_vectors_without_events(spark):
    v = store(spark, {c: [1, 1] for c in "qab"})
    assert got(search.by_fusion(edges(spark, [("x", "y", 1)]), v, "q", 5, CONFIG)) == [("a", 1.0), ("b", 1.0)]


def test_adaptive_weights_follow_neighbours(spark):
    v = store(spark, {"q": [1, 0], "a": [1, 0], "b": [0, 1]})
    config = replace(CONFIG, adaptive_fusion=True, adaptive_maturity=10)
    few = dict(got(search.by_fusion(edges(spark, [("q", "b", 5), ("q", "a", 1)]), v, "q", 5, config)))
    assert few["a"] == round(0.9 - 0.2 * 0.7, 4) and few["b"] == round(0.1 + 0.2 * 0.7, 4)
    many = edges(spark, [("q", "b", 50), ("q", "a", 1), *(("q", f"n{i}", 2) for i in range(20))])
    assert dict(got(search.by_fusion(many, v, "q", 30, config)))["b"] == 0.8


def test_min_score_comes_after_the_limit(spark):
    v = store(spark, {"q": [1, 0], "a": [1, 0.1], "b": [-1, 0]})
    assert [r[0] for r in got(search.min_score(search.by_item_vector(v, "q", 5, CONFIG)))] == ["a"]
    assert len(got(search.min_score(search.by_item_vector(v, "q", 5, CONFIG), None))) == 2


def brute(v, metric, k):
    out = {}
    for q, x in v.items():
        rows = []
        for i, y in v.items():
            if i != q:
                a, b = np.array(x, float), np.array(y, float)
                n = np.linalg.norm(a) * np.linalg.norm(b)
                s = {"dot": a @ b, "cosine": a @ b / n if n else 0.0, "l2": 1 / (1 + np.linalg.norm(a - b))}[metric]
                rows.append((-round(s, 9), i))
        out[q] = [i for _, i in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_batch_search_equals_brute_force(spark, metric, monkeypatch):
    rng = np.random.default_rng(3)
    held = {f"v{i}": np.float32(rng.normal(size=5)).tolist() for i in range(40)}
    held |= {"same1": held["v0"], "same2": held["v0"], "zero": [0.0] * 5}
    v = store(spark, held)
    rows = blocks.batch_vectors(v, v, 4, metric).orderBy("query_id", "rank").collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append(r.item_id)
    assert found == brute(held, metric, 4)


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_batch_search_holds_one_group_and_one_batch(spark, metric, monkeypatch):
    # rows reach a task as a stream and in many groups; all of one width, some of them copies, ids repeated
    monkeypatch.setattr(blocks, "LEAST_GROUP", 7)
    monkeypatch.setattr(blocks, "LEAST_PART", 11)
    rng = np.random.default_rng(5)
    held = {f"v{i}": np.float32(rng.normal(size=6) * (i % 5)).tolist() for i in range(90)}
    held |= {f"copy{i}": held["v3"] for i in range(30)}
    v = store(spark, held)
    rows = blocks.batch_vectors(v, v, 4, metric)
    found = {}
    for r in rows.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.item_id)
    assert found == brute(held, metric, 4)
    for some in ({"v1", "copy7"}, set(held)):
        asked = v.where(v.id.isin(*some))
        got = blocks.batch_vectors(v, asked, 4, metric).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.item_id) for r in got] == [(q, i) for q in sorted(some) for i in brute(held, metric, 4)[q]]
    best = blocks.Best(["q", "a"], np.array([[1.0, 0.0], [0.0, 1.0]]), 1, metric)
    for ids, x in ((["a", "a", "b"], [[9.0, 0.0], [8.0, 0.0], [1.0, 0.5]]), (["q"], [[1.0, 0.0]])):
        best.add(np.array(ids, object), np.array(x))
    want = {"cosine": ["a", "b"], "dot": ["a", "b"], "l2": ["b", "b"]}[metric]
    assert best.items.ravel().tolist() == want
    for n in (10**5, 10**6):
        ((_, _, groups, parts, _),) = blocks.dealing([(0, 64, n, n)])
        assert n / groups <= blocks.MOST_GROUP and groups * parts >= 30


def test_batch_search_of_other_widths(spark):
    v = store(spark, {"a": [1, 0], "b": [1, 1], "c": [1, 0, 0]})
    assert {(r.query_id, r.item_id) for r in blocks.batch_vectors(v, v, 5).collect()} == {("a", "b"), ("b", "a")}


def test_all_cells_equal_exact_search(spark):
    rng = np.random.default_rng(42)
    held = {f"v{i:03}": np.float32(rng.normal(size=16)).tolist() for i in range(200)}
    v = store(spark, held)
    for metric in ("cosine", "dot", "l2"):
        config = replace(CONFIG, distance_metric=metric, ivf_nprobe=8)
        centroids = ann.train(v, metric, 8)
        celled = ann.assign(v, centroids, metric)
        assert celled.count() == 200 and celled.select("cell").distinct().count() > 1
        exact = got(search.by_item_vector(v, "v007", 10, config))
        assert got(ann.cell_search(celled, centroids, held["v007"], 10, config, without="v007")) == exact
        every = ann.batch_cell_search(celled, centroids, v.where("id = 'v007'"), 10, config)
        assert [r.item_id for r in every.orderBy("rank").collect()] == [i for i, _ in exact]


def test_probing_some_cells_finds_most(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(10, 16))
    held = {f"v{i:03}": (base[i % 10] + rng.normal(size=16) * 0.1).tolist() for i in range(300)}
    v = store(spark, held)
    config = replace(CONFIG, ivf_nprobe=3)
    centroids = ann.train(v, "cosine", 10)
    celled = ann.assign(v, centroids, "cosine")
    hits = 0
    for q in ("v000", "v005", "v019", "v123"):
        exact = {i for i, _ in got(search.by_item_vector(v, q, 10, config))}
        hits += len(exact & {i for i, _ in got(ann.cell_search(celled, centroids, held[q], 10, config, without=q))})
    assert hits / 40 >= 0.8


def test_quantised_search_recalls(spark):
    rng = np.random.default_rng(42)
    held = {f"v{i:03}": rng.uniform(-1, 1, 64).tolist() for i in range(500)}
    v = store(spark, held).coalesce(1).cache()
    codes = ann.quantized(v, ann.quantizer(v)).cache()
    hits = 0
    for _ in range(20):
        query = rng.uniform(-1, 1, 64).tolist()
        exact = {r[0] for r in got(search.by_vector(v, query, 10, CONFIG))}
        hits += len(exact & {r[0] for r in got(ann.quantized_search(codes, query, 10))})
    assert hits / 200 >= 0.98
    flat = store(spark, {"a": [1.0, 5.0], "b": [1.0, 9.0]})
    assert {tuple(r.codes) for r in ann.quantized(flat, ann.quantizer(flat)).collect()} == {(128, 0), (128, 255)}


def test_tiers_and_buffers_hide_older_rows(spark):
    main, delta = store(spark, {"a": [1, 0], "b": [0, 1]}), store(spark, {"b": [1, 1], "c": [1, 0]})
    rows = {r.id: list(r.vec) for r in ann.tiered(main, delta, store(spark, {"a": [0, 0]})).collect()}
    assert rows == {"b": [1, 1], "c": [1, 0]}
    assert ann.merge_due(100, 10) and not ann.merge_due(100, 9) and ann.merge_due(10**9, 50_000)


def test_store_follows_the_last_change(spark):
    log = spark.createDataFrame([("a", [1.0], 1), ("a", [2.0], 3), ("b", [1.0], 2), ("b", None, 4), ("c", None, 1), ("c", [5.0], 2)], "id string, vec array<float>, seq long")
    assert {r.id: list(r.vec) for r in vectors.vector_store(log).collect()} == {"a": [2.0], "c": [5.0]}
    with pytest.raises(EngineError):
        vectors.check_dimension(log.unionByName(spark.createDataFrame([("d", [1.0, 2.0], 9)], log.schema)))


# -- filters -----------------------------------------------------------------


def test_filter_text():
    parsed = filters.parse_filter("rating>=4.5,count<10,status!=archived,category=in(books|music)")
    assert [(c.field, c.op, c.values) for c in parsed] == [("rating", "ge", (4.5,)), ("count", "lt", (10,)), ("status", "ne", ("archived",)), ("category", "in", ("books", "music"))]
    assert filters.parse_filter("url:http://example.com")[0].values == ("http://example.com",)
    assert len(filters.parse_filter("status:active,")) == 1 and filters.parse_filter("") == []


@pytest.mark.parametrize("text", ["invalidformat", ":value", "key:", "a:in(x||y)"])
def test_bad_filter_text(text):
    with pytest.raises(EngineError):
        filters.parse_filter(text)


@pytest.mark.parametrize(("text", "value"), [("true", True), ("7", 7), ("-3", -3), ("1.5", 1.5), ("1e3", 1000.0), ("nan", "nan"), ("0x1f", "0x1f"), ("inf", "inf"), ("x1", "x1"), (str(2**63), float(2**63))])
def test_value_types(text, value):
    read = filters.read_value(text)
    assert read == value and type(read) is type(value)


FILTERS = [
    ("price>10.5", {"int11"}),
    ("count:42", set()),
    ("text:42", set()),
    ("status!=deleted", {"int11", "int10", "text", "flag"}),
    ("price!=abc", {"text", "flag"}),
    ("flag>false", {"flag"}),
    ("text>=b", {"text"}),
    ("price:in(10|x)", {"int10"}),
]


@pytest.mark.parametrize(("text", "want"), FILTERS)
def test_filter_meaning(spark, text, want):
    rows = {"int11": {"price": typed("i", F.lit(11))}, "int10": {"price": typed("d", F.lit(10.0))}, "text": {"text": typed("s", F.lit("cat")), "count": typed("s", F.lit("42"))}, "flag": {"flag": typed("b", F.lit(True))}}
    one = spark.range(1)
    meta = None
    for k, v in rows.items():
        row = one.select(F.lit(k).alias("id"), meta_map(v).alias("meta"))
        meta = row if meta is None else meta.unionByName(row)
    items = spark.createDataFrame([(k,) for k in [*rows, "bare"]], "item_id string")
    assert {r.item_id for r in filters.keep_matching(items, meta, text).collect()} == want


# -- engine ------------------------------------------------------------------


def test_commands_end_to_end(spark, tmp_path):
    e = Engine(spark, replace(CONFIG, fusion_alpha=0.5, fusion_beta=0.5, cache_min_query_cost_ms=0))
    for i, score in enumerate((100, 90, 80, 70, 60)):
        e.execute(f"EVENT user ADD item{i} {score} timestamp={1000 + i}")
    for i, v in enumerate(("1 0 0", "0.9 0.1 0", "0.5 0.5 0", "0 1 0", "0 0 1")):
        e.execute(f"vecset item{i} {v}")
    e.execute("METASET item1 kind:book,price:12.5")
    assert got(e.execute("SIM item0 1 using=events")) == [("item1", 9000.0)]
    assert got(e.execute("SIM item0 2 using=vectors"))[0][0] == "item1"
    assert got(e.execute("SIM item0 3"))[0] == ("item1", 1.0)
    assert [r[0] for r in got(e.execute("SIM item0 5 filter=kind:book,price>12"))] == ["item1"]
    assert [r[0] for r in got(e.execute("SIMV 1 0 0 1"))] == ["item4"]
    info = e.execute("INFO").first()
    assert (info.ctx_count, info.event_count, info.vector_count, info.metadata_count, info.id_count, info.pair_count) == (1, 5, 5, 1, 5, 10)
    before = got(e.execute("SIM item0 5"))
    e.execute(f"DUMP SAVE {tmp_path}/snap")
    assert all(r.ok for r in e.execute(f"DUMP VERIFY {tmp_path}/snap").collect())
    other = Engine(spark, e.config)
    other.execute(f"DUMP LOAD {tmp_path}/snap")
    assert got(other.execute("SIM item0 5")) == before
    e.execute("VECDEL item4")
    assert "item4" not in dict(got(e.execute("SIM item0 5 using=vectors min_score=-1")))
    with pytest.raises(EngineError):
        e.execute("VECDEL item4")
    first = e.answer("item0", 3)
    assert e.answer("item0", 3) == first and e.cache.hits == 1
    e.execute("EVENT user ADD item9 50 timestamp=2000")
    assert "item9" in dict(e.answer("item0", 10)) and e.cache.hits == 1
    e.execute("SET cache.enabled = off")
    assert {r.name: r.value for r in e.execute("SHOW VARIABLES LIKE 'cache.%'").collect()}["cache.enabled"] == "False"


@pytest.mark.parametrize("line", ["", "NOPE", "SIM a", "SIM a x", "SIM a 3 explain=on", "SIM a 3 using=magic", "SIMV 3", "EVENT c ADD i 101", "EVENT c ADD i", "EVENT c PUT i 1", "SIM a 1\nSIM b 1", "SIM\0 a 1", "SIMV 3 1 nan", "SET events.size = 3"])
def test_bad_commands(spark, line):
    with pytest.raises(EngineError):
        Engine(spark).execute(line)


def test_settings_are_checked():
    with pytest.raises(EngineError):
        EngineConfig(decay_alpha=2, distance_metric="hamming").validate()
    assert CONFIG.validate() is CONFIG


def test_cells_as_an_index(spark):
    rng = np.random.default_rng(1)
    v = store(spark, {f"v{i}": rng.normal(size=8).tolist() for i in range(60)})
    exact = Engine(spark).load_vectors(v)
    for kind in ("ivf", "hnsw"):
        e = Engine(spark, replace(CONFIG, index_type=kind, ivf_nlist=4, ivf_nprobe=4)).load_vectors(v)
        assert got(e.sim("v3", 5, using="vectors")) == got(exact.sim("v3", 5, using="vectors"))


def graph_of(e):
    return {(r.item1, r.item2): r.score for r in e.edges.collect()}


def test_decay_outlives_the_next_event(spark):
    e = Engine(spark, replace(CONFIG, decay_alpha=0.5))
    e.event("c", "ADD", "a", 10, 1000)
    e.event("c", "ADD", "b", 20, 1001)
    assert graph_of(e.maintain()) == {("a", "b"): 100.0, ("b", "a"): 100.0}
    e.event("d", "ADD", "x", 50, 2000)
    assert graph_of(e.flush()) == {("a", "b"): 100.0, ("b", "a"): 100.0}
    e.event("c", "ADD", "z", 1, 2001)
    assert graph_of(e.flush())[("z", "a")] == 10.0 and graph_of(e)[("b", "a")] == 100.0


def test_set_scores_and_snapshots_outlive_the_next_event(spark, tmp_path):
    e = Engine(spark)
    e.event("c", "ADD", "a", 10, 1000)
    e.event("c", "ADD", "b", 20, 1001)
    e.set_scores(spark.createDataFrame([("a", "b", 7.0)], "item1 string, item2 string, score double"))
    e.save(f"{tmp_path}/snap")
    other = Engine(spark).load(f"{tmp_path}/snap")
    for engine in (e, other):
        engine.event("c", "ADD", "z", 1, 1002)
        assert graph_of(engine.flush()) == {("a", "b"): 7.0, ("b", "a"): 7.0, ("a", "z"): 10.0, ("z", "a"): 10.0, ("b", "z"): 20.0, ("z", "b"): 20.0}


def test_events_one_by_one_give_the_graph_of_all(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{rng.integers(3)}", ["ADD", "ADD", "SET", "DEL"][rng.integers(4)], f"i{rng.integers(6)}", int(rng.integers(0, 100)), 1000 + 40 * i) for i in range(60)]
    config = replace(CONFIG, ctx_buffer_size=4, negative_signals=True, temporal_cooccurrence=True, temporal_half_life_sec=100.0)
    e = Engine(spark, config)
    for i, r in enumerate(rows):
        e.event(*r)
        if i % 17 == 16:
            e.flush()
    whole = Engine(spark, config).load_events(spark.createDataFrame([(c, i, 0 if k == "DEL" else s, t, k, n) for n, (c, k, i, s, t) in enumerate(rows, 1)], "ctx string, item_id string, score int, ts long, type string, seq long"))
    got_, want = graph_of(e.flush()), graph_of(whole)
    assert got_.keys() == want.keys() and all(abs(got_[k] - want[k]) < 1e-6 for k in want)
    assert e.events.count() == whole.events.count()


def test_limits_hold_as_events_come(spark):
    e = Engine(spark, replace(CONFIG, max_neighbors_per_item=2, max_contexts=2))
    for i in range(6):
        e.event("c", "ADD", f"i{i}", 10 + i, 1000 + i)
    for i in range(4):
        e.event(f"late{i}", "ADD", "i0", 5, 2000 + i)
    e.flush()
    counts = {}
    for a, _ in graph_of(e):
        counts[a] = counts.get(a, 0) + 1
    assert max(counts.values()) <= 2 and {r.ctx for r in e.events.collect()} == {"late2", "late3"}


def test_bad_vectors_are_refused(spark):
    e = Engine(spark)
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [float("nan"), 1.0]), ("c", [0.5, 0.5]), ("d", None), ("e", [])], "id string, vec array<float>")
    assert {r.id for r in e.load_vectors(rows).vectors.collect()} == {"a", "c"}
    with pytest.raises(EngineError):
        e.set_vector("x", [float("nan"), 1.0])
    e.set_vector("x", [1.0, 2.0, 3.0])
    with pytest.raises(EngineError):
        e.flush()
    with pytest.raises(EngineError):
        e.load_vectors(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "id string, vec array<float>"))


def test_the_log_brings_the_stores_back(spark, tmp_path):
    folder = f"file://{tmp_path}/engine"
    e = Engine(spark, replace(CONFIG, decay_alpha=0.5), folder)
    for i in range(5):
        e.event("c", "ADD", f"i{i}", 10 + i, 1000 + i)
    e.event("c", "ADD", "i4", 14, 1005)  # a repeat
    e.set_vector("i0", [1.0, 0.0])
    e.set_vector("i1", [0.0, 1.0])
    e.set_metadata("i0", {"kind": "x"})
    e.maintain()
    e.event("c", "ADD", "late", 3, 1010)
    e.delete_vector("i1")
    e.flush()
    other = Engine(spark, e.config, folder).recover()
    assert graph_of(other) == graph_of(e) and other.seq == e.seq
    assert {r.id for r in other.vectors.collect()} == {"i0"} and other.metadata.count() == 1 and other.events.count() == e.events.count()
    e.save(f"{tmp_path}/snap")
    e.event("d", "ADD", "after", 3, 1020)
    e.event("d", "ADD", "i0", 3, 1021)
    e.flush()
    again = Engine(spark, e.config, folder).recover(f"{tmp_path}/snap")
    assert graph_of(again) == graph_of(e) and again.events.count() == e.events.count()


def test_automatic_snapshots_are_kept_to_a_number(spark, tmp_path):
    e = Engine(spark, replace(CONFIG, snapshot_retain=2))
    e.set_vector("a", [1.0])
    (tmp_path / "mine").mkdir()
    paths = [e.save_automatic(str(tmp_path)) for _ in range(3)]
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(["mine", *(p.rsplit("/", 1)[1] for p in paths[1:])])


def test_cells_buffer_and_seal(spark):
    rng = np.random.default_rng(1)
    held = {f"v{i}": np.float32(rng.normal(size=8)).tolist() for i in range(80)}
    config = replace(CONFIG, index_type="ivf", ivf_nlist=4, ivf_nprobe=4, ivf_train_threshold=50, ivf_seal_threshold=3)
    e, exact = Engine(spark, config).load_vectors(store(spark, held)), Engine(spark).load_vectors(store(spark, held))
    assert got(e.sim("v3", 5, using="vectors")) == got(exact.sim("v3", 5, using="vectors"))
    for engine in (e, exact):
        engine.set_vector("v4", held["v3"])
        engine.delete_vector("v5")
    assert e.flush().cells.buffer is not None
    assert got(e.sim("v3", 80, using="vectors", min_score=None)) == got(exact.sim("v3", 80, using="vectors", min_score=None))
    for engine in (e, exact):
        engine.set_vector("new", held["v6"])
        engine.flush()
    assert e.cells.buffer is None and e.cells.celled.count() == 80
    assert got(e.sim("v3", 80, using="vectors", min_score=None)) == got(exact.sim("v3", 80, using="vectors", min_score=None))


def test_trained_cells_reach_their_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 16))
    v = store(spark, {f"v{i:03}": (base[i % 20] + rng.normal(size=16) * 0.3).tolist() for i in range(600)})
    index = ann.CellIndex.build(v, CONFIG, iter_folders(spark))
    config = replace(CONFIG, ivf_nprobe=ann.tuned_probes(v, index.centroids, "cosine"))
    assert config.ivf_nprobe < len(index.centroids)
    found = ann.batch_cell_search(index.celled, index.centroids, v.where("id like '%0'"), 10, config)
    row = ann.recall(found, blocks.batch_vectors(v, v.where("id like '%0'"), 10)).first()
    assert row.queries == 60 and row.recall >= 0.9


def iter_folders(spark):
    from nearkin.sources import scratch

    return lambda: scratch.shared(spark, "cells")


def test_requests_in_json_and_debug(spark):
    e = Engine(spark)
    e.request("vecset", '{"id": "a", "vector": [1, 0], "metadata": {"kind": "x"}}')
    e.request("vecset", '{"id": "b", "vector": [1, 1]}')
    e.request("event", '{"ctx": "c", "id": "a", "type": "add", "score": 3, "timestamp": 5}')
    assert got(e.request("simv", '{"vector": [1, 0], "top_k": 2}'))[0] == ("a", 1.0)
    assert got(e.request("sim", '{"id": "b", "mode": "vectors", "filter": "kind:x"}'))[0][0] == "a"
    for route, body in (("event", '{"ctx": "c", "id": "a", "type": "add", "score": 1.5}'), ("event", "{}"), ("sim", "[]"), ("sim", "{"), ("nope", "{}"), ("metaset", '{"id": "a", "metadata": {"k": null}}')):
        with pytest.raises(EngineError):
            e.request(route, body)
    e.execute("DEBUG ON")
    e.execute("SIM a 1 using=vectors")
    assert {r.name for r in e.execute("DEBUG SHOW").collect()} == {"mode", "query_time_us", "candidates", "results"}
    assert {r.name: r.value for r in e.execute("CONFIG HELP").collect()}["ivf_nprobe"].startswith("int, 8")

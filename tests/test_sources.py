from dataclasses import replace

import pytest

from nearkin.config import EngineConfig, EngineError
from nearkin.operators import cooccurrence
from nearkin.plans.cache import ResultCache, cache_key
from nearkin.sources import changelog, snapshot, tables

CONFIG = EngineConfig()


def log(spark, rows):
    return changelog.sealed(spark.createDataFrame(rows, "seq long, op string, id string, vec array<float>, ctx string, item_id string, score int, ts long, type string"))


def vec(seq, item, v):
    return (seq, "VECSET" if v else "VECDEL", item, v, None, None, None, None, None)


def event(seq, ctx, item, score):
    return (seq, "EVENT", None, None, ctx, item, score, seq, "ADD")


def test_snapshot_round_trip(spark, tmp_path):
    path = f"{tmp_path}/s"
    stores = {"vectors": spark.createDataFrame([("a", [1.0, 2.0])], "id string, vec array<float>"), "edges": spark.createDataFrame([], "item1 string, item2 string, score double")}
    snapshot.save(stores, path, 5, 17)
    loaded, seq = snapshot.load(spark, path)
    assert seq == 17 and loaded["vectors"].collect() == stores["vectors"].collect() and loaded["edges"].count() == 0
    assert {r.store: r.rows for r in snapshot.info(spark, path).collect()} == {"vectors": 1, "edges": 0}
    with pytest.raises(Exception, match="already exists"):
        snapshot.save(stores, path, 6)
    stores["vectors"].write.mode("append").parquet(f"{path}/vectors")
    assert {r.store: r.ok for r in snapshot.verify(spark, path).collect()} == {"vectors": False, "edges": True}
    with pytest.raises(EngineError, match="vectors"):
        snapshot.load(spark, path)


def test_retention_spares_other_names():
    assert snapshot.retain(["auto_3", "mine", "auto_1", "auto_2"], 2) == ["auto_1"]
    assert snapshot.retain(["auto_1"], 0) == []


def test_log_is_checked_and_replayed(spark, tmp_path):
    path = f"{tmp_path}/log"
    rows = [vec(1, "a", [1.0]), event(2, "c", "x", 2), vec(3, "a", None), vec(4, "b", [3.0]), event(5, "c", "y", 3), event(6, "c", "x", 2)]
    changelog.append(log(spark, rows[:3]), path, 1)
    changelog.append(log(spark, rows[3:]), path, 2)
    whole = changelog.read(spark, path)
    assert changelog.check(whole) == 6 and changelog.check(changelog.read(spark, path, 4)) == 6
    stores = changelog.replay(whole, CONFIG)
    assert [r.id for r in stores["vectors"].collect()] == ["b"]
    assert {(r.item1, r.item2): r.score for r in stores["edges"].collect()} == {("x", "y"): 12, ("y", "x"): 12}
    assert [r.segment for r in changelog.truncatable(whole, 4).collect()] == ["00000001"]
    assert changelog.truncatable(whole, 2).count() == 0 and changelog.truncatable(whole, 99).count() == 1
    with pytest.raises(EngineError, match="gaps"):
        changelog.check(whole.where("seq <> 3"))
    with pytest.raises(EngineError, match="damaged"):
        changelog.check(whole.withColumn("crc", whole["crc"] + 1))


def test_replay_on_a_snapshot_equals_replay_of_all(spark):
    config = replace(CONFIG, decay_alpha=0.5, ctx_buffer_size=3)
    rows = [event(i, "c" if i % 3 else "d", f"i{i % 5}", i) for i in range(1, 12)]
    rows[6] = (7, "MAINTAIN", *[None] * 7)
    whole = changelog.replay(log(spark, rows), config)["edges"]
    early = changelog.replay(log(spark, rows[:5]), config)
    late = changelog.replay(log(spark, rows[5:]), config, early)["edges"]
    same = lambda df: sorted((r.item1, r.item2, round(r.score, 6)) for r in df.collect())
    assert same(late) == same(whole) and len(same(whole)) > 5
    plain = cooccurrence.build_edges(log(spark, [r for r in rows if r[1] == "EVENT"]).select("ctx", "item_id", "score", "ts", "type", "seq"), config)
    assert same(plain) != same(whole)


def test_json_events(spark):
    lines = spark.createDataFrame([(1, '{"ctx":"u","id":"i","type":"add","score":5,"timestamp":9}'), (2, '{"ctx":"u","id":"i","type":"ADD","score":1.5}'), (3, "broken")], "seq long, value string")
    rows = {r.seq: r for r in tables.events_from_json(lines).collect()}
    assert (rows[1].score, rows[1].type, rows[1].ts) == (5, "ADD", 9) and rows[2].score is None and rows[3].ctx is None


def test_cache_policy():
    now = [0.0]
    c = ResultCache(2, 100, 10, clock=lambda: now[0])
    c.put("cheap", [1], 1, "item")
    c.put("vector", [1], 99, "vector")
    assert c.get("cheap") is None and c.get("vector") is None
    c.put("a", [1], 99, "item", frozenset("x"))
    c.put("f", [2], 99, "filtered")
    now[0] = 61
    assert c.get("a") == [1] and c.get("f") is None
    c.put("b", [2], 99, "item", frozenset("y"))
    c.get("a")
    c.put("c", [3], 99, "item")
    assert c.get("b") is None and c.get("a") == [1]
    assert c.invalidate("x") == 1 and c.get("a") is None
    now[0] = 500
    assert c.purge() == 1
    assert cache_key(1, "a") != cache_key("1", "a")

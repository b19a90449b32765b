"""Registered queries: the engine's operators over the given tables.

Each takes (spark, folder). ``plans.oracles`` has their SQL.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin import engine
from nearkin.config import EngineConfig
from nearkin.functions import vector as V
from nearkin.functions.meta import meta_map, typed
from nearkin.operators import ann, blocks, cooccurrence, events, filters, search, vectors
from nearkin.sources import changelog, scratch, snapshot, tables
from nearkin.streaming import ingest

CONFIG = EngineConfig(max_top_k=1000)
TEMPORAL = replace(CONFIG, temporal_cooccurrence=True, temporal_half_life_sec=86400.0)
NEGATIVE = replace(CONFIG, negative_signals=True, negative_weight=0.5)
ADAPTIVE = replace(CONFIG, adaptive_fusion=True, adaptive_maturity=200)
ITEM, OTHER, K = "7", "42", 10
FILTER = "label<7,rate>=0.5,name!=c3"


def raw_events(spark, sf):
    return tables.events_of(tables.read(spark, sf, "events"))


def accepted(spark, sf, config=CONFIG):
    return events.accept(raw_events(spark, sf), config)


def edges(spark, sf, config=CONFIG, item=None):
    return cooccurrence.build_edges(accepted(spark, sf, config), config, item)


def vecs(spark, sf):
    return tables.vectors_of(tables.read(spark, sf, "embeddings"))


def meta(spark, sf):
    return tables.metadata_of(tables.read(spark, sf, "embeddings"))


# -- sources -----------------------------------------------------------------


def vector_changes(spark, sf):
    """Every vector, then every third doubled, then every fifth deleted."""
    v = tables.read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"), F.col("vec_id").alias("seq"))
    n = 10_000_000
    doubled = v.where("seq % 3 = 0").select("id", F.transform("vec", lambda x: (x * 2).cast("float")).alias("vec"), (F.col("seq") + n).alias("seq"))
    gone = v.where("seq % 5 = 0").select("id", F.lit(None).cast("array<float>").alias("vec"), (F.col("seq") + 2 * n).alias("seq"))
    return v.unionByName(doubled).unionByName(gone)


def s3_vector_upsert(spark, sf):
    store = vectors.vector_store(vector_changes(spark, sf))
    return store.select("id", F.size("vec").alias("width"), F.round("norm", 4).alias("norm"))


def s5_vector_delete(spark, sf):
    store = vecs(spark, sf)
    return vectors.delete_vectors(store, store.where("cast(id as long) % 4 = 1")).select("id")


def s6_metadata_replace(spark, sf):
    base = meta(spark, sf).select("id", "meta", F.lit(0).cast("long").alias("seq"))
    ids = tables.read(spark, sf, "embeddings").select(F.col("vec_id").alias("n"))
    new = ids.where("n % 2 = 0").select(F.col("n").cast("string").alias("id"), meta_map({"label": typed("i", F.col("n") % 3)}).alias("meta"), F.lit(1).cast("long").alias("seq"))
    lost = spark.createDataFrame([("no-such-vector", 1)], "id string, seq long").select("id", meta_map({"label": typed("i", F.lit(0))}).alias("meta"), "seq")
    store = vectors.metadata_store(base.unionByName(new).unionByName(lost), vecs(spark, sf))
    return store.select("id", F.col("meta.label.i").alias("label"), F.size("meta").alias("fields"))


def s7_point_get(spark, sf):
    return vectors.get_vector(vecs(spark, sf), ITEM).select("id", F.posexplode(V.doubles(F.col("vec"))).alias("dim", "value"))


def s9_context_read(spark, sf):
    return events.ring_buffer(accepted(spark, sf), CONFIG.ctx_buffer_size).where(F.col("ctx") == OTHER).select("item_id", "score", "ts", "type", "seq")


def s2_json_ingest(spark, sf):
    e = raw_events(spark, sf)
    body = F.to_json(F.struct("ctx", F.col("item_id").alias("id"), "type", F.when(F.col("seq") % 11 == 0, F.lit("1.5")).otherwise(F.col("score").cast("string")).alias("score"), F.col("ts").alias("timestamp")))
    parsed = tables.events_from_json(e.select(body.alias("value"), "seq"))
    _, bad = events.validate(parsed)
    return parsed.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"), F.sum(F.col("ts") % 1000).alias("ts")).join(bad.groupBy("type").agg(F.count(F.lit(1)).alias("rejected")), "type", "left").select("type", "n", "score", "ts", F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected"))


def s10_snapshot(spark, sf):
    path = scratch.shared(spark, "snapshot")
    held = {"events": accepted(spark, sf), "edges": edges(spark, sf), "vectors": vecs(spark, sf), "metadata": meta(spark, sf)}
    snapshot.save(held, path, 0, 1)
    return snapshot.verify(spark, path)


def s11_snapshot_load(spark, sf):
    path = scratch.shared(spark, "snapshot")
    snapshot.save({"events": accepted(spark, sf), "edges": edges(spark, sf)}, path, 0, 1)
    stores, _ = snapshot.load(spark, path)
    return search.rounded(search.by_events(stores["edges"], ITEM, K, CONFIG))


def log_rows(spark, sf):
    """All vector changes, then all accepted events, numbered from 1."""
    v = vector_changes(spark, sf).select("id", "vec", F.when(F.col("vec").isNull(), "VECDEL").otherwise("VECSET").alias("op"), "seq")
    e = accepted(spark, sf).select(F.col("ctx").alias("who"), "item_id", "score", "ts", "type", F.lit("EVENT").alias("op"), (F.col("seq") + 100_000_000).alias("seq"))
    rows = v.unionByName(e, allowMissingColumns=True).withColumn("ctx", F.lit("log"))
    return events.arrival_rank(rows).drop("ctx", "seq").withColumnRenamed("who", "ctx").withColumn("seq", F.col("rn").cast("long")).drop("rn")


def s14_wal_replay(spark, sf):
    path = scratch.shared(spark, "log")
    rows = log_rows(spark, sf)
    changelog.append(rows.where("seq <= 2000"), path, 1)
    changelog.append(rows.where("seq > 2000"), path, 2)
    log = changelog.read(spark, path)
    changelog.check(log)
    stores = changelog.replay(log, CONFIG)
    return stores["edges"]


def s14_wal_vectors(spark, sf):
    path = scratch.shared(spark, "log")
    changelog.append(log_rows(spark, sf), path, 1)
    return changelog.replay(changelog.read(spark, path), CONFIG)["vectors"].select("id", F.size("vec").alias("width"), F.round("norm", 4).alias("norm"))


# -- filters -----------------------------------------------------------------


def filtered(text):
    return lambda spark, sf: filters.matching(meta(spark, sf), filters.parse_filter(text))


def p9_min_score(spark, sf):
    return search.rounded(search.min_score(search.by_item_vector(vecs(spark, sf), ITEM, 300, CONFIG), 0.1))


# -- events ------------------------------------------------------------------


def e1_validate(spark, sf):
    e = raw_events(spark, sf)
    odd = e.withColumns({"ctx": F.when(F.col("seq") % 13 == 0, "").otherwise(F.col("ctx")), "score": F.when(F.col("seq") % 7 == 0, 101).otherwise(F.col("score"))})
    good, bad = events.validate(odd)
    return good.select("seq", F.lit("").alias("reason"), "score").unionByName(bad.select("seq", "reason", "score"))


def e2_add_dedup(spark, sf):
    kinds = tables.kind_events_of(tables.read(spark, sf, "events"))
    return events.mark_adds(kinds, 86400).select("seq", "dup")


def e4_state_dedup(spark, sf):
    return events.mark_states(events.validate(raw_events(spark, sf))[0].where("type <> 'ADD'")).select("seq", "type", "dup")


def e8_event_stats(spark, sf):
    return events.event_stats(raw_events(spark, sf), CONFIG)


def e9_ring_buffer(spark, sf):
    return events.ring_buffer(accepted(spark, sf), 20).select("ctx", "seq", "rn")


def e10_context_lru(spark, sf):
    return events.live_contexts(accepted(spark, sf), 40)


# -- graph -------------------------------------------------------------------


def c1_pairs(spark, sf):
    return cooccurrence.pairs(accepted(spark, sf), 50).groupBy("ctx").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("score_a").cast("long") * F.col("score_b")).alias("weight"))


def c2_batch_pairs(spark, sf):
    return cooccurrence.batch_pairs(accepted(spark, sf), 50).groupBy("ctx").agg(F.count(F.lit(1)).alias("pairs"))


def shown(df: DataFrame) -> DataFrame:
    return df.select("item1", "item2", F.round("score", 3).alias("score"))


def c7_prune(spark, sf):
    return cooccurrence.prune(edges(spark, sf), 20, 5000.0)


def c9_maintain(spark, sf):
    config = replace(CONFIG, decay_alpha=0.9, min_support=1000.0, max_neighbors_per_item=30)
    return shown(cooccurrence.maintain(edges(spark, sf), config, 12))


def c13_set_score(spark, sf):
    new = spark.createDataFrame([(ITEM, OTHER, 123456.0), (ITEM, "new", 1.0)], "item1 string, item2 string, score double")
    return cooccurrence.set_scores(edges(spark, sf), new)


# -- search ------------------------------------------------------------------


def by_vectors(metric):
    return lambda spark, sf: search.rounded(search.by_item_vector(vecs(spark, sf), ITEM, K, replace(CONFIG, distance_metric=metric)))


def q1_filtered(spark, sf):
    return search.rounded(search.by_events(edges(spark, sf, item=ITEM), ITEM, K, CONFIG, meta(spark, sf), FILTER))


def q2_filtered(spark, sf):
    return search.rounded(search.by_item_vector(vecs(spark, sf), ITEM, K, CONFIG, meta(spark, sf), FILTER))


def q3_simv(spark, sf):
    query = [((i * 7) % 11 - 5) / 10 for i in range(64)]
    return search.rounded(search.by_vector(vecs(spark, sf), query, K, CONFIG))


def q4_fusion(config):
    return lambda spark, sf: search.rounded(search.by_fusion(edges(spark, sf, config, ITEM), vecs(spark, sf), ITEM, K, config))


def q5_sampled(spark, sf):
    return search.rounded(search.by_item_vector(vecs(spark, sf), ITEM, K, replace(CONFIG, sample_size=100)))


def q9_batch_vectors(spark, sf):
    v = vecs(spark, sf)
    return search.rounded(blocks.batch_vectors(v, v, K))


def q9_batch_events(spark, sf):
    return search.batch_events(edges(spark, sf), K)


def q9_batch_fusion(spark, sf):
    graph = scratch.written(edges(spark, sf), scratch.shared(spark, "edges"))  # used for scores and for counts
    return search.batch_fusion(graph, vecs(spark, sf), K, ADAPTIVE).select("query_id", "item_id", F.round("score", 4).alias("score"))


# -- vector functions and cells ----------------------------------------------


def v1_functions(spark, sf):
    v = vecs(spark, sf)
    a, b = v, v.where(F.col("id") == ITEM).select(F.col("vec").alias("other"))
    x, y = F.col("vec"), F.col("other")
    fields = {"dot": V.dot(x, y), "norm": V.norm(x), "cosine": V.cosine(x, y), "distance": V.l2_distance(x, y), "l2": V.l2_similarity(x, y), "unit": V.norm(V.normalized(F.transform(V.doubles(x), lambda t: t * 3)))}
    return a.crossJoin(F.broadcast(b)).select("id", *(F.round(c, 6).alias(n) for n, c in fields.items()))


def v6_quantize(spark, sf):
    v = vecs(spark, sf)
    return ann.quantized(v, ann.quantizer(v)).select("id", F.posexplode("codes").alias("dim", "code")).groupBy("id").agg(F.sum(F.col("code").cast("long") * (F.col("dim") + 1)).alias("weighted"))


def v7_quantized_search(spark, sf):
    v = vecs(spark, sf)
    codes = ann.quantized(v.where(F.col("id") != ITEM), ann.quantizer(v))
    return search.rounded(ann.quantized_search(codes, search.fetch_vector(v, ITEM), K))


def cells(spark, sf):
    table = tables.read(spark, sf, "embeddings")
    labelled = table.select(F.col("embedding").alias("vec"), "label")
    centroids = ann.label_centroids(labelled, F.col("label"))
    return centroids, ann.assign(tables.vectors_of(table), centroids, "cosine")


def v9_train(spark, sf):
    centroids = ann.train(vecs(spark, sf), "cosine", 8)
    return spark.createDataFrame([(i, float(sum(c))) for i, c in enumerate(centroids)], "cell int, total double")


def v11_assign(spark, sf):
    return cells(spark, sf)[1].select("id", "cell")


def v12_cell_search(spark, sf):
    centroids, celled = cells(spark, sf)
    path = scratch.shared(spark, "cells")
    celled.write.partitionBy("cell").parquet(path)
    stored = spark.read.schema("id string, vec array<float>, norm double, cell int").parquet(path)
    query = search.fetch_vector(vecs(spark, sf), ITEM)
    return search.rounded(ann.cell_search(stored, centroids, query, K, replace(CONFIG, ivf_nprobe=3), without=ITEM))


def v12_batch_cell_search(spark, sf):
    """All rows as queries, each in its three nearest cells."""
    centroids, celled = cells(spark, sf)
    return search.rounded(ann.batch_cell_search(celled, centroids, celled, K, replace(CONFIG, ivf_nprobe=3)))


def v12_cell_recall(spark, sf):
    """Recall of trained cells against exact search, of queries divisible by 100."""
    v = vecs(spark, sf)
    config = replace(CONFIG, ivf_nlist=0)
    index = ann.CellIndex.build(v, config, lambda: scratch.shared(spark, "cells"))
    config = replace(config, ivf_nprobe=ann.tuned_probes(v, index.centroids, config.distance_metric))
    queries = v.where("cast(id as long) % 100 = 0")
    found = ann.batch_cell_search(index.celled, index.centroids, queries, K, config)
    return ann.recall(found, blocks.batch_vectors(v, queries, K)).select("queries", (F.col("recall") >= 0.9).alias("reached"))


def v9_cell_sizes(spark, sf):
    v = vecs(spark, sf)
    celled = ann.assign(v, ann.train(v, "cosine", 8), "cosine")
    return celled.agg(F.count(F.lit(1)).alias("rows"), (F.count_distinct("cell") <= 8).alias("within"), F.count_distinct("id").alias("ids"))


def q5_sample_membership(spark, sf):
    """A sample's answers: how many, and whether each has its exact score."""
    v = vecs(spark, sf)
    exact = search.by_item_vector(v, ITEM, 1000, replace(CONFIG, max_top_k=1000)).withColumnRenamed("score", "exact")
    found = search.by_item_vector(v, ITEM, K, replace(CONFIG, sample_size=100))
    near = F.coalesce(F.abs(F.col("score") - F.col("exact")) < 1e-9, F.lit(False))
    return found.join(exact, "item_id", "left").agg(F.count(F.lit(1)).alias("results"), F.min(near | F.col("exact").isNull()).alias("exact"))


def v13_buffered_search(spark, sf):
    centroids, celled = cells(spark, sf)
    buffer = celled.where("cast(id as long) % 6 = 1").select("id", F.transform("vec", lambda x: (-x).cast("float")).alias("vec"), "norm")
    query = search.fetch_vector(vecs(spark, sf), ITEM)
    return search.rounded(ann.cell_search(celled, centroids, query, K, replace(CONFIG, ivf_nprobe=10), buffer=buffer, without=ITEM))


def v14_graph_index(spark, sf):
    config = replace(CONFIG, index_type="hnsw")
    e = engine.Engine(spark, config).load_vectors(vecs(spark, sf))
    return search.rounded(e.sim(ITEM, K, using="vectors"))


def v18_tiered(spark, sf):
    v = vecs(spark, sf)
    delta = v.where("cast(id as long) % 9 = 0").select("id", F.transform("vec", lambda x: (x * 3).cast("float")).alias("vec"), (F.col("norm") * 3).alias("norm"))
    store = ann.tiered(v, delta, v.where("cast(id as long) % 10 = 3"))
    return search.rounded(search.by_vector(store, search.fetch_vector(v, ITEM), K, replace(CONFIG, distance_metric="dot"), without=ITEM))


# -- streaming and whole engine ----------------------------------------------


def st_stream_edges(spark, sf):
    """The graph from a stream of the events' file."""
    path = scratch.shared(spark, "stream")
    table = tables.read(spark, sf, "events")
    stream = tables.events_of(spark.readStream.schema(table.schema).parquet(f"{sf}/events.parque[t]"))
    ingest.start(stream, CONFIG, f"{path}/deltas", f"{path}/checkpoint").awaitTermination()
    return ingest.edges(spark, f"{path}/deltas")


def halves(spark, sf):
    """The events before and after the middle of the arrivals, and the middle."""
    e = raw_events(spark, sf)
    middle = e.agg(F.floor((F.min("seq") + F.max("seq")) / 2).cast("long")).first()[0]
    return e.where(F.col("seq") <= middle), e.where(F.col("seq") > middle)


def c7_ingest_cap(spark, sf):
    """Limits on neighbours and support hold as soon as events are in."""
    config = replace(CONFIG, max_neighbors_per_item=20, min_support=5000.0)
    return engine.Engine(spark, config).load_events(raw_events(spark, sf)).edges


def c9_decay_then_event(spark, sf):
    """Half of the events, a decay, the other half: what faded stays faded."""
    first, second = halves(spark, sf)
    e = engine.Engine(spark, replace(CONFIG, decay_alpha=0.5)).load_events(first).maintain()
    e.add_events(second)
    return shown(e.edges)


def e10_evicted_events(spark, sf):
    """Only the contexts touched last keep events."""
    e = engine.Engine(spark, replace(CONFIG, max_contexts=40)).load_events(raw_events(spark, sf))
    return e.events.groupBy("ctx").agg(F.count(F.lit(1)).alias("events"))


def a1_info(spark, sf):
    return engine.info(accepted(spark, sf), edges(spark, sf), vecs(spark, sf), meta(spark, sf), CONFIG)


def a8_command(spark, sf):
    e = engine.Engine(spark, CONFIG).load_events(raw_events(spark, sf)).load_vectors(vecs(spark, sf), meta(spark, sf))
    return e.execute(f"sim {ITEM} {K} using=fusion filter={FILTER} min_score=0.05")


QUERIES = {
    "s2_json_ingest": s2_json_ingest,
    "s3_vector_upsert": s3_vector_upsert,
    "s5_vector_delete": s5_vector_delete,
    "s6_metadata_replace": s6_metadata_replace,
    "s7_point_get": s7_point_get,
    "s9_context_read": s9_context_read,
    "s10_snapshot_verify": s10_snapshot,
    "s11_snapshot_load": s11_snapshot_load,
    "s14_wal_replay": s14_wal_replay,
    "s14_wal_vectors": s14_wal_vectors,
    "p3_filter_equal": filtered("name=c3"),
    "p3_filter_not_equal": filtered("name!=c3"),
    "p4_filter_order": filtered("label>2,label<=7,rate<2"),
    "p4_filter_promoted": filtered("label>=4.5,rate>1"),
    "p5_filter_in": filtered("label:in(1|3|x|5)"),
    "p6_filter_missing": filtered("nothing!=1"),
    "p7_filter_types": filtered("even:true,rate!=0.5"),
    "p9_min_score": p9_min_score,
    "e1_validate": e1_validate,
    "e2_add_dedup": e2_add_dedup,
    "e4_state_dedup": e4_state_dedup,
    "e8_event_stats": e8_event_stats,
    "e9_ring_buffer": e9_ring_buffer,
    "e10_context_lru": e10_context_lru,
    "c1_pairs": c1_pairs,
    "c2_batch_pairs": c2_batch_pairs,
    "c3_edges": edges,
    "c4_temporal_edges": lambda s, d: shown(edges(s, d, TEMPORAL)),
    "c5_negative_edges": lambda s, d: edges(s, d, NEGATIVE),
    "c6_decay": lambda s, d: shown(cooccurrence.decay(edges(s, d), 0.5, 2000.0)),
    "c7_prune": c7_prune,
    "c9_maintain": c9_maintain,
    "c10_pair_score": lambda s, d: cooccurrence.pair_score(edges(s, d, item=ITEM), ITEM, OTHER),
    "c11_neighbor_counts": lambda s, d: cooccurrence.neighbor_counts(edges(s, d, NEGATIVE)),
    "c12_neighbors": lambda s, d: cooccurrence.neighbors(edges(s, d, NEGATIVE, ITEM), ITEM),
    "c13_set_score": c13_set_score,
    "c14_graph_stats": lambda s, d: cooccurrence.graph_stats(edges(s, d)),
    "q1_sim_events": lambda s, d: search.rounded(search.by_events(edges(s, d, item=ITEM), ITEM, K, CONFIG)),
    "q1_sim_events_filtered": q1_filtered,
    "q2_sim_vectors_cosine": by_vectors("cosine"),
    "q2_sim_vectors_dot": by_vectors("dot"),
    "q2_sim_vectors_l2": by_vectors("l2"),
    "q2_sim_vectors_filtered": q2_filtered,
    "q3_simv": q3_simv,
    "q4_fusion": q4_fusion(CONFIG),
    "q4_fusion_adaptive": q4_fusion(ADAPTIVE),
    "q5_sampled": q5_sampled,
    "q9_batch_vectors": q9_batch_vectors,
    "q9_batch_events": q9_batch_events,
    "q9_batch_fusion": q9_batch_fusion,
    "v1_vector_functions": v1_functions,
    "v6_quantize": v6_quantize,
    "v7_quantized_search": v7_quantized_search,
    "v9_cell_training": v9_train,
    "v11_cell_assign": v11_assign,
    "v12_cell_search": v12_cell_search,
    "v12_batch_cell_search": v12_batch_cell_search,
    "v12_cell_recall": v12_cell_recall,
    "v9_cell_sizes": v9_cell_sizes,
    "q5_sample_membership": q5_sample_membership,
    "c7_ingest_cap": c7_ingest_cap,
    "c9_decay_then_event": c9_decay_then_event,
    "e10_evicted_events": e10_evicted_events,
    "v13_buffered_search": v13_buffered_search,
    "v14_graph_index": v14_graph_index,
    "v18_tiered_search": v18_tiered,
    "st_stream_edges": st_stream_edges,
    "a1_info": a1_info,
    "a8_command": a8_command,
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Items most similar to one by events and vectors together."""
    return q4_fusion(CONFIG)(spark, sf)

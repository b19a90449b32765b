"""DuckDB SQL for the registered queries, written apart from the engine."""

from __future__ import annotations

EV = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS ctx, json_extract_string(props, '$.k') AS item_id,
         CAST(CASE WHEN event_type = 'error' THEN 0 ELSE least(floor(value), 100) END AS INTEGER) AS score,
         CAST(floor(epoch(ts)) AS BIGINT) AS ts,
         CASE event_type WHEN 'error' THEN 'DEL' WHEN 'signup' THEN 'SET' ELSE 'ADD' END AS type,
         event_id AS seq
  FROM events)"""

KIND_EV = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS ctx, event_type AS item_id, 10 AS score,
         CAST(floor(epoch(ts)) AS BIGINT) AS ts, 'ADD' AS type, event_id AS seq
  FROM events)"""


def marks(window: int) -> str:
    """marked: every event with dup."""
    return f"""adds AS (
  SELECT *, row_number() OVER (PARTITION BY ctx, item_id, score ORDER BY seq) AS k FROM ev WHERE type = 'ADD'
), fold AS (
  SELECT ctx, item_id, score, seq, k, ts AS anchor, FALSE AS dup FROM adds WHERE k = 1
  UNION ALL
  SELECT a.ctx, a.item_id, a.score, a.seq, a.k,
         CASE WHEN a.ts <= f.anchor + {window} THEN f.anchor ELSE a.ts END, a.ts <= f.anchor + {window}
  FROM fold f JOIN adds a ON a.ctx = f.ctx AND a.item_id = f.item_id AND a.score = f.score AND a.k = f.k + 1
), states AS (
  SELECT *, CASE type WHEN 'DEL' THEN -1 ELSE score END AS state FROM ev WHERE type <> 'ADD'
), marked_states AS (
  SELECT ctx, item_id, score, ts, type, seq,
         coalesce(lag(state) OVER (PARTITION BY ctx, item_id ORDER BY seq) = state, FALSE) AS dup FROM states
), marked AS (
  SELECT a.ctx, a.item_id, a.score, a.ts, a.type, a.seq, f.dup FROM adds a JOIN fold f USING (seq)
  UNION ALL SELECT * FROM marked_states
), accepted AS (SELECT ctx, item_id, score, ts, type, seq FROM marked WHERE NOT dup)"""


PAIRS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY seq) AS rn FROM accepted),
pairs AS (
  SELECT a.ctx, a.item_id AS item_a, a.score AS score_a, a.ts AS ts_a, b.item_id AS item_b, b.score AS score_b, b.ts AS ts_b, b.type AS type_b, b.seq AS seq_b
  FROM ranked a JOIN ranked b ON a.ctx = b.ctx AND b.rn - a.rn BETWEEN 1 AND 50 AND a.item_id <> b.item_id)"""

PLAIN = "CAST(score_a AS DOUBLE) * score_b"
FADED = f"{PLAIN} * greatest(pow(2.0, -(greatest(ts_a, ts_b) - ts_a) / 86400.0), 1e-6) * greatest(pow(2.0, -(greatest(ts_a, ts_b) - ts_b) / 86400.0), 1e-6)"


def edge_tables(weight: str = PLAIN, negative: str = "") -> str:
    more = f" UNION ALL SELECT item_a, item_b, {negative} FROM pairs WHERE type_b = 'DEL'" if negative else ""
    return f"""parts AS (SELECT item_a AS i, item_b AS j, {weight} AS w FROM pairs WHERE {weight} <> 0{more}),
edges AS (
  SELECT item1, item2, sum(w) AS score
  FROM (SELECT i AS item1, j AS item2, w FROM parts UNION ALL SELECT j, i, w FROM parts) GROUP BY item1, item2)"""


BASE = f"WITH RECURSIVE {EV}, {marks(60)}"
GRAPH = f"{BASE}, {PAIRS}, {edge_tables()}"
#: The first half of the arrivals counts half.
HALF_FADED = f"{PLAIN} * CASE WHEN seq_b <= (SELECT (min(seq) + max(seq)) // 2 FROM ev) THEN 0.5 ELSE 1.0 END"
NEGATIVE_GRAPH = f"{BASE}, {PAIRS}, {edge_tables(PLAIN, '-CAST(score_a AS DOUBLE) * 0.5')}"


def total(values: str) -> str:
    return f"coalesce(list_sum({values}), 0.0)"


def dot(a: str, b: str) -> str:
    return total(f"list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i])")


def norm(a: str) -> str:
    return f"sqrt({total(f'list_transform({a}, lambda x: x * x)')})"


def distance(a: str, b: str) -> str:
    return f"sqrt({total(f'list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))')})"


VEC = f"""v0 AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id AS n, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
vecs AS (SELECT *, {norm('vec')} AS norm FROM v0)"""

META = """meta AS (
  SELECT vec_id AS n, CAST(vec_id AS VARCHAR) AS id, label, CASE WHEN vec_id % 5 <> 0 THEN 'c' || label END AS name,
         vec_id % 10 / 4.0::DOUBLE AS rate, vec_id % 2 = 0 AS even
  FROM embeddings WHERE vec_id % 7 <> 6)"""

#: The filter ``label<7,rate>=0.5,name!=c3``.
FILTER = "label < 7 AND rate >= 0.5 AND (name IS NULL OR name <> 'c3')"

SCORE = {
    "cosine": f"CASE WHEN a.norm < 1e-7 OR b.norm < 1e-7 THEN 0.0 ELSE {dot('a.vec', 'b.vec')} / (a.norm * b.norm) END",
    "dot": dot("a.vec", "b.vec"),
    "l2": f"1.0 / (1.0 + {distance('a.vec', 'b.vec')})",
}


def all_scores(metric: str = "cosine", rows: str = "vecs", queries: str = "vecs", where: str = "a.id = '7'") -> str:
    return f"SELECT a.id AS query_id, b.id AS item_id, {SCORE[metric]} AS score FROM {queries} a JOIN {rows} b ON a.id <> b.id WHERE {where}"


def best(rows: str, k: int) -> str:
    """(item_id, score), cut before anything is rounded."""
    return f"(SELECT item_id, score FROM ({rows}) AS r ORDER BY r.score DESC, item_id LIMIT {k})"


def shown(rows: str, k: int = 10) -> str:
    return f"SELECT item_id, round(score, 4) AS score FROM {best(rows, k)}"


def per_query(rows: str, k: int, digits: int = 9) -> str:
    return f"""(SELECT query_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank
  FROM (SELECT query_id, item_id, round(score, {digits}) AS score FROM ({rows})) QUALIFY rank <= {k})"""


EVENT_ROWS = "SELECT item1 AS query_id, item2 AS item_id, score FROM edges WHERE score > 0"


def normalized(source: str) -> str:
    """Scores of (query_id, item_id, score) spread per query."""
    return f"""(SELECT query_id, item_id, CASE WHEN count(*) OVER w <= 1 OR max(score) OVER w - min(score) OVER w < 1e-4
    THEN greatest(0.0, least(1.0, score)) ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score
  FROM {source} WINDOW w AS (PARTITION BY query_id))"""


def fusion(events: str, vectors: str, alpha: str, beta: str) -> str:
    """(query_id, item_id, score); alpha and beta are over query_id."""
    return f"""SELECT query_id, item_id, sum(share * score) AS score FROM (
    SELECT query_id, item_id, score, CASE WHEN max(source) OVER w = min(source) OVER w THEN 1.0
           WHEN source = 0 THEN {beta} / ({alpha} + {beta}) ELSE {alpha} / ({alpha} + {beta}) END AS share
    FROM (SELECT *, 0 AS source FROM {normalized(events)} UNION ALL SELECT *, 1 AS source FROM {normalized(vectors)})
    LEFT JOIN counts USING (query_id) WINDOW w AS (PARTITION BY query_id)) GROUP BY query_id, item_id"""


COUNTS = "counts AS (SELECT item1 AS query_id, count(*) AS neighbors FROM edges GROUP BY item1)"
ADAPTIVE_ALPHA = "(0.9 - least(1.0, coalesce(neighbors, 0) / 200.0) * 0.7)"
ONE_EVENTS = f"(SELECT '7' AS query_id, * FROM {best(EVENT_ROWS + chr(32) + 'AND item1 = ' + chr(39) + '7' + chr(39), 30)})"
ONE_VECTORS = f"(SELECT '7' AS query_id, * FROM {best(all_scores(), 30)})"


def one_fusion(alpha: str, beta: str, tail: str = "") -> str:
    return f"{GRAPH}, {VEC}, {COUNTS} {shown(fusion(ONE_EVENTS, ONE_VECTORS, alpha, beta))}{tail}"


CELLS = f"""centers AS (
  SELECT label, list(x ORDER BY dim) AS c FROM (
    SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS dim FROM vecs) GROUP BY label, dim) GROUP BY label
), numbered AS (SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS cell, c, {norm('c')} AS cnorm FROM centers),
near AS (SELECT v.id, n.cell, row_number() OVER (PARTITION BY v.id ORDER BY round({dot('v.vec', 'n.c')} / (v.norm * n.cnorm), 9) DESC, n.cell) AS r FROM vecs v, numbered n),
celled AS (SELECT v.id, v.n, v.vec, v.norm, near.cell FROM vecs v JOIN near ON near.id = v.id AND near.r = 1)"""

STORE = """changes AS (
  SELECT vec_id AS n, CAST(embedding AS DOUBLE[]) AS vec, vec_id AS seq FROM embeddings
  UNION ALL SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 2), vec_id + 10000000 FROM embeddings WHERE vec_id % 3 = 0
  UNION ALL SELECT vec_id, NULL, vec_id + 20000000 FROM embeddings WHERE vec_id % 5 = 0
), store AS (SELECT n, arg_max(vec, seq) FILTER (WHERE vec IS NOT NULL) AS vec, max(CASE WHEN vec IS NULL THEN 1 ELSE 0 END) AS gone FROM changes GROUP BY n)"""
STORED = f"WITH {STORE} SELECT CAST(n AS VARCHAR) AS id, CAST(len(vec) AS INTEGER) AS width, round({norm('vec')}, 4) AS norm FROM store WHERE gone = 0"

FADE = f"{GRAPH}, faded AS (SELECT item1, item2, score * pow(0.9, 10) AS score FROM edges)"
RANKED = "SELECT item1, item2, score, row_number() OVER (PARTITION BY item1 ORDER BY abs(score) DESC, item2) AS r FROM"


def matching(where: str) -> str:
    return f"WITH {META} SELECT id FROM meta WHERE {where}"


ORACLES = {
    "s2_json_ingest": f"""WITH {EV}, parsed AS (SELECT type, CASE WHEN seq % 11 = 0 THEN NULL ELSE score END AS score, ts FROM ev)
        SELECT type, count(*) AS n, CAST(sum(score) AS BIGINT) AS score, CAST(sum(ts % 1000) AS BIGINT) AS ts,
               CAST(sum(CASE WHEN type <> 'DEL' AND score IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS rejected FROM parsed GROUP BY type""",
    "s3_vector_upsert": STORED,
    "s5_vector_delete": "SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings WHERE vec_id % 4 <> 1",
    "s6_metadata_replace": """SELECT CAST(vec_id AS VARCHAR) AS id, CAST(CASE WHEN vec_id % 2 = 0 THEN vec_id % 3 ELSE label END AS BIGINT) AS label,
        CAST(CASE WHEN vec_id % 2 = 0 THEN 1 WHEN vec_id % 5 = 0 THEN 3 ELSE 4 END AS INTEGER) AS fields
        FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 7 <> 6""",
    "s7_point_get": f"WITH {VEC} SELECT id, CAST(unnest(range(0, len(vec))) AS INTEGER) AS dim, unnest(vec) AS value FROM vecs WHERE id = '7'",
    "s9_context_read": f"{BASE} SELECT item_id, score, ts, type, seq FROM accepted WHERE ctx = '42' ORDER BY seq DESC LIMIT 50",
    "s10_snapshot_verify": f"""{GRAPH}, {META} SELECT 'events' AS store, count(*) AS rows, TRUE AS ok FROM accepted UNION ALL SELECT 'edges', count(*), TRUE FROM edges
        UNION ALL SELECT 'vectors', count(*), TRUE FROM embeddings UNION ALL SELECT 'metadata', count(*), TRUE FROM meta""",
    "s11_snapshot_load": f"{GRAPH} {shown(EVENT_ROWS + chr(32) + 'AND item1 = ' + chr(39) + '7' + chr(39))}",
    "s14_wal_replay": f"{GRAPH} SELECT * FROM edges",
    "s14_wal_vectors": STORED,
    "p3_filter_equal": matching("name = 'c3'"),
    "p3_filter_not_equal": matching("name IS NULL OR name <> 'c3'"),
    "p4_filter_order": matching("label > 2 AND label <= 7 AND rate < 2"),
    "p4_filter_promoted": matching("label >= 4.5 AND rate > 1"),
    "p5_filter_in": matching("label IN (1, 3, 5)"),
    "p6_filter_missing": matching("TRUE"),
    "p7_filter_types": matching("even AND rate <> 0.5"),
    "p9_min_score": f"WITH {VEC} SELECT * FROM ({shown(all_scores(), 300)}) WHERE item_id IN (SELECT item_id FROM ({all_scores()}) WHERE score >= 0.1)",
    "e1_validate": f"""WITH {EV}, odd AS (SELECT seq, type, CASE WHEN seq % 13 = 0 THEN '' ELSE ctx END AS ctx, CASE WHEN seq % 7 = 0 THEN 101 ELSE score END AS score FROM ev),
        judged AS (SELECT *, CASE WHEN ctx = '' THEN 'empty context' WHEN type <> 'DEL' AND score > 100 THEN 'score out of range' ELSE '' END AS reason FROM odd)
        SELECT seq, reason, CASE WHEN type = 'DEL' AND reason = '' THEN 0 ELSE score END AS score FROM judged""",
    "e2_add_dedup": f"WITH RECURSIVE {KIND_EV}, {marks(86400)} SELECT seq, dup FROM marked",
    "e4_state_dedup": f"{BASE} SELECT seq, type, dup FROM marked_states",
    "e8_event_stats": f"""{BASE}, per AS (SELECT ctx, count(*) AS n, count(*) FILTER (WHERE dup) AS d FROM marked GROUP BY ctx)
        SELECT CAST(sum(n) AS BIGINT) AS total_events, CAST(sum(d) AS BIGINT) AS deduped_events, CAST(sum(least(n - d, 50)) AS BIGINT) AS stored_events,
               CAST(sum(CASE WHEN n > d THEN 1 ELSE 0 END) AS BIGINT) AS active_contexts FROM per""",
    "e9_ring_buffer": f"""{BASE}, {PAIRS.split(',' + chr(10) + 'pairs')[0]} SELECT ctx, seq, rn FROM (SELECT *, count(*) OVER (PARTITION BY ctx) AS n FROM ranked) WHERE rn > n - 20""",
    "e10_context_lru": f"{BASE} SELECT ctx, max(seq) AS last_seq FROM accepted GROUP BY ctx ORDER BY last_seq DESC, ctx LIMIT 40",
    "c1_pairs": f"{BASE}, {PAIRS} SELECT ctx, count(*) AS pairs, CAST(sum(score_a * score_b) AS BIGINT) AS weight FROM pairs GROUP BY ctx",
    "c2_batch_pairs": f"""{BASE}, last AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY seq DESC) AS back FROM accepted)
        SELECT a.ctx, count(*) AS pairs FROM last a JOIN last b ON a.ctx = b.ctx AND a.back <= 50 AND b.back < a.back AND a.item_id <> b.item_id GROUP BY a.ctx""",
    "c3_edges": f"{GRAPH} SELECT item1, item2, score FROM edges",
    "c4_temporal_edges": f"{BASE}, {PAIRS}, {edge_tables(FADED)} SELECT item1, item2, round(score, 3) AS score FROM edges",
    "c5_negative_edges": f"{NEGATIVE_GRAPH} SELECT item1, item2, score FROM edges",
    "c6_decay": f"{GRAPH} SELECT item1, item2, round(score * 0.5, 3) AS score FROM edges WHERE abs(score * 0.5) >= 2000.0",
    "c7_prune": f"{GRAPH}, r AS ({RANKED} edges WHERE abs(score) >= 5000.0) SELECT a.item1, a.item2, a.score FROM r a JOIN r b ON a.item1 = b.item2 AND a.item2 = b.item1 WHERE a.r <= 20 AND b.r <= 20",
    "c9_maintain": f"""{FADE}, r AS ({RANKED} faded WHERE abs(score) >= 1000.0),
        pruned AS (SELECT a.item1, a.item2, a.score FROM r a JOIN r b ON a.item1 = b.item2 AND a.item2 = b.item1 WHERE a.r <= 30 AND b.r <= 30)
        SELECT item1, item2, round(score * pow(0.9, 2), 3) AS score FROM pruned WHERE abs(score * pow(0.9, 2)) >= 1000.0""",
    "c10_pair_score": f"{GRAPH} SELECT coalesce(max(score), 0.0) AS score FROM edges WHERE item1 = '7' AND item2 = '42'",
    "c11_neighbor_counts": f"{NEGATIVE_GRAPH} SELECT item1 AS item_id, count(*) AS neighbors FROM edges GROUP BY item1",
    "c12_neighbors": f"{NEGATIVE_GRAPH} SELECT item2 AS item_id, score FROM edges WHERE item1 = '7'",
    "c13_set_score": f"""{GRAPH}, new(item1, item2, score) AS (VALUES ('7', '42', 123456.0::DOUBLE), ('42', '7', 123456.0::DOUBLE), ('7', 'new', 1.0::DOUBLE), ('new', '7', 1.0::DOUBLE))
        SELECT item1, item2, score FROM edges WHERE (item1, item2) NOT IN (SELECT (item1, item2) FROM new) UNION ALL SELECT * FROM new""",
    "c14_graph_stats": f"{GRAPH} SELECT count(DISTINCT item1) AS tracked_items, CAST(count(*) // 2 AS BIGINT) AS pairs FROM edges",
    "q1_sim_events": f"{GRAPH} {shown(EVENT_ROWS + chr(32) + 'AND item1 = ' + chr(39) + '7' + chr(39))}",
    "q1_sim_events_filtered": f"{GRAPH}, {META} {shown(EVENT_ROWS + chr(32) + 'AND item1 = ' + chr(39) + '7' + chr(39) + f' AND item2 IN (SELECT id FROM meta WHERE {FILTER})')}",
    "q2_sim_vectors_cosine": f"WITH {VEC} {shown(all_scores('cosine'))}",
    "q2_sim_vectors_dot": f"WITH {VEC} {shown(all_scores('dot'))}",
    "q2_sim_vectors_l2": f"WITH {VEC} {shown(all_scores('l2'))}",
    "q2_sim_vectors_filtered": f"WITH {VEC}, {META} {shown(all_scores(where=f'''a.id = '7' AND b.id IN (SELECT id FROM meta WHERE {FILTER})'''))}",
    "q3_simv": f"""WITH {VEC}, q0 AS (SELECT 'query' AS id, list_transform(range(0, 64), lambda i: ((i * 7) % 11 - 5) / 10.0::DOUBLE) AS vec),
        q AS (SELECT *, {norm('vec')} AS norm FROM q0) {shown(all_scores(queries='q', where='TRUE'))}""",
    "q4_fusion": one_fusion("0.6", "0.4"),
    "q4_fusion_adaptive": one_fusion(ADAPTIVE_ALPHA, f"(1 - {ADAPTIVE_ALPHA})"),
    "q9_batch_vectors": f"WITH {VEC} SELECT query_id, item_id, round(score, 4) AS score, rank FROM {per_query(all_scores(where='TRUE'), 10)}",
    "q9_batch_events": f"{GRAPH} SELECT * FROM {per_query(EVENT_ROWS, 10)}",
    "q9_batch_fusion": f"""{GRAPH}, {VEC}, {COUNTS}, be AS (SELECT query_id, item_id, score FROM {per_query(EVENT_ROWS, 30)}), bv AS (SELECT query_id, item_id, score FROM {per_query(all_scores(where='TRUE'), 30)})
        SELECT query_id, item_id, round(score, 4) AS score FROM {per_query(fusion('be', 'bv', ADAPTIVE_ALPHA, f'(1 - {ADAPTIVE_ALPHA})'), 10, 15)}""",
    "v1_vector_functions": f"""WITH {VEC} SELECT a.id, round({dot('a.vec', 'b.vec')}, 6) AS dot, round(a.norm, 6) AS norm, round({SCORE['cosine']}, 6) AS cosine,
        round({distance('a.vec', 'b.vec')}, 6) AS distance, round({SCORE['l2']}, 6) AS l2, 1.0::DOUBLE AS unit FROM vecs a, vecs b WHERE b.id = '7'""",
    "v6_quantize": f"""WITH {VEC}, flat AS (SELECT id, unnest(vec) AS x, unnest(range(0, len(vec))) AS dim FROM vecs),
        bounds AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM flat GROUP BY dim)
        SELECT id, CAST(sum(CASE WHEN hi - lo < 1e-10 THEN 128 ELSE floor(greatest(0.0, least(1.0, (x - lo) / (hi - lo))) * 255 + 0.5) END * (dim + 1)) AS BIGINT) AS weighted
        FROM flat JOIN bounds USING (dim) GROUP BY id""",
    "v7_quantized_search": f"""WITH {VEC}, flat AS (SELECT id, unnest(vec) AS x, unnest(range(0, len(vec))) AS dim FROM vecs),
        bounds AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM flat GROUP BY dim),
        codes AS (SELECT id, dim, lo, hi, CASE WHEN hi - lo < 1e-10 THEN 128 ELSE floor(greatest(0.0, least(1.0, (x - lo) / (hi - lo))) * 255 + 0.5) END AS c FROM flat JOIN bounds USING (dim)),
        rows AS (SELECT id, list(lo + c / 255 * (hi - lo) ORDER BY dim) AS vec FROM codes GROUP BY id), back AS (SELECT *, {norm('vec')} AS norm FROM rows)
        SELECT item_id, round(score, 4) AS score FROM (SELECT item_id, round(score, 9) AS score FROM ({all_scores(rows='back')})) AS r ORDER BY r.score DESC, item_id LIMIT 10""",
    "v11_cell_assign": f"WITH {VEC}, {CELLS} SELECT id, cell FROM celled",
    "v12_cell_search": f"WITH {VEC}, {CELLS}, hit AS (SELECT * FROM celled WHERE cell IN (SELECT cell FROM near WHERE id = '7' AND r <= 3)) {shown(all_scores(rows='hit'))}",
    "v12_batch_cell_search": f"""WITH {VEC}, {CELLS}, met AS (SELECT a.id AS query_id, b.id AS item_id, {SCORE['cosine']} AS score
        FROM celled a JOIN near ON near.id = a.id AND near.r <= 3 JOIN celled b ON b.cell = near.cell AND a.id <> b.id)
        SELECT query_id, item_id, round(score, 4) AS score, rank FROM {per_query('SELECT * FROM met', 10)}""",
    "v13_buffered_search": f"WITH {VEC}, mixed AS (SELECT id, CASE WHEN n % 6 = 1 THEN list_transform(vec, lambda x: -x) ELSE vec END AS vec, norm FROM vecs) {shown(all_scores(rows='mixed'))}",
    "v14_graph_index": f"WITH {VEC} {shown(all_scores('cosine'))}",
    "v18_tiered_search": f"WITH {VEC}, mixed AS (SELECT id, CASE WHEN n % 9 = 0 THEN list_transform(vec, lambda x: CAST(CAST(x * 3 AS FLOAT) AS DOUBLE)) ELSE vec END AS vec, norm FROM vecs WHERE n % 10 <> 3) {shown(all_scores('dot', rows='mixed'))}",
    "st_stream_edges": f"{GRAPH} SELECT * FROM edges",
    "a1_info": f"""{GRAPH}, {META}, per AS (SELECT ctx, count(*) AS n FROM accepted GROUP BY ctx)
        SELECT (SELECT count(*) FROM per) AS ctx_count, (SELECT CAST(sum(least(n, 50)) AS BIGINT) FROM per) AS event_count, (SELECT count(*) FROM embeddings) AS vector_count,
               (SELECT count(*) FROM meta) AS metadata_count, (SELECT count(DISTINCT item1) FROM edges) AS id_count, (SELECT CAST(count(*) // 2 AS BIGINT) FROM edges) AS pair_count""",
}

_KEPT = f"(SELECT id FROM meta WHERE {FILTER})"
_EVENTS = ONE_EVENTS.replace("AND item1 = '7'", f"AND item1 = '7' AND item2 IN {_KEPT}")
_VECTORS = f"(SELECT '7' AS query_id, * FROM {best(all_scores(where=f'''a.id = '7' AND b.id IN {_KEPT}'''), 30)})"
ORACLES["a8_command"] = f"""{GRAPH}, {VEC}, {META}, {COUNTS} SELECT item_id, round(score, 4) AS score
    FROM {best(fusion(_EVENTS, _VECTORS, '0.6', '0.4'), 10)} WHERE score >= 0.05"""
ORACLES["c7_ingest_cap"] = ORACLES["c7_prune"]
ORACLES["c9_decay_then_event"] = f"{BASE}, {PAIRS}, {edge_tables(HALF_FADED)} SELECT item1, item2, round(score, 3) AS score FROM edges"
ORACLES["e10_evicted_events"] = f"{BASE} SELECT ctx, count(*) AS events FROM accepted GROUP BY ctx ORDER BY max(seq) DESC, ctx LIMIT 40"
ORACLES["q5_sample_membership"] = "SELECT least(10, count(*) - 1) AS results, TRUE AS exact FROM embeddings"
ORACLES["v9_cell_sizes"] = "SELECT count(*) AS rows, TRUE AS within, count(DISTINCT vec_id) AS ids FROM embeddings"
ORACLES["v12_cell_recall"] = "SELECT count(*) AS queries, TRUE AS reached FROM embeddings WHERE vec_id % 100 = 0"

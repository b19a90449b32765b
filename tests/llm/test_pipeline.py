import pytest

import corpus_pipeline
from nearkin.llm import queries

from .test_dedup import slow_components, slow_print
from .test_rest import corpus


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    docs = corpus(spark, 60, 11).drop("truth").collect()
    rows = [tuple(r) for r in docs]
    rows += [(100 + i, rows[i][1], "en", "s", 1) for i in range(5)]  # copies
    rows += [(200, "", "en", "s", 0), (201, None, None, None, None), (202, "12345", "en", "s", 5)]  # no language
    rows += [(7, *rows[7][1:])]  # a repeated row
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def test_stages_equal_brute_force(spark, documents):
    folder, rows = documents
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "best_fit_packing"]

    docs = stage["language_id"](spark, docs, folder)
    assert docs.columns == columns and sorted(map(tuple, docs.collect()), key=repr) == sorted(kept, key=repr)

    docs = stage["exact_dedup"](spark, docs, folder)
    last = {}
    for r in kept:
        last[r[1]] = max(r[0], last.get(r[1], -1))
    kept = list({r for r in kept if r[0] == last[r[1]]})
    assert docs.columns == columns and sorted(map(tuple, docs.collect())) == sorted(kept)

    docs = stage["simhash_near_dedup"](spark, docs, folder)
    prints = {r[0]: slow_print(r[1]) for r in kept}
    root = slow_components(list(prints.values()))
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    kept = [r for r in kept if least[root[prints[r[0]]]] == r[0]]
    assert docs.columns == columns and sorted(map(tuple, docs.collect())) == sorted(kept)

    places = stage["best_fit_packing"](spark, docs, folder)
    assert {r.doc_id for r in places.collect()} == {r[0] for r in kept}


def test_run_gives_the_last_stage(spark, documents):
    folder, _ = documents
    found = corpus_pipeline.run(spark, folder).collect()
    assert found and corpus_pipeline.ORACLE_SQL is None
    ends = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length


def test_long_texts_and_clashing_columns(spark, tmp_path):
    names = ["text_key", "kept", "key", "record", "id", "__named_id", "component_id", "bucket", "node", "language"]
    long = " ".join(f"word{i % 997} und{i % 89}" for i in range(30000))
    texts = [long, long, long + " more", "a short text of its own", None, "a short text of its own"]
    rows = [(i, t, "en", "s", 1, *[i] * len(names)) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1, *[3] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    stage = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    for name, want in (("language_id", [0, 1, 2, 3, 3, 5]), ("exact_dedup", [1, 2, 5]), ("simhash_near_dedup", [1, 5])):
        docs = stage[name](spark, docs, "")
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert sorted(r.doc_id for r in docs.collect()) == want
        assert all(set(r[5:]) == {r.doc_id} for r in docs.collect())
    places = stage["best_fit_packing"](spark, docs, "").collect()
    assert {r.doc_id for r in places} == {1, 5} and sum(r.doc_id == 1 for r in places) > 20


def test_near_stage_takes_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(100)]
    other = lambda *at: " ".join("x" + w if i in at else w for i, w in enumerate(words))
    rows = [(1, other()), (2, other(50)), (3, other(10, 60)), (4, other(10, 30, 50, 70, 90))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(96)} for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    assert alike(1, 2) and alike(1, 3) and not any(alike(4, i) for i in (1, 2, 3))
    assert left == {1, 4}


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_query_of_each_operator():
    names = [n for n in queries.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in queries.QUERIES
    assert set(queries.ORACLES) <= set(queries.QUERIES)

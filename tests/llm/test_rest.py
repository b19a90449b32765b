import random
import re
import string
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearkin.llm import language_id, license_scan, sharding, simhash, topk_search

from .conftest import ODD

# -- sharding ----------------------------------------------------------------


def shards_of(df):
    return [(r.record.doc_id, r.record.text, r.shard, r.slot) for r in df.select("record", "shard", "slot").collect()]


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 2000])
def test_shards_hold_all_and_are_even(odd, bucket_bytes):
    got = shards_of(sharding.shard_records(odd, 4, bucket_bytes=bucket_bytes))
    assert sorted(((i, t) for i, t, _, _ in got), key=repr) == sorted(ODD, key=repr)
    slots = {}
    for _, _, shard, slot in got:
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(4))
    assert sharding.shard_records(odd, 4, bucket_bytes=bucket_bytes).select("shard", "slot", "record.doc_id").orderBy("shard", "slot").collect() == sorted(
        sharding.shard_records(odd, 4, bucket_bytes=bucket_bytes).select("shard", "slot", "record.doc_id").collect(), key=lambda r: (r.shard, r.slot)
    )


def test_shards_are_shuffled(frame):
    rows = [(i, f"text {i}") for i in range(600)]
    one = sorted(shards_of(sharding.shard_records(frame(rows, clash=False), 3, bucket_bytes=4000)), key=lambda r: r[2:])
    other = sorted(shards_of(sharding.shard_records(frame(rows, clash=False), 3, seed=7, bucket_bytes=4000)), key=lambda r: r[2:])
    order = [i for i, *_ in one]
    assert order != sorted(order) and order != [i for i, *_ in other]
    places = np.argsort(order)
    assert abs(np.corrcoef(places, np.arange(600))[0, 1]) < 0.2


def test_few_or_no_records(frame, empty):
    got = shards_of(sharding.shard_records(frame([(1, "a"), (2, None)], clash=False), 40))
    assert sorted(s for *_, s in got) == [0, 0] and len({s for _, _, s, _ in got}) == 2
    assert sharding.shard_records(empty, 40).count() == 0


def test_query_columns(spark, tmp_path, frame):
    frame([(1, "héllo"), (2, None)], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in sharding.op9_sharding(spark, str(tmp_path)).collect()}
    assert (rows[1].size, rows[1].text_crc32) == (22, zlib.crc32("héllo".encode())) and (rows[2].size, rows[2].text_crc32) == (16, 0)
    assert {r.law for r in rows.values()} == {"rows"} and {r.grown_shard for r in rows.values()} == {None}


# -- top-k search ------------------------------------------------------------


def brute_top(rows, queries, k):
    whole = {i: [int(np.floor(1024.0 * np.float64(np.float32(x)))) for x in v] for i, v in rows}
    out = []
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:k]  # noqa: B905  missing components are zero
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 7])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(i, np.round(rng.normal(size=6), 1).tolist()) for i in range(60)]
    rows += [(100, [0.0] * 6), (101, rows[3][1]), (102, rows[3][1]), (103, [1e-9] * 6), (104, [2.0, -1.0]), (105, [])]
    odd = [(200, None), (201, [None, 1.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>")
    queries = [0, 3, 20, 100, 101, 104, 105]
    got = topk_search.top_k(df, df.where(F.col("vec_id").isin(*queries, 202)), 5)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, queries, 5)


@pytest.mark.parametrize("block", [2048, 3])
def test_top_k_of_repeated_query_rows_and_clashing_columns(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, -1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [2.0, 4.0]), (100, [1.0, 2.0, 0.0])]
    names = ["rank", "score", "query_id", "own", "ids", "twin", "number"]
    df = spark.createDataFrame([(*r, *[1] * len(names)) for r in rows], "vec_id long, embedding array<double>, " + ", ".join(f"{n} int" for n in names))
    want = []
    for i, (q, v) in enumerate(rows):
        if q % 100 == 0:
            found = sorted((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(v, w)), j) for k, (j, w) in enumerate(rows) if k != i)[:4]  # noqa: B905
            want += [(q, n, j, -s) for n, (s, j) in enumerate(found, 1)]
    got = topk_search.top_k(df, df.where("vec_id % 100 = 0"), 4)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_with_large_values_and_few_rows(spark):
    big = float(2**40)
    df = spark.createDataFrame([(0, [big, 1.0]), (1, [0.0, 0.5]), (2, [0.0, -2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk_search.top_k(df, df.where("vec_id = 0"), 10).orderBy("rank").collect()] == [(0, 1, 1, 1024 * 512), (0, 2, 2, -2048 * 1024)]
    assert topk_search.top_k(df.limit(0), df, 10).count() == 0 and topk_search.top_k(df, df.limit(0), 10).count() == 0


# -- license scan ------------------------------------------------------------


def slow_scan(text):
    low = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, base = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    labels, score = set(base), 1.0 if starts else 0.0
    for label, template in license_scan.TEMPLATES:
        n, t = len(template.split()), set(template.split())
        for start in range(0, len(words), n):
            share = len(set(words[start : start + 2 * n]) & t) / len(t)
            if share >= license_scan.THRESHOLD:
                labels.add(label)
                score = max(score, share)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


SCANS = [
    (20, "Apache License apache license APACHE-LICENSE"),
    (21, "the mit license and the cc-by, cc by by cc by"),
    (22, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated files"),
    (23, "gnu general\npublic license"),
    (24, "all rights\nreserved"),
    (25, "reserved are all the rights, é apache licensé"),
    (26, "Licensed under CC BY-NC 4.0."),
    (27, " ".join(license_scan.TEMPLATES[6][1].split()[::-1])),
    (28, "xapache license apache licenses"),
    *((40 + i, "before it " * i + textwrap.fill(t, 60, initial_indent=" * ", subsequent_indent=" * ") + " after it" * 40) for i, (_, t) in enumerate(license_scan.TEMPLATES)),
    (80, "all of the people had rights, and the table was not reserved for them"),
]


def test_scan_equals_brute_force(frame, empty):
    rows = [*ODD, *SCANS, SCANS[0], (20, "another text with the same id")]
    got = sorted((tuple(r) for r in license_scan.license_scan(frame(rows)).collect()), key=repr)
    assert got == sorted(((i, *slow_scan(t)) for i, t in rows), key=repr)
    assert license_scan.license_scan(empty).count() == 0


def test_wrapped_notices_are_found(frame):
    rows = [s for s in SCANS if 40 <= s[0] < 80]
    got = {r.doc_id: r for r in license_scan.license_scan(frame(rows)).collect()}
    for i, (label, _) in enumerate(license_scan.TEMPLATES):
        assert label in got[40 + i].labels.split(",") and got[40 + i].score == 1.0


def test_scan_sql(spark, tmp_path, frame):
    frame([r for r in [*ODD, *SCANS] if r[0] is not None and r[0] != 4], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(license_scan.OP2_SQL)
    mine = license_scan.op2_license_scan(spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(map(tuple, mine), key=repr) == sorted(rel.fetchall(), key=repr)


# -- language ----------------------------------------------------------------

WORDS = {"en": "the of and to in is that it was for with he be on by at this have from or", "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als", "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au"}


def corpus(spark, n, seed, wrong=0.0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        text = " ".join(rnd.choice(WORDS[lang].split()) for _ in range(rnd.randint(5, 60)))
        rows.append((i, text, lang if rnd.random() >= wrong else rnd.choice(list(WORDS)), f"{lang}-host" if rnd.random() < 0.7 else "mixed", len(text), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, truth string")


def test_held_out_accuracy(spark):
    models = language_id.fit(corpus(spark, 400, 1), "lang")
    assert models.languages == ["de", "en", "fr"]
    held_out = corpus(spark, 300, 2, wrong=0.3)
    found = language_id.identify(held_out, models, F.lit(None), held_out["source"], F.lit(None))
    joined = found.join(held_out.select("doc_id", "truth"), "doc_id").collect()
    assert sum(r.language == r.truth for r in joined) / 300 > 0.98 and not any(r.rejected for r in joined)


def test_short_texts_lean_on_other_evidence(spark):
    docs = corpus(spark, 400, 3)
    models = language_id.fit(docs, "lang")
    short = spark.createDataFrame([(1000, "in", None, "de-host", 2, ""), (1001, "in", None, "en-host", 2, ""), (1002, "en", "fr", None, 2, ""), (1003, "de", "de", None, 2, "")], docs.schema)
    both = docs.unionByName(short)
    found = {r.doc_id: r for r in language_id.identify(both, models, both["lang"], both["source"], F.lit("")).where("doc_id >= 1000").collect()}
    assert found[1000].language == "de" and found[1001].language == "en"
    assert found[1002].language == "fr" and found[1003].language == "de"
    assert all(0 < r.posterior <= 1 for r in found.values())


def test_what_is_rejected(spark, odd, empty):
    docs = corpus(spark, 200, 4)
    models = language_id.fit(docs, "lang")
    rows = [(1, ""), (2, None), (3, "1234 !!! ..."), (4, "Съешь же ещё этих мягких французских булок да выпей чаю " * 3), (5, "the of and to in is that it was for"), (None, "der die und in den von zu das mit"), (6, "中文的句子在这里重复" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.language, r.rejected) for r in language_id.identify(df, models, F.lit(None), F.lit(None), F.lit(None)).collect()}
    assert found == {(1, "und", True), (2, "und", True), (3, "und", True), (4, "und", True), (5, "en", False), (None, "de", False), (6, "und", True)}
    assert language_id.identify_documents(odd).count() == len(ODD)
    assert language_id.identify_documents(empty).count() == 0
    assert language_id.keep_identified(empty).columns == empty.columns


def test_fusion_equals_brute_force(spark):
    docs = corpus(spark, 60, 5)
    models = language_id.fit(docs, "lang")
    work_docs = docs.collect()
    got = {r.doc_id: r for r in language_id.identify(docs, models, docs["lang"], docs["source"], F.lit("net")).collect()}
    k = len(models.languages)

    def text_logs(t):
        b = np.frombuffer(t.encode().lower(), np.uint8)
        b = np.where(language_id.BREAKS[b], 32, b).astype(int)
        pairs = [(x, y) for x, y in zip(b, b[1:], strict=False) if x != 32 or y != 32]
        logs = [sum(float(models.table[x << 8 | y, i]) for x, y in pairs) for i in range(k)] + [len(pairs) * -np.log(256)]
        return np.array(logs) * min(len(pairs), language_id.EVIDENCE) / len(pairs)

    logs = {r.doc_id: text_logs(r.text) for r in work_docs}
    best = {i: int(v.argmax()) for i, v in logs.items()}
    assert max(best.values()) < k
    m = language_id.SMOOTHING
    whole = np.bincount(list(best.values()), minlength=k) + 1.0
    whole /= whole.sum()
    suffix = np.bincount(list(best.values()), minlength=k)
    suffix = (suffix + m * whole) / (suffix.sum() + m)
    for r in work_docs:
        own = np.bincount([best[x.doc_id] for x in work_docs if x.source == r.source], minlength=k)
        prior = (own + m * suffix) / (own.sum() + m)
        told = np.array([(sum(best[x.doc_id] == i and x.lang == r.lang for x in work_docs) + 1.0) / (sum(b == i for b in best.values()) + k) for i in range(k)])
        post = np.append(logs[r.doc_id][:k] + np.log(prior) + np.log(told), logs[r.doc_id][k] + np.log(language_id.UND_PRIOR) - np.log(k))
        share = np.exp(post - post.max())
        assert got[r.doc_id].language == [*models.languages, "und"][int(post.argmax())]
        assert abs(got[r.doc_id].posterior - 1 / share.sum()) < 1e-6


def test_pages(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(80):
        lang = rnd.choice(list(WORDS))
        text = " ".join(rnd.choice(WORDS[lang].split()) for _ in range(30))
        rows.append((i, f"https://www.{lang}.example.{lang}/x{i}", f'<!DOCTYPE html><HTML class="a" lang="{lang}-XX"><script>var the = "of";</script><p>{text}</p></html>'))
    rows.append((99, "not an address", "<p>" + WORDS["fr"] + "</p>"))
    found = {r.doc_id: r for r in language_id.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i].language == url.split(".")[1] for i, url, _ in rows[:80]) and found[99].language == "fr" and found[99].declared is None


def test_pages_of_nothing_and_odd_pages(spark):
    kinds = "page_id long, url string, html string, lang string, text_key int, host string"
    rows = [(1, None, None, "x", 1, "y"), (2, "https://a.example/", None, "x", 1, "y"), (3, None, f'<html lang="en"><p>{WORDS["en"]}</p>', "x", 1, "y"), (4, "ftp://b", "<p>&#233;&amp;</p>", "x", 1, "y"), (5, None, f'<html lang="de"><p>{WORDS["de"]}</p>', "x", 1, "y")]
    found = {r.doc_id: r for r in language_id.identify_pages(spark.createDataFrame(rows, kinds)).collect()}
    assert {i: found[i].language for i in (1, 2, 3, 5)} == {1: "und", 2: "und", 3: "en", 5: "de"} and found[1].rejected and found[4].declared is None
    assert language_id.identify_pages(spark.createDataFrame([], kinds)).count() == 0


def test_suffixes_and_hosts_smooth_the_prior(spark):
    docs = [(i, WORDS[x], x, f"h{i % 4}.site.{x}", 1) for i, x in enumerate(["de", "fr"] * 60)] + [(900, "x", None, "new.site.de", 1), (901, "x", None, "new.site.fr", 1)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r for r in language_id.identify_documents(docs).collect()}
    assert found[900].language == "de" and found[901].language == "fr"


def test_buckets_are_nested_where_there_are_too_many(spark, frame, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_BUCKETS", 3)
    rows = [(i, f"text {i} " * 20) for i in range(300)]
    got = shards_of(sharding.shard_records(frame(rows), 7, bucket_bytes=2000))
    assert sorted((i, t) for i, t, _, _ in got) == sorted(rows)
    slots = {}
    for _, _, shard, slot in got:
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and {len(v) for v in slots.values()} == {42, 43}


def test_wrappers_give_what_their_contracts_ask(spark, frame, tmp_path):
    rows = [r for r in [*ODD, (30, "d" * 10)] if r[0] is not None]
    frame(rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    found = language_id.op3_language_id(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in rows) and {r.kept for r in found} <= {True, False}
    found = simhash.op5_simhash(spark, str(tmp_path)).collect()
    want = {i: f"{simhash.fingerprint(t or ''):016x}" for i, t in rows if i != 4}
    assert {r.doc_id: r.fingerprint for r in found if r.doc_id != 4} == want and len(found) == len(rows)
    assert {r.component_id for r in found if r.doc_id in (1, 2, 8)} == {1}


def test_more_languages_than_64(spark):
    rnd = random.Random(8)
    labels = [a + b for a in "bcdfghjk" for b in "aeiouvwxyz"]
    made = {x: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for x in labels}
    rows = [(i, " ".join(rnd.choice(made[x]) for _ in range(40)), x, x, 1) for i, x in enumerate(labels * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r for r in language_id.identify_documents(docs).collect()}
    assert all((found[i].language, found[i].declared, found[i].rejected) == (x, x, False) for i, _, x, *_ in rows)


def test_rare_labels_are_sampled(spark):
    assert language_id.rows_each([10**9, 10**9, 500], 20_000) == 9750 and language_id.rows_each([5, 7], 20_000) > 7
    rows = [(i, WORDS["en"], "en") for i in range(2000)] + [(5000 + i, WORDS["de"], "de") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.fit(docs, "lang", sample_rows=50)
    pair = ord("d") << 8 | ord("e")
    assert models.languages == ["de", "en"] and models.table[pair, 0] > models.table[pair, 1]


def test_tags_agree(spark):
    docs = corpus(spark, 90, 12).withColumn("lang", F.concat("lang", F.when(F.col("doc_id") % 2 == 0, "-XX").otherwise("_Latn")))
    assert language_id.fit(docs, "lang").languages == ["de", "en", "fr"]
    truth = {r.doc_id: r.truth for r in docs.collect()}
    assert {r.doc_id: r.declared for r in language_id.identify_documents(docs).collect()} == truth


def test_pages_keep_three_letter_codes(spark):
    rows = [(i, f"https://{x}.example/{i}", f'<html lang="{x}-PH"><p>{" ".join([WORDS[w]] * 2)}</p></html>') for i, (x, w) in enumerate([("fil", "fr"), ("fi", "de")] * 20)]
    found = language_id.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.doc_id % 2, r.declared, r.language) for r in found} == {(0, "fil", "fil"), (1, "fi", "fi")}

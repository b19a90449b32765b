"""License scan: phrases in their places, and an exact set-similarity join.

Phrases are found in the text's word sequence, whole words in order. The words
are written with a space on either side of each, so that places never share a
character and plain string functions count and locate them.

Notices are found by a containment join of text blocks with templates. A
template of n words is looked for in windows of 2 n words of the text's word
sequence, moved on by n, so neither line ends nor punctuation matter and any n
words in a row stand in one window whole. A block meets a template if it holds at
least ``THRESHOLD`` of its distinct words. Words that are in no template can't
count, so a text is first cut down to its template words and their places, and
stands as that for the rest. Template words are ranked in one global order from
the rarest in the corpus to the commonest. With a the least overlap that a
template asks for,

* prefix: the block and the template share one of their first words, all but
  a - 1 of each; only windows around such words are formed;
* length: a block of fewer than a template words is left out;
* position: from the places of a shared word on, enough words are left;

and what is left is verified. The join is on the shared word; templates are a
parameter of bounded size and are broadcast. Blocks are never joined with each
other, so neither a common line nor a hot source makes a group.

Only DataFrame operations run here.

Defined results: a null text counts as empty; no words give zero counts, null
places and empty labels; repeated rows each give a row; an empty table gives an
empty result. The score is the largest containment of a template that is met, 1
where a phrase is found, else 0.
"""

from __future__ import annotations

import functools
import math
import operator
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.llm.shared import Workspace, text_key, text_of

THRESHOLD = 0.9
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices in words, with the labels that they give.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("all-rights-reserved", "all rights reserved"),
    # whole notices, as they stand at the top of files or in license files
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details",
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license "
        "or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu lesser general public license for more details",
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    ),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def spaced(text: Column) -> Column:
    """Words with a space on either side of each, and one more at both ends."""
    return F.regexp_replace(F.concat(F.lit(" "), lower_ascii(text), F.lit(" ")), BETWEEN, "  ")


def occurrences(text: Column, part: str) -> Column:
    """Places of ``part``, which can't overlap itself."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("long")


def join_labels(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(labels))), ",")


def find_phrases(rows: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base (array of labels)
    to rows with ``spaced``."""
    rows = rows.withColumn("n_words", occurrences(F.col("spaced"), "  ") - 1)
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        words = phrase.split()
        form = " " + "  ".join(words) + " "
        there = F.contains(F.col("spaced"), F.lit(form))
        counts.append(F.when(there, occurrences(F.col("spaced"), form)).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(there, occurrences(F.substring_index("spaced", form, 1), "  ")))
        lasts.append(F.when(there, F.col("n_words") - len(words) - occurrences(F.substring_index("spaced", form, -1), "  ")))
        labels.append(F.when(there, F.lit(label)))
    return rows.withColumns(
        {
            "n_base": functools.reduce(operator.add, counts),
            "first_word": F.array_min(F.array(*firsts)),
            "last_word": F.array_max(F.array(*lasts)),
            "base": F.array_compact(F.array(*labels)),
        }
    )


def vocabulary_of(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({w for _, t in templates for w in t.split()})


def template_words(spaced: Column, vocabulary: list[str]) -> Column:
    """A text's template words with their places (pos, word)."""
    placed = F.transform(F.split(F.trim(spaced), "  "), lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    return F.filter(placed, lambda h: h["word"].isin(vocabulary))


def template_join(rows: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """doc_id, text_key, labels (array), score of the rows (doc_id, text_key,
    hits) with a block that meets a template; ``rows`` is a written table."""
    spark = rows.sparkSession
    sizes = [len(t.split()) for _, t in templates]
    words = [sorted(set(t.split())) for _, t in templates]
    need = [math.ceil(threshold * len(w) - 1e-9) for w in words]

    seen = {r["word"]: r["count"] for r in rows.select(F.explode("hits.word").alias("word")).groupBy("word").count().collect()}
    order = sorted(vocabulary_of(templates), key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order, 1)}
    entries = []
    for i, ((label, _), n, w, a) in enumerate(zip(templates, sizes, words, need, strict=True)):
        ranks = sorted(rank[x] for x in w)
        entries += [(order[r - 1], r, i, label, p, a, n, ranks) for p, r in enumerate(ranks[: len(w) - a + 1])]
    index = spark.createDataFrame(entries, "word string, rank long, template int, label string, i int, need int, n int, template_ranks array<long>")

    first = sorted({e[0] for e in entries})
    reach = 2 * max(sizes)
    anchors = F.filter("hits", lambda h: h["word"].isin(first))
    around = lambda h: F.filter("hits", lambda x: (x["pos"] > h["pos"] - reach) & (x["pos"] < h["pos"] + reach))
    found = rows.where(F.exists("hits", lambda h: h["word"].isin(first)))
    found = found.select("doc_id", "text_key", F.explode(F.transform(anchors, lambda h: F.struct(h["pos"].alias("pos"), h["word"].alias("word"), around(h).alias("near")))).alias("a"))
    own = F.floor(F.col("pos") / F.col("n")) * F.col("n")
    blocks = found.select("doc_id", "text_key", "a.*").join(F.broadcast(index), "word").withColumn("start", F.explode(F.array(own, own - F.col("n")))).where("start >= 0")
    inside = F.filter("near", lambda x: (x["pos"] >= F.col("start")) & (x["pos"] < F.col("start") + 2 * F.col("n")))
    blocks = blocks.withColumn("block", F.array_distinct(F.transform(inside, lambda x: x["word"]))).drop("near")
    in_order = F.array(*map(F.lit, order))
    candidates = blocks.where(F.size("block") >= F.col("need")).withColumn("ranks", F.array_sort(F.transform("block", lambda w: F.array_position(in_order, w))))
    j = F.array_position("ranks", F.col("rank")) - 1
    left = F.least(F.size("template_ranks") - F.col("i"), F.size("ranks") - j)
    overlap = F.size(F.array_intersect("ranks", "template_ranks"))
    met = candidates.where((j <= F.size("ranks") - F.col("need")) & (left >= F.col("need"))).withColumn("overlap", overlap).where(F.col("overlap") >= F.col("need"))
    met = met.select("doc_id", "text_key", "label", (F.col("overlap") / F.size("template_ranks")).alias("score"))
    return met.groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("labels"), F.max("score").alias("score"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, work: Workspace | None = None) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score."""
    work = work or Workspace(docs.sparkSession, "license")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_key(docs, text_col).alias("text_key"), spaced(text_of(docs, text_col)).alias("spaced"))
    rows = find_phrases(rows, phrases).withColumn("hits", template_words(F.col("spaced"), vocabulary_of(templates))).drop("spaced")
    base = work.table(rows, "scanned")  # the one pass over the texts
    met = template_join(base.select("doc_id", "text_key", "hits"), templates, threshold)
    met = met.select(F.col("doc_id").alias("met_id"), F.col("text_key").alias("met_key"), F.col("labels").alias("met"), "score")
    both = base.drop("hits").join(met, base["doc_id"].eqNullSafe(met["met_id"]) & (base["text_key"] == met["met_key"]), "left")
    return both.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        join_labels(F.col("base")).alias("base_labels"),
        join_labels(F.concat("base", F.coalesce("met", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """DuckDB SQL: every window against its template."""
    parts = {p: " " + "  ".join(p.split()) + " " for p in PHRASES}
    cut = ", ".join(f"string_split(s, '{form}') AS p{i}" for i, form in enumerate(parts.values()))
    doubled = lambda x: f"CAST((length({x}) - length(replace({x}, '  ', ''))) / 2 AS BIGINT)"
    n_base = " + ".join(f"(len(p{i}) - 1)" for i in range(len(parts)))
    first = ", ".join(f"CASE WHEN len(p{i}) > 1 THEN {doubled(f'p{i}[1]')} END" for i in range(len(parts)))
    last = ", ".join(f"CASE WHEN len(p{i}) > 1 THEN n_words - {len(p.split())} - {doubled(f'p{i}[-1]')} END" for i, p in enumerate(parts))
    labels = ", ".join(f"CASE WHEN len(p{i}) > 1 THEN '{v}' END" for i, v in enumerate(PHRASES.values()))
    templates = ", ".join(f"('{label}', string_split('{text}', ' '))" for label, text in TEMPLATES)
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""
WITH docs AS (
  SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents
), words AS (
  SELECT doc_id, regexp_replace(' ' || t || ' ', '{BETWEEN}', '  ', 'g') AS s FROM docs
), cut AS (
  SELECT doc_id, {doubled('s')} - 1 AS n_words, {cut} FROM words
), base AS (
  SELECT doc_id, n_words, CAST({n_base} AS BIGINT) AS n_base, least({first}) AS first_word, greatest({last}) AS last_word,
         list_filter([{labels}], lambda x: x IS NOT NULL) AS base FROM cut
), templates(label, n, w) AS (
  SELECT label, len(w), list_distinct(w) FROM (VALUES {templates}) AS v(label, w)
), sequences AS (
  SELECT doc_id, string_split(trim(s), '  ') AS ws FROM words
), blocks AS (
  SELECT doc_id, label, w, list_distinct(list_slice(ws, start + 1, start + 2 * n)) AS b
  FROM (SELECT *, unnest(range(0, len(ws), n)) AS start FROM sequences, templates)
), met AS (
  SELECT doc_id, list(label) AS labels, max(len(list_intersect(b, w)) / len(w)) AS score
  FROM blocks WHERE len(list_intersect(b, w)) >= ceil({THRESHOLD} * len(w) - 1e-9) GROUP BY doc_id
)
SELECT doc_id, n_words, n_base, first_word, last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score
FROM base LEFT JOIN met USING (doc_id)
"""


OP2_SQL = oracle()

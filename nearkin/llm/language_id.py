"""Language identification by Bayesian evidence fusion.

Four kinds of evidence on a document's language are added as logarithms:

* text: a byte-pair model per language, fitted here on labelled rows; a further
  class ``und`` spreads its bets evenly over all bytes, so text that no model
  expects goes to it;
* the declared language (markup's ``lang``): how often each label is declared
  for texts that read as each language;
* the address suffix and the host: prior shares of languages, smoothed
  hierarchically (host towards suffix, suffix towards the whole), from counts
  grouped over all rows of what the text alone says.

Counts are partial aggregates, so a host with a third of all rows costs one row
per task; the join back on the host is a plain equi-join that adaptive
execution splits. The fitted models and the table of declarations are bounded
by the number of languages; the table of hosts is never broadcast by force.

Defined results: a document without a letter (null and empty texts too) is
``und`` with posterior 1 and rejected; so is one that ``und`` explains best, or
whose best posterior is under ``min_posterior``. Without any labelled row all
is ``und``. Null hosts and suffixes have the whole corpus's prior, null or
unknown declarations say nothing. Repeated rows each give a row and count each.
Of labels that explain a text equally well the first by name is taken. A very long
text is read whole, a slice alone in its task. An empty table gives an empty
result; columns other than those named are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.llm.chunks import slices
from nearkin.llm.shared import Workspace, remove_rows, text_key, text_of

#: Labelled rows that the text models are fitted on, about, at most; each costs a task 256 KB a label.
SAMPLE_ROWS = 20_000
#: Of any label at least so many, or all its rows.
LABEL_ROWS = 20
#: Byte pairs that text evidence counts for at most: neighbours aren't independent.
EVIDENCE = 120
#: Weight, in rows, of what a host's or suffix's counts are smoothed towards.
SMOOTHING = 20.0
UND_PRIOR = 1e-4
MIN_POSTERIOR = 0.5
BITS = 40
#: Counts of byte pairs that a task holds before it adds up equal ones.
HELD_COUNTS = 1 << 21
#: Bytes of text whose pairs are spread out at once.
SPREAD_BYTES = 1 << 20

BREAKS = np.isin(np.arange(256), [*range(0, 97), *range(123, 128)])  # no letter, in lower case


@dataclass
class Models:
    languages: list[str]
    table: np.ndarray  # [65536, languages], float32 logarithms


def pair_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte pairs of all texts on end, pairs per text, and letters per text.

    Bytes that are no letters are one symbol, and runs of it a single pair, so
    punctuation and digits weigh little.
    """
    raw = [t.as_py().encode().lower() for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    held = np.frombuffer(b"".join(raw), np.uint8)
    plain = np.where(BREAKS[held], np.uint8(32), held)
    row = np.repeat(np.arange(len(raw)), size)
    letters = np.bincount(row[plain != 32], minlength=len(raw))
    keep = (row[1:] == row[:-1]) & ((plain[1:] != 32) | (plain[:-1] != 32))
    pairs = plain[:-1].astype(np.int32) << 8 | plain[1:]
    return pairs[keep], np.bincount(row[1:][keep], minlength=len(raw)), letters


def counting(languages: list[str]):
    number = {v: i for i, v in enumerate(languages)}

    def add(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        return code, np.bincount(at, np.concatenate(counts), len(code)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for batch in batches:
            for part, texts in slices(batch, size=SPREAD_BYTES):
                pairs, n, _ = pair_codes(texts)
                which = np.repeat(np.array([number[x] for x in part.column(0).to_pylist()], np.int64), n)
                code, count = np.unique(which << 16 | pairs, return_counts=True)
                codes.append(code)
                counts.append(count)
                held += len(code)
                if held > HELD_COUNTS:
                    code, count = add(codes, counts)
                    codes, counts, held = [code], [count], 0
        code, count = add(codes, counts)
        yield pa.RecordBatch.from_arrays([pa.array(code >> 16, pa.int32()), pa.array(code & 0xFFFF, pa.int32()), pa.array(count, pa.int64())], names=["language", "pair", "n"])

    return run


def primary(tag: Column) -> Column:
    """A language tag's first subtag: its leading letters in lower case, null if none."""
    found = F.lower(F.regexp_extract(tag.cast("string"), r"^\s*(\p{L}+)", 1))
    return F.when(found != "", found)


def rows_each(counts: list[int], rows: int) -> int:
    """How many of each label: all of what is rarer, and ``rows`` in all."""
    each, left = rows, rows
    for i, n in enumerate(sorted(counts)):
        each = left // (len(counts) - i)
        if n > each:
            break
        left -= n
    return max(each, LABEL_ROWS)


def fit(docs: DataFrame, label_col: str, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Models:
    """Text models from a sample of every label's rows, chosen by a hash of the id."""
    labelled = docs.select(primary(docs[label_col]).alias("label"), text_of(docs, text_col).alias("text"), F.xxhash64(docs[id_col]).alias("h")).where("label is not null")
    seen = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    languages = sorted(seen)
    if not languages:
        return Models([], np.zeros((1 << 16, 0), np.float32))
    each = rows_each(list(seen.values()), sample_rows)
    limits = docs.sparkSession.createDataFrame([(x, int(min(1.0, each / n) * (1 << BITS))) for x, n in seen.items()], "label string, limit long")
    sample = labelled.join(F.broadcast(limits), "label").where(F.pmod("h", F.lit(1 << BITS)) < F.col("limit"))
    found = sample.select("label", "text").mapInArrow(counting(languages), "language int, pair int, n long").groupBy("language", "pair").agg(F.sum("n").alias("n")).toArrow()
    which, pair, n = (found.column(c).to_numpy() for c in ("language", "pair", "n"))
    table = np.empty((1 << 16, len(languages)), np.float32)
    for i in range(len(languages)):
        counts = np.bincount(pair[which == i], n[which == i], 1 << 16).reshape(256, 256)
        second = counts.sum(axis=0, keepdims=True) + 0.05
        second /= second.sum()
        table[:, i] = np.log((counts + 5.0 * second) / (counts.sum(axis=1, keepdims=True) + 5.0)).ravel()
    return Models(languages, table)


def scoring(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            for part, texts in slices(batch, batch.num_columns - 1, SPREAD_BYTES):
                pairs, n, letters = pair_codes(texts)
                total = np.zeros((len(n), table.shape[1] + 1))
                some = np.flatnonzero(n)
                if len(some):
                    edges = (np.cumsum(n) - n)[some]
                    for k in range(table.shape[1]):
                        total[some, k] = np.add.reduceat(table[pairs, k], edges, dtype=np.float64)
                total[:, -1] = n * -np.log(256.0)
                total *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * total.shape[1], pa.int32()), pa.array(total.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(letters, pa.int64()), flat], names=[*part.schema.names[:-1], "letters", "text"])

    return run


def log_shares(counts: Column, towards: Column) -> Column:
    """Smoothed shares: counts drawn towards other shares."""
    n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, towards, lambda c, p: (c + F.lit(SMOOTHING) * p) / (n + F.lit(SMOOTHING)))


def identify(docs: DataFrame, models: Models, declared: Column, host: Column, suffix: Column, id_col: str = "doc_id", text_col: str = "text", min_posterior: float = MIN_POSTERIOR, work: Workspace | None = None) -> DataFrame:
    """doc_id, text_key, language, posterior, text_language, declared, rejected."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "language")
    names = [*models.languages, "und"]
    k = len(models.languages)
    known = primary(declared)
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        text_key(docs, text_col).alias("text_key"),
        F.when(known.isin(models.languages), known).alias("declared") if k else F.lit(None).cast("string").alias("declared"),
        host.cast("string").alias("host"),
        F.coalesce(suffix.cast("string"), F.lit("")).alias("suffix"),
        text_of(docs, text_col).alias("text"),
    )
    schema = "doc_id long, text_key long, declared string, host string, suffix string, letters long, text array<double>"
    scored = rows.mapInArrow(scoring(spark.sparkContext.broadcast(models.table)), schema)
    best = F.array_position("text", F.array_max("text")).cast("int") - 1
    scored = work.table(scored.withColumn("best", F.when((F.col("letters") > 0) & (best < k), best)), "scores")
    if not k:
        return scored.select("doc_id", "text_key", F.lit("und").alias("language"), F.lit(1.0).alias("posterior"), F.lit("und").alias("text_language"), "declared", F.lit(True).alias("rejected"))

    # sparse up to here, so that many languages aren't as many aggregates
    counts = work.table(scored.where("best is not null").groupBy("host", "suffix", "best").agg(F.count(F.lit(1)).cast("double").alias("n")), "counts")

    def dense(rows: DataFrame, key: str) -> DataFrame:
        held = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("held"))
        return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0.0))).alias("counts"))

    suffixes = dense(counts.groupBy("suffix", "best").agg(F.sum("n").alias("n")), "suffix")
    suffixes = work.table(suffixes.withColumnRenamed("counts", "suffix_counts"), "suffixes")
    of_hosts = counts.where("host is not null")
    hosts = dense(of_hosts.groupBy("host", "best").agg(F.sum("n").alias("n")), "host").join(of_hosts.groupBy("host").agg(F.min("suffix").alias("suffix")), "host")
    seen = {r["best"]: r["n"] for r in counts.groupBy("best").agg(F.sum("n").alias("n")).collect()}
    whole = [seen.get(i, 0.0) + 1.0 for i in range(k)]
    shares = F.array(*(F.lit(c / sum(whole)) for c in whole))
    said = {(r["declared"], r["best"]): r["count"] for r in scored.where("best is not null and declared is not null").groupBy("declared", "best").count().collect()}
    told = [sum(said.get((d, i), 0) for d in models.languages) for i in range(k)]
    evidence = [(d, [float(np.log((said.get((d, i), 0) + 1.0) / (told[i] + k))) for i in range(k)]) for d in models.languages]
    evidence = F.broadcast(spark.createDataFrame(evidence, "declared string, tell array<double>"))

    suffix_shares = log_shares(F.col("suffix_counts"), shares)
    by_suffix = suffixes.select("suffix", suffix_shares.alias("suffix_shares"))
    by_host = hosts.join(by_suffix, "suffix", "left")
    # written, so that the join's both sides are plain exchanges and a hot host's can be split
    by_host = work.table(by_host.select("host", log_shares(F.col("counts"), F.coalesce("suffix_shares", shares)).alias("host_shares")), "shares")
    joined = scored.join(by_suffix, "suffix", "left").join(by_host, "host", "left").join(evidence, "declared", "left")
    prior = F.coalesce("host_shares", "suffix_shares", shares)
    tell = F.coalesce("tell", F.array(*(F.lit(0.0) for _ in range(k))))
    fused = F.zip_with(F.zip_with(F.slice("text", 1, k), F.transform(prior, lambda p: F.log(p)), lambda a, b: a + b), tell, lambda a, b: a + b)
    unknown = F.element_at("text", k + 1) + F.lit(float(np.log(UND_PRIOR))) + F.when(F.col("declared").isNotNull(), F.lit(float(-np.log(k)))).otherwise(0.0)
    logs = joined.withColumn("logs", F.concat(fused, F.array(unknown))).withColumn("top", F.array_max("logs"))
    weight = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    name = F.array(*map(F.lit, names))
    lettered = F.col("letters") > 0
    out = logs.select(
        "doc_id",
        "text_key",
        F.when(lettered, F.element_at(name, F.array_position("logs", F.col("top")).cast("int"))).otherwise("und").alias("language"),
        F.when(lettered, 1.0 / weight).otherwise(1.0).alias("posterior"),
        F.when(F.col("best").isNotNull(), F.element_at(name, F.col("best") + 1)).otherwise("und").alias("text_language"),
        "declared",
    )
    return out.withColumn("rejected", (F.col("language") == "und") | (F.col("posterior") < min_posterior))


def identify_documents(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """Documents: ``lang`` is what is declared, ``source`` the host, whose suffix
    counts where it has one."""
    return identify(docs, fit(docs, "lang"), docs["lang"], docs["source"], suffix_of(docs["source"]), work=work)


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(F.lower(host), r"\.([a-z0-9-]+)$", 1)


def identify_pages(pages: DataFrame) -> DataFrame:
    """Web pages: markup language, host and suffix from the address, visible text.

    A null page is empty text and so ``und``; a null or odd address has no host
    and the whole corpus's prior; markup without a language declares none.
    """
    markup = F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&#?\w+;", " ")
    host = F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col("page_id").alias("doc_id"), text.alias("text"), primary(markup).alias("lang"), F.when(host != "", host).alias("host"))
    return identify(rows, fit(rows, "lang"), rows["lang"], rows["host"], suffix_of(rows["host"]))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, as they are."""
    work = Workspace(docs.sparkSession, "language")
    found = identify_documents(docs, work)
    return remove_rows(docs, work.table(found.where("rejected").select("doc_id", "text_key"), "rejected"))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    found = identify_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "text_language", "declared", (~F.col("rejected")).alias("kept"))


def pages_language_id(spark, sf_dir: str) -> DataFrame:
    found = identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select(F.col("doc_id").alias("page_id"), "language", F.round("posterior", 6).alias("posterior"), "text_language", "declared", (~F.col("rejected")).alias("kept"))

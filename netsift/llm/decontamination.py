"""Benchmark decontamination by winnowing (operator 10); DataFrame functions only.

Of each text the smallest 5-gram hash of every 6 consecutive 5-grams is kept,
so any shared span of 10 words or more shares a kept hash. Documents whose
fingerprints meet one of the benchmark's are read again; around each hit the
10-word windows are compared word for word with the items' windows. An item
of fewer than 10 words is one window, found by the hash of all its words.

Null text has no words. Items without words match nothing. Repeated rows each
get the row's result; repeated items count once. An item without an id marks
words as hit but is not listed. An empty benchmark hits nothing.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import column_index, narrow, stored, with_plain_names

GRAM = 5
SPAN = 10
#: 5-grams per sliding window: the guarantee is GRAM + PER_WINDOW - 1 = SPAN words.
PER_WINDOW = SPAN - GRAM + 1
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def from_one_to(n: Column) -> Column:
    """Array 1..n, empty when n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def gram_hashes(words: Column, size: int) -> Column:
    """Hash of the ``size`` words from each position on."""
    return F.transform(from_one_to(F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size), F.lit(size)))


def winnowed(grams: Column) -> Column:
    """The distinct minima of all windows of consecutive hashes."""
    return F.array_distinct(F.transform(from_one_to(F.size(grams) - (PER_WINDOW - 1)),
                                        lambda i: F.array_min(F.slice(grams, i, PER_WINDOW))))


def with_fingerprints(rows: DataFrame, short: list[int]) -> DataFrame:
    """Adds ``fingerprints`` to rows with ``words``; ``short``: item lengths below SPAN that occur."""
    out = rows.withColumn("grams", gram_hashes(F.col("words"), GRAM)).withColumn("fingerprints", winnowed(F.col("grams")))
    for size in short:
        out = out.withColumn("fingerprints", F.concat("fingerprints", F.array_distinct(gram_hashes(F.col("words"), size))))
    return out.drop("grams")


def windows(words: Column, starts: Column, size) -> Column:
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(size).alias("length"),
                                                  F.array_join(F.slice(words, s, size), " ").alias("window")))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, window) of an item table (item_id, words): its windows, or its whole text when shorter."""
    n = F.size("words")
    of_item = F.when(n >= SPAN, F.transform(from_one_to(n - (SPAN - 1)),
                                            lambda s: F.array_join(F.slice(F.col("words"), s, SPAN), " "))) \
        .otherwise(F.array(F.array_join("words", " ")))
    return benchmark.filter(n > 0).select("item_id", n.alias("n"), F.explode_outer(of_item).alias("window")).distinct()


def marked_starts(size: int) -> Column:
    """Where ``size`` words of ``words`` have a hash among ``marks``."""
    return F.filter(from_one_to(F.col("n") - (size - 1)),
                    lambda i: F.array_contains(F.col("marks"), F.xxhash64(F.slice("words", i, size), F.lit(size))))


def benchmark_spans(docs: DataFrame, named: DataFrame, benchmark: DataFrame, short: list[int]) -> tuple[DataFrame, DataFrame]:
    """Spans (doc_id, digest, start, length, window), starts counted in words from 1, and item windows (item_id, window)."""
    items = benchmark.withColumn("words", words_of(F.col("text"))).select("item_id", "words")
    marks = with_fingerprints(items.filter(F.size("words") >= SPAN), []).select(F.explode_outer("fingerprints").alias("mark"))
    for size in short:
        whole = items.filter(F.size("words") == size).select(F.xxhash64("words", F.lit(size)).alias("mark"))
        marks = marks.unionAll(whole)
    hits = named.select("doc_id", "digest", F.explode("fingerprints").alias("mark")) \
        .join(marks.distinct(), "mark", "left_semi").groupBy("doc_id", "digest").agg(F.collect_set("mark").alias("marks"))
    hits = stored(hits, "fingerprint-hits", large=True).select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), "marks")
    again = docs.withColumn("digest", F.xxhash64("text")).join(
        hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest"))) \
        .select("doc_id", "digest", "marks", words_of(F.col("text")).alias("words"))
    again = again.withColumn("grams", gram_hashes(F.col("words"), GRAM)).withColumn("n", F.size("words"))
    at = F.filter(from_one_to(F.size("grams")), lambda i: F.array_contains(F.col("marks"), F.element_at("grams", i)))
    starts = F.when(F.col("n") >= SPAN, F.array_distinct(F.flatten(F.transform(
        F.col("at"), lambda i: F.sequence(F.greatest(F.lit(1), i - (PER_WINDOW - 1)), F.least(i, F.col("n") - (SPAN - 1))))))) \
        .otherwise(F.array().cast("array<int>"))
    found = again.withColumn("at", at).withColumn("starts", starts) \
        .withColumn("found", windows(F.col("words"), F.col("starts"), SPAN))
    for size in short:
        found = found.withColumn("short_at", marked_starts(size)) \
            .withColumn("found", F.concat("found", windows(F.col("words"), F.col("short_at"), size)))
    windows_of_items = item_windows(items).select("item_id", "window")
    # The outer form: a filter inferred for explode() would be pushed below and repeat all the expressions above.
    spans = found.select("doc_id", "digest", F.explode_outer("found").alias("f")).select("doc_id", "digest", "f.*") \
        .join(windows_of_items.select("window").distinct(), "window", "left_semi")
    return spans, windows_of_items


def covered(spans: Column) -> Column:
    """Words inside at least one (start, length) of the array."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc, s):
        end = s["start"] + s["length"]
        more = F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + more).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda acc: acc["n"].cast("bigint"))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their word counts, spans, item windows) of documents (doc_id, text) and items (item_id, text)."""
    lengths = benchmark.select(F.size(words_of(F.col("text"))).alias("n")).filter(f"n between 1 and {SPAN - 1}").distinct()
    short = sorted(r["n"] for r in lengths.collect())  # at most SPAN - 1 numbers
    named = docs.select("doc_id", F.xxhash64("text").alias("digest"), words_of(F.col("text")).alias("words"))
    named = with_fingerprints(named, short).select("doc_id", "digest", F.size("words").cast("bigint").alias("n_words"), "fingerprints")
    named = stored(named, "fingerprints")
    spans, of_items = benchmark_spans(docs, named, benchmark, short)
    return named.select("doc_id", "digest", "n_words"), stored(spans, "benchmark-spans", large=True), of_items


def items_of(benchmark: DataFrame) -> DataFrame:
    return narrow(benchmark, item_id=("item_id", "string"), text=("text", "string"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``."""
    docs = narrow(docs, doc_id=(doc_id, "bigint"), text=(text, "string"))
    rows, spans, of_items = benchmark_hits(docs, items_of(benchmark))
    hit = spans.groupBy("doc_id", "digest").agg(covered(F.collect_set(F.struct("start", "length"))).alias("n_hit"))
    listed = spans.select("doc_id", "digest", "window").distinct().join(of_items, "window") \
        .groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = same_row(hit, listed).select(hit["doc_id"].alias("hit_id"), hit["digest"].alias("hit_digest"), "n_hit", "items")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return rows.join(found, rows["doc_id"].eqNullSafe(found["hit_id"]) & (rows["digest"] == found["hit_digest"]), "left") \
        .select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
                F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def same_row(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, left["doc_id"].eqNullSafe(right["doc_id"]) & (left["digest"] == right["digest"]))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no span of the benchmark, with all their columns."""
    _, spans, _ = benchmark_hits(narrow(docs, doc_id=(doc_id, "bigint"), text=(text, "string")), items_of(benchmark))
    hit = spans.select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest")).distinct()
    plain, names = with_plain_names(docs)
    t, i = f"c{column_index(docs, text)}", f"c{column_index(docs, doc_id)}"
    same = F.col(i).cast("bigint").eqNullSafe(F.col("hit_id")) & (F.xxhash64(F.col(t).cast("string")) == F.col("hit_digest"))
    return plain.join(hit, same, "left_anti").toDF(*names)

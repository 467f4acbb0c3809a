"""Rows for the tests of the training-data operators, and plain restatements of their results."""

import hashlib
import re

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType()),
                   # names that the operators use themselves
                   *[StructField(c, StringType()) for c in ("TEXT", "key", "n", "label", "digest", "words", "component", "kept",
                                                            "n_words", "whole", "lists", "part", "marks", "c0", "ids")],
                   StructField("n", IntegerType())])
PLAIN = StructType(DOCS.fields[:5])
EXTRA = len(DOCS.fields) - 5


def docs(spark, rows, schema=DOCS):
    """rows: (doc_id, text[, lang])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, *[None] * (len(schema.fields) - 5)) for r in rows]
    return spark.createDataFrame(full, schema)


def sentence(k, n=40):
    return " ".join(f"w{(k * 31 + i * 7) % 997}" for i in range(n))


LONG = " ".join(f"long{i % 5000} word" for i in range(20_000))
EDGES = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here at all"), (4, sentence(1)), (4, sentence(1)), (5, sentence(1)),
         (6, sentence(2)), (7, LONG), (8, "a"), (9, "é😀 ñ"), (10, "aaaa " * 300), (11, "x" * 120)]


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def brute_removed(rows):
    """op 7 by comparing every 50-byte string."""
    key = lambda d: (d is None, d or 0)
    least = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - 49):
            w = raw[i:i + 50]
            if w not in least or key(d) < key(least[w]):
                least[w] = d
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if key(least[raw[i:i + 50]]) < key(d):
                gone[i:i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    """op 6 by comparing all pairs: list of (doc_id, n_shingles, component_id), one per row."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))

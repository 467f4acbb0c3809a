import random
import re
from collections import Counter

import numpy as np
import pytest

from netsift.llm import collocations as C
from tests.llm import helpers as H


def brute(rows, least, top):
    """op 11 by counting all phrases in a dictionary."""
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found.setdefault(lang, []).append((p, a, f[lang, p[:k]], f[lang, p[k:]], score))
    out = []
    for lang, all_ in found.items():
        kept = [x for x in all_ if not any(len(y[0]) > len(x[0]) and y[1] >= x[1] and any(
            y[0][i:i + len(x[0])] == x[0] for i in range(len(y[0]) - len(x[0]) + 1)) for y in all_)]
        kept.sort(key=lambda x: (-x[4], -x[1], " ".join(x[0]).encode()))
        out += [(lang, i + 1, " ".join(p), a, l, r, n[lang], s) for i, (p, a, l, r, s) in enumerate(kept[:top])]
    return sorted(out)


def texts(seed, docs=60):
    rng = random.Random(seed)
    fixed = [" ".join(f"p{rng.randint(0, 30)}" for _ in range(rng.randint(2, 9))) for _ in range(8)]
    rows = []
    for d in range(docs):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts.append(rng.choice(fixed) if rng.random() < .5 else " ".join(f"W{rng.randint(0, 12)}" for _ in range(rng.randint(0, 9))))
        sep = [". ", " ", ",", "\n", "\t", "  ", ";x!", "\r\n", "\x0b", "\x1c"]
        rows.append(("".join(p + rng.choice(sep) for p in parts), rng.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", None), ("É é É é É É", "fr"), ("a a a a a a a a. A a", "fr"), ("one", "xx")]


@pytest.mark.parametrize("seed,least,top", [(2, 3, 7), (3, 1, 50)])
def test_equals_brute_force(spark, seed, least, top):
    rows = texts(seed)
    docs = H.docs(spark, [(i, t, lang) for i, (t, lang) in enumerate(rows)]).repartition(3)
    docs = docs.toDF(*[{"n": "f", "TEXT": "block"}.get(c, c) for c in docs.columns])
    assert sorted(tuple(r) for r in C.collocations(docs, least, top).collect()) == brute(rows, least, top)


def test_other_blocks_and_widths_give_the_same(spark):
    rows = texts(4)
    docs = H.docs(spark, [(i, t, lang) for i, (t, lang) in enumerate(rows)], H.PLAIN)
    want = [tuple(r) for r in C.collocations(docs, 4, 30).collect()]
    phrases, words, totals = C.frequent_phrases(docs.select("text", "lang"), 4)
    for blocks in (1, 7):
        chunks = C.stored(C.chunks(docs.select("text", "lang").repartition(5)), "c")
        ids = C.stored(C.sequences(chunks, words, dictionary=0 if blocks == 1 else C.DICTIONARY), "s")
        bits = {r["lang"]: 9 for r in words.select("lang").distinct().collect()}  # any width that the ids fit
        for k in (2, 5):
            got = C.phrase_counts(ids, k, bits, blocks, 4, None).collect()
            assert sorted((r.lang, *r.ids, r.f) for r in got) == \
                sorted((r.lang, *r.ids, r.f) for r in phrases.collect() if len(r.ids) == k)
    assert sorted(want) == brute(rows, 4, 30)


def test_empty_table(spark):
    assert C.collocations(H.docs(spark, [])).collect() == []


@pytest.mark.parametrize("k,b", [(1, 1), (2, 13), (3, 17), (4, 16), (4, 17), (5, 13), (5, 17), (5, 25), (2, 30)])
def test_filter_is_lossless(k, b):
    rng = np.random.default_rng(k * b)
    ids = rng.integers(0, 1 << b, (3000, k))
    ids = np.concatenate([ids, ids[:500], ids[:100]])
    f = C.Filter(k, b)
    for part in np.array_split(ids, 7):
        f.add(part)
    got = Counter()
    for block_bits in (1, 5):
        got.clear()
        for block, raw, counts in f.blocks(block_bits):
            n = int((np.frombuffer(counts, np.uint8) < 128).sum())
            left, right = C.read_remainders(raw, n, block, f.half - min(block_bits, f.half), f.half)
            rows = C.unpacked(*C.restored(left, right, f.half), k, b)
            for row, c in zip(rows.tolist(), C.read_varints(counts, n).tolist()):
                got[tuple(row)] += c
        assert got == Counter(map(tuple, ids.tolist()))


def test_varints():
    x = np.array([0, 1, 127, 128, 2**32, 2**63, 2**64 - 1], np.uint64)
    assert (C.read_varints(C.varints(x), len(x)) == x).all() and C.varints(x[:0]) == b"" and len(C.read_varints(b"", 0)) == 0


def test_scores_beyond_64_bits(spark):
    big = 10**11
    phrases = spark.createDataFrame([("en", [1], big), ("en", [2], big), ("en", [1, 2], big - 1)], "lang string, ids array<bigint>, f bigint")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n bigint")
    assert C.scored(phrases, totals).first().score == 1000 * (big - 1) * 10**13 // (big * big)

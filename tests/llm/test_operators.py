import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsift.llm import bpe, decontamination, html_text, language, licenses, ngram_join, quality, suffix_dedup, token_counts, url_filter
from tests.llm import helpers as H


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.default_path())


# -- every operator on nulls, empty and long texts, repeated rows, empty tables, clashing names --------------------

BENCH = [(1, H.sentence(1)[:90]), (2, None), (3, ""), (4, "long7 word long8")]


def bench(spark):
    return spark.createDataFrame(BENCH, "item_id bigint, text string")


OPERATORS = {
    "quality": lambda spark, d: quality.quality_rules(d),
    "keep_good": lambda spark, d: quality.keep_good(d),
    "language": lambda spark, d: language.language_id(d),
    "licenses": lambda spark, d: licenses.license_scan(d),
    "ngram": lambda spark, d: ngram_join.ngram_jaccard_join(d),
    "one_of_each": lambda spark, d: ngram_join.one_of_each_group(d),
    "suffix": lambda spark, d: suffix_dedup.repeat_digests(d),
    "without_repeats": lambda spark, d: suffix_dedup.without_repeats(d),
    "bpe": lambda spark, d: bpe.round_trip_digests(d, bpe.default_path()),
    "encode": lambda spark, d: bpe.encode_documents(d, bpe.default_path()),
    "decontaminate": lambda spark, d: decontamination.decontaminate(d, bench(spark)),
    "without_contaminated": lambda spark, d: decontamination.without_contaminated(d, bench(spark)),
    "counts": lambda spark, d: token_counts.token_counts(d, bpe.default_path()),
}
FEWER = {"keep_good", "one_of_each", "without_contaminated", "counts"}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(spark, name):
    out = OPERATORS[name](spark, H.docs(spark, H.EDGES)).collect()
    assert len(out) == len(H.EDGES) or name in FEWER and len(out) < len(H.EDGES)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, H.docs(spark, [])).collect() == []


# -- 1 ---------------------------------------------------------------------------------------------------------------

URLS = [(1, "http://A.example.COM/en/1?x"), (2, "https://www.example.com/en/2"), (3, "http://b.net/es/3#t"), (4, "http://b.net/fr/x"),
        (5, "http://b.net/de/x"), (6, None), (7, "no scheme/en/"), (8, "http://com"), (9, "ftp://xcom/en/"), (10, "http://b.org//"),
        (11, "http://example.com/en/"), (11, "http://example.com/en/"), (12, "")]


def test_url_rules(spark):
    d = spark.createDataFrame([(*r, None, None) for r in URLS], "page_id bigint, url string, host string, URL string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(d).collect()}
    assert got == {
        (1, "a.example.com", "/en/1", "example.com/en/", "block"), (2, "www.example.com", "/en/2", "www.example.com/en/", "allow"),
        (3, "b.net", "/es/3", "net/es/", "block"), (4, "b.net", "/fr/x", "net/fr/", "block"), (5, "b.net", "/de/x", None, "allow"),
        (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "com", "", None, "allow"), (9, "xcom", "/en/", None, "allow"),
        (10, "b.org", "//", None, "allow"), (11, "example.com", "/en/", "example.com/en/", "block"), (12, "", "", None, "allow")}
    assert url_filter.url_filter(d.limit(0)).collect() == []


def test_url_templates_learn_from_labels(spark):
    """Blocked urls of one shape make the template bad for the unlabelled ones; a mixed shape stays."""
    rows = [(i, f"http://h.org/x/{i}/a{i}") for i in range(30)] + [(100 + i, f"http://h.org/x/{i}/b") for i in range(30)]
    rules = [(f"h.org/x/{i}/a", "block") for i in range(25)] + [(f"h.org/x/{i}/b", "allow") for i in range(25)]
    out = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id bigint, url string"), rules).collect()}
    assert all(out[i].verdict == "block" and out[i].rule is None for i in range(25, 30))
    assert all(out[100 + i].verdict == "allow" for i in range(30))
    assert out[0].template == "/x/{n}/*" and out[100].template == "/x/{n}/b"


@pytest.mark.parametrize("size", [1, 10])
def test_url_few_labels_do_not_reject_the_rest(spark, size):
    """3 of 100 urls blocked leave the others allowed at every size."""
    rows = [(i, f"http://h.net/{'es' if i % 100 < 3 else 'x' + chr(97 + i % 26) + chr(97 + i // 26 % 26)}/{i}") for i in range(100 * size)]
    out = url_filter.url_filter(spark.createDataFrame(rows, "page_id bigint, url string")).collect()
    assert {(r.rule, r.verdict) for r in out} == {("net/es/", "block"), (None, "allow")} and {r.template for r in out} == {"/*/{n}"}


def test_url_levels_beyond_six(spark):
    deep = "a/b/c/d/e/f/g"
    rows = [(i, f"http://h.org/{deep}/{i}/a{i}") for i in range(30)] + [(100 + i, f"http://h.org/{deep}/{i}/b") for i in range(30)]
    rows += [(200, "http://one.org/" + "x/" * 300)]
    rules = [(f"h.org/{deep}/{i}/a", "block") for i in range(25)] + [(f"h.org/{deep}/{i}/b", "allow") for i in range(25)]
    out = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id bigint, url string"), rules).collect()}
    assert out[0].template == f"/{deep}/{{n}}/*" and out[100].template == f"/{deep}/{{n}}/b"
    assert all(out[i].verdict == "block" and out[i].rule is None for i in range(25, 30)) and out[200].template == "/" + "/".join("x" * 300)


# -- 2 ---------------------------------------------------------------------------------------------------------------

def test_token_counts(spark, library):
    rows = [(i, H.sentence(i, 1 + i * 13 % 90)) for i in range(60)] + [(99, None), (100, H.LONG)]
    lengths = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    sums = token_counts.token_counts(H.docs(spark, rows), bpe.default_path()).cache()
    got = {r.n_tokens: r for r in sums.collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert r.n_docs == lengths.count(limit)
        assert r.docs_at_least == sum(x >= limit for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= limit)
        assert r.truncated_tokens == sum(min(x, limit) for x in lengths)
    for limit in (0, 1, 17, 100, 10**6):
        assert token_counts.truncated_total(sums, limit).first().tokens == sum(min(x, limit) for x in lengths)
    assert token_counts.quantile(sums, 0.5).first().length == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    per = token_counts.token_counts(H.docs(spark, rows), bpe.default_path(), by=["source"])
    assert per.columns[0] == "source" and per.agg(F.sum("n_docs")).first()[0] == len(rows)


# -- 3 ---------------------------------------------------------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    from tests.conftest import SF001
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    out = language.language_id(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(out) > 100 and np.mean([r.lang_pred == r.lang for r in out]) >= 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_backs_off_to_ngrams(spark):
    d = H.docs(spark, [(i, "the cat sat with another thing", "en") for i in range(1, 40)]
               + [(i, "der schöne über können", "de") for i in range(40, 80)], H.PLAIN)
    model = language.learn(d.select("doc_id", "text", "lang"))
    scorer = language.Scorer(model)
    assert scorer.predict("anotherthing") == ("en", 1.0) and scorer.predict("überkönnen")[0] == "de"
    assert scorer.predict("12 !?") == ("und", 0.0) and scorer.predict(None) == ("und", 0.0)
    assert language.Scorer(language.learn(d.select("doc_id", "text", "lang").limit(0))).predict("the") == ("und", 0.0)


def test_language_bounds_keep_rare_languages(spark):
    rare = [f"ñandu{a}{b}" for a in "abcdef" for b in "ghijkl"]
    rows = [(i, " ".join(f"the{chr(97 + (i + k) % 26)}{chr(97 + k % 26)}" for k in range(30)), "en") for i in range(600)]
    rows += [(1000 + i, " ".join(rare * 2), "gn") for i in range(3)]
    d = H.docs(spark, rows, H.PLAIN).select("doc_id", "text", "lang")
    params = language.LanguageParams(max_docs=60, max_entries=80)
    model = language.learn(d, params)
    assert model.languages == ["en", "gn"]
    assert all(language.Scorer(model).predict(w)[0] == "gn" for w in rare) and language.Scorer(model).predict(rows[0][1])[0] == "en"
    assert all(w in model.tables[0] for w in rare)
    assert all(len(t) <= params.max_entries for t in model.tables)
    assert language.equal_part([3, 600], 60) == 57 and language.equal_part([1, 2], 60) == 2 and language.equal_part([], 5) == 0
    assert language.equal_part([50, 50, 50], 60) == 20


# -- 4 ---------------------------------------------------------------------------------------------------------------

def test_quality_base_counts():
    text = "a b # <c>\n\n  \na b # <c>\na b # <c>"
    assert quality.base_counts(text) == (12, 18, 9, 2, 12)  # the span at word 0 comes again at word 4
    words = [f"w{i}" for i in range(10)]
    assert quality.repeated_words(words + words) == 20
    assert quality.repeated_words(words[:8] + ["x"] + words[:8]) == 16 and quality.repeated_words(words[:7] * 2) == 0
    rng = random.Random(1)
    for _ in range(100):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 60))]
        spans = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        hit = {i + k for i, s in enumerate(spans) if spans.count(s) > 1 for k in range(8)}
        assert quality.repeated_words(w) == len(hit)


def test_quality_bands():
    import base64
    rng = random.Random(2)
    import zstandard
    z, bands = zstandard.ZstdCompressor(level=3), quality.CompressionBands()
    noise = base64.b64encode(rng.randbytes(6000)).decode()
    prose = " ".join(rng.choice("the of and to in is was he for it with as his on be at by had not are".split()) + rng.choice(["", "ing", "ed", "ly"])
                     + rng.choice("abcdefgh") for _ in range(900))
    assert quality.judge(prose, bands, z)[-1] is True
    assert quality.judge(" ".join(noise[i:i + 6] for i in range(0, len(noise), 6)), bands, z)[-1] is False
    assert quality.judge("word other " * 400, bands, z)[-1] is False


def test_quality_judges_every_chunk():
    """Noise of less than a chunk at the end, and noise in a text of less than two chunks."""
    import zstandard
    rng, z, bands = random.Random(3), zstandard.ZstdCompressor(level=3), quality.CompressionBands()
    noise = "".join(chr(rng.randrange(33, 127)) + " " * (i % 9 == 8) for i in range(2000))
    prose = " ".join(rng.choice("the of and to in is was he for it with as his on be at by had not are".split()) + rng.choice(["", "ing", "ed", "ly"])
                     + rng.choice("abcdefgh") for _ in range(900))
    for text in (prose[:1024] + noise[:700], prose[:2048] + noise[:1000], noise[:1024] + prose[:1000]):
        low, high = quality.whole_band(len(text), bands)
        assert low <= quality.compression(text.encode(), bands, z)[0] <= high and not quality.judge(text, bands, z)[-1]
    for n in (300, 1023, 1024, 1500, 2047, 2048, 3000):
        whole, share, good = quality.compression(prose[:n].encode(), bands, z)
        assert share == 0 and good


# -- 5 ---------------------------------------------------------------------------------------------------------------

def test_licenses(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
    rows = [(1, mit), (2, "Text.\nReleased under the MIT License."), (3, "no end\nLicensed under CC BY-NC 4.0.\nmore"),
            (4, "Licensed under the Apache License, Version 2.0. This work is licensed under the GNU General Public License, version 3."),
            (5, "the license of all things"), (6, None)]
    got = H.by_id(licenses.license_scan(H.docs(spark, rows)))
    assert [got[i].licenses for i in range(1, 7)] == ["MIT", "MIT", "CC-BY-NC-4.0", "Apache-2.0,GPL-3.0", "", ""]
    assert got[1].n_sentences == 3 and got[4].kinds == "copyleft,permissive" and got[6].n_licenses == 0


def test_known_sentences_hold_a_cue_and_are_normalised():
    import re
    for texts in licenses.SENTENCES.values():
        for t in texts:
            assert re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", t)
            assert any(c in t for c in licenses.CUES)


SPDX = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "GPL-2.0-only": "GPL-2.0",
        "GPL-2.0-or-later": "GPL-2.0", "LGPL-3.0-only": "LGPL", "LGPL-2.1-only": "LGPL", "AGPL-3.0-only": "AGPL-3.0", "BSD-3-Clause": "BSD",
        "BSD-2-Clause": "BSD", "MPL-2.0": "MPL-2.0"}


def test_license_tags_in_their_standard_spelling(spark):
    import re
    known = {t for texts in licenses.SENTENCES.values() for t in texts if t.startswith("spdx ")}
    assert known == {"spdx license identifier " + re.sub("[^a-z0-9]+", " ", i.lower()) for i in SPDX}
    rows = [(i, form.format(tag)) for i, (form, tag) in enumerate(
        (form, tag) for tag in SPDX for form in ("SPDX-License-Identifier: {}", "#!/bin/sh\n# SPDX-License-Identifier: {}\nset -e\n",
                                                 "/* SPDX-License-Identifier:\t{} */\nint x;", "License: SPDX-License-Identifier: {}"))]
    rows += [(100, "Name: x\nLicense: MIT\nAuthor: y"), (101, "License: Released under the MIT License. More"), (102, "MIT License: see below"),
             (103, "The old license: MIT"), (104, "License: mine")]
    got = H.by_id(licenses.license_scan(H.docs(spark, rows)))
    assert [got[i].licenses for i in range(4 * len(SPDX))] == [name for name in SPDX.values() for _ in range(4)]
    assert [got[i].licenses for i in range(100, 105)] == ["MIT", "MIT", "MIT", "", ""]
    assert all(r.n_sentences == (r.licenses != "") for r in got.values())


def test_license_cues_are_single_words(spark):
    assert all(" " not in w for w in licenses.CUE_WORDS)
    assert all(any(w in t for w in licenses.CUE_WORDS) for texts in licenses.SENTENCES.values() for t in texts)
    rows = [(1, "Text.\nAll rights\nreserved."), (2, "All rights  reserved"), (3, "all-rights-reserved"), (4, "All rights\n * reserved.\n"), (5, "reserved")]
    got = H.by_id(licenses.license_scan(H.docs(spark, rows)))
    assert [got[i].licenses for i in range(1, 6)] == ["all-rights-reserved"] * 4 + [""]


# -- 6 ---------------------------------------------------------------------------------------------------------------

def near_copies(seed, groups=6, copies=12, words=80):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}x{rng.randint(0, 400)}" for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 10**6)}"
            rows.append((len(rows) * 3 % 997, " ".join(w)))
    return rows


def test_ngram_join_equals_all_pairs(spark):
    rows = near_copies(5) + [(2000 + i, H.sentence(1)) for i in range(5)] + [(3000, "One  two\nTHREE"), (3001, "one two three"), (3002, "one two")]
    got = ngram_join.ngram_jaccard_join(H.docs(spark, rows + H.EDGES)).collect()
    assert H.order([tuple(r) for r in got]) == H.order(H.brute_components(rows + H.EDGES))


def test_ngram_join_rest_pass_and_rounds(spark, monkeypatch):
    """The same components whether all cells are computed at once or after several pivot rounds."""
    rows = near_copies(9, groups=3, copies=25, words=60)
    for rounds in (0, 1):
        monkeypatch.setattr(ngram_join, "MAX_ROUNDS", rounds)
        got = ngram_join.ngram_jaccard_join(H.docs(spark, rows)).collect()
        assert H.order([tuple(r) for r in got]) == H.order(H.brute_components(rows))


def test_ngram_join_near_the_bound(spark):
    """Pairs on both sides of 0.8, of many sizes, in texts that also share passages with strangers."""
    rng, rows = random.Random(31), []
    passage = [[f"p{j}w{i}" for i in range(25)] for j in range(3)]
    for g in range(60):
        n = rng.choice((20, 45, 90, 180, 320))
        base = [f"b{g}w{i}" for i in range(n)] + (passage[g % 3] if g % 2 else [])
        other = list(base)
        for k in range(max(1, round(len(base) * rng.choice((0.018, 0.02, 0.022, 0.024, 0.03))))):
            other[(k * 37 + 11) % len(other)] = f"o{g}k{k}"
        cut = base[:int(len(base) * rng.choice((0.79, 0.8, 0.81, 0.82, 0.85)))]
        rows += [(3 * g, " ".join(base)), (3 * g + 1, " ".join(other)), (3 * g + 2, " ".join(cut))]
    got = ngram_join.ngram_jaccard_join(H.docs(spark, rows)).collect()
    want = H.brute_components(rows)
    assert len({c for _, _, c in want}) not in (60, 180)  # some pairs link, some don't
    assert H.order([tuple(r) for r in got]) == H.order(want)


@pytest.mark.parametrize("rounds", [0, 2])
def test_ngram_join_strangers_with_a_long_passage_do_not_meet(spark, monkeypatch, rounds):
    """A passage that is two thirds of each text makes no pairs of strangers, and no link beside it is lost."""
    passage, rows = [f"p{i}" for i in range(100)], []
    for g in range(60):
        own = [f"u{g}x{i}" for i in range(30)]
        rows.append((2 * g, " ".join(own[:15] + passage + own[15:])))
        if g % 6 == 0:
            rows.append((2 * g + 1, " ".join(own[:15] + passage + own[15:28])))
    seen, verify = [], ngram_join.linked
    monkeypatch.setattr(ngram_join, "MAX_ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "linked", lambda pairs, sets: seen.append(pairs.count()) or verify(pairs, sets))
    got = ngram_join.ngram_jaccard_join(H.docs(spark, rows)).collect()
    want = H.brute_components(rows)
    assert len({c for _, _, c in want}) == 60
    assert H.order([tuple(r) for r in got]) == H.order(want)
    assert sum(seen) < 100  # of 2,415 pairs


def test_ngram_join_leaves_no_step_tables(spark, tmp_path, monkeypatch):
    root = tmp_path.as_uri()
    monkeypatch.setattr(ngram_join, "step_folder", lambda s: f"{root}/steps")
    ngram_join.ngram_jaccard_join(H.docs(spark, near_copies(3, groups=2, copies=4))).collect()
    assert not [p for p in (tmp_path / "steps").iterdir() if p.is_dir()]
    assert spark.read.parquet(f"{root}/steps").count() == 0


def test_one_of_each_group(spark):
    rows = near_copies(11, groups=3) + [(4, "same text of five words"), (4, "same text of five words"), (90000, None), (90001, "")]
    kept = ngram_join.one_of_each_group(H.docs(spark, rows, H.PLAIN))
    assert kept.columns == [f.name for f in H.PLAIN.fields]
    want = {c if c is not None else d for d, _, c in H.brute_components(rows)}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted(set(ids)) and set(ids) == want


# -- 7 ---------------------------------------------------------------------------------------------------------------

def test_suffix_dedup_equals_all_strings(spark):
    rng = random.Random(3)
    passage = " ".join(f"shared{rng.randint(0, 10**6)}" for _ in range(30))
    rows = list(H.EDGES) + [(11 + i, " ".join(f"own{rng.randint(0, 10**5)}" for _ in range(rng.randint(0, 60))) + " " + passage[i * 3:i * 3 + 190]
                             + " é" * i) for i in range(40)]
    rows += [(500, "ab" * 200), (501, "ab" * 90 + "c" + "ab" * 90), (502, "y" * 49), (503, "y" * 49), (504, "z" * 50), (505, "z" * 51)]
    got = [tuple(r) for r in suffix_dedup.repeat_digests(H.docs(spark, rows)).collect()]
    assert H.order(got) == H.order(H.brute_removed(rows))


def test_suffix_dedup_across_blocks(spark, monkeypatch):
    """Long texts are cut into blocks; a repeat across the cut is found whole."""
    rng = random.Random(4)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    text = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    frame = __import__("pandas").DataFrame({"doc_id": [1, 2], "digest": [5, 6], "text": [text, text[100:2500]]})
    found = {}
    for block in suffix_dedup.blocks(frame):
        for r in suffix_dedup.runs_of(block):
            for k in range(r["length"]):
                found.setdefault(int(r["doc_id"]), []).append(int(r["start"]) + k)
    assert sorted(found[1]) == list(range(3000 - 49)) and sorted(found[2]) == list(range(2400 - 49))


def test_without_repeats_keeps_columns(spark):
    out = suffix_dedup.without_repeats(H.docs(spark, [(1, "k" * 60), (2, "é" * 30 + "k" * 60 + "end"), (3, None)], H.PLAIN))
    assert out.columns == [f.name for f in H.PLAIN.fields]
    assert {r.doc_id: r.text for r in out.collect()} == {1: "k" * 60, 2: "é" * 30 + "end", 3: None}


# -- 8 ---------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use the cookies and this is a notice for all of you on the site.</div>
<article><h1>Title &amp; more</h1><p>The first   paragraph of the article is here and it says a lot of things to you.<br>Next&nbsp;line
<p><b>Be. <p>Tiny.</p><div class="ad">Buy it now and get the best of the best for you and all of the rest.</div>
<p>It is the end of the article, and this was all of it for the day.</p></article>
<section class="comments"><article><p>I think that this is the best of all the articles I have read.</p></article></section>
<aside><p>It is about the other things that you may want to see in this place.</p></aside>
<form><p>Sign up for the news of the day and the rest of it.</p></form><footer>&copy; x</footer></body></html>"""


def test_html_main_text(spark):
    want = ("Title & more The first paragraph of the article is here and it says a lot of things to you. Next line Be. Tiny. "
            "It is the end of the article, and this was all of it for the day.")
    plain = PAGE.replace("<article><h1>", "<div id=content><h1>").replace("</article>\n<section", "</div>\n<section")
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p>a < b", "x"), (5, "u", plain, "x"), (1, "u", PAGE, "x"),
            (6, "u", "<a <b <" * 500, "x")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == want and texts[5] == want and texts[2] == texts[3] == ""


def test_html_names_of_wrappers_and_articles():
    want = html_text.main_text(PAGE)
    plain = PAGE.replace("<article><h1>", "<div id=content><h1>").replace("</article>\n<section", "</div>\n<section")
    wrap = lambda page, tag: page.replace("<nav>", f"<{tag}><nav>", 1).replace("</body>", f"</{tag.split()[0]}></body>")
    for names in ("site has-sidebar", "no-sidebar", "ad-free", "page with-menu", "comments-open", "overflow-hidden", "sidebar", "page social"):
        for page in (PAGE, plain, PAGE.replace("<article><h1>", "<main><h1>").replace("</article>\n<section", "</main>\n<section")):
            assert html_text.main_text(wrap(page, f'div class="{names}"')) == want, names
    for names in ("post category-legal", "post tag-search", "social", "type-post hentry tag-cookies"):
        assert html_text.main_text(PAGE.replace("<article><h1>", f'<article class="{names}"><h1>')) == want, names
    assert html_text.main_text(PAGE.replace('class="comments"', 'class="post-comments-list"').replace('"ad"', '"acme-ad-slot"')) == want
    assert html_text.hints_of("site-footer nav-left comment-body social-science x") == {"footer", "nav", "comment", "science", "x"}
    long = "<p>I think that this is the best of all the articles I have read.</p>" * 20
    for page in (PAGE, plain):
        assert html_text.main_text(page.replace("<section class=\"comments\"><article>", '<section class="comments"><article>' + long)) == want


OTHER = {"Chinese": ("春天来了，山上的花都开了，孩子们在河边玩耍，老人们在树下喝茶。", "完。"), "Thai": ("ในวันที่อากาศดีเด็กและผู้ใหญ่ออกไปเดินเล่นริมแม่น้ำ", "จบ"),
         "Russian": ("Весной дети играют у реки, а старики пьют чай под высокими деревьями сада.", "Конец."),
         "Hindi": ("वसंत में बच्चे नदी के किनारे खेलते हैं और बूढ़े लोग पेड़ के नीचे चाय पीते हैं।", "अंत"),
         "Finnish": ("Keväällä lapset leikkivät joen rannalla, kun vanhukset juovat teetä suurten puiden alla. " * 4, "Loppu.")}


@pytest.mark.parametrize("language_name", OTHER)
def test_html_languages_without_known_stop_words(language_name):
    long, short = OTHER[language_name]
    links = "<ul>" + "".join(f'<li><a href="/{i}">{long}</a></li>' for i in range(3)) + "</ul>"
    body = f"<h1>{short}</h1><p>{long}</p><p>{short}</p><p>{long}</p>"
    want = " ".join([short, long.strip(), short, long.strip()])
    notice = f'<div class="cookie-notice">{long}</div>'
    for page in (f"<body>{notice}{links}<div id=content>{body}</div><footer>{long}</footer></body>",
                 f"<body>{notice}{links}<article>{body}{links}</article><footer>{long}</footer></body>"):
        assert html_text.main_text(page) == want
    assert html_text.main_text(f"<body>{links}</body>") == ""


# -- 9 ---------------------------------------------------------------------------------------------------------------

def test_bpe_equals_library(spark, library):
    rng = random.Random(6)
    parts = ["abcdefgh ", "  \t\n\r\x0b\x85\xa0 ", "'sdtrvelm ", "aaaa", "0123456 ", "éèñ日本語한👍🏽́²½Ⅷ", "THE the ing tion er "]
    texts = ["".join(rng.choice(rng.choice(parts)) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a<|endoftext|>b <|endoftext|><|endoftext", "x" * 3000, "hello " * 50, H.LONG, "ﬁ\U0001F468‍\U0001F469"]
    coder = bpe.loaded(bpe.default_path())
    for t in texts:
        assert coder.encode(t) == library.encode(t, add_special_tokens=False).ids, t[:80]
    rows = [(i, t) for i, t in enumerate(texts[-60:])] + [(1000, None)]
    got = H.by_id(bpe.round_trip_digests(H.docs(spark, rows), bpe.default_path()))
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    ids = bpe.encode_documents(H.docs(spark, rows), bpe.default_path())
    back = H.by_id(bpe.decode_ids(ids, bpe.default_path()))
    assert all(back[i].text == (t or "") for i, t in rows)


# -- 10 --------------------------------------------------------------------------------------------------------------

def brute_hits(rows, items):
    import re
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[s:s + 10]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[s:s + k]))):
                    hit.update(range(s, s + k))
                    ids |= found
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"b{rng.randint(0, 60)}" for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(60)] + BENCH
    rows = list(H.EDGES)
    for d in range(100, 200):
        w = [f"b{rng.randint(0, 60)}" if rng.random() < .4 else f"d{rng.randint(0, 500)}" for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            item = (rng.choice(items)[1] or "").upper().split()
            a = rng.randint(0, max(0, len(item) - 10))
            w[(k := rng.randint(0, len(w))):k] = item[a:a + rng.randint(5, 25)]
        rows.append((d, "; ".join(w)))
    d = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in decontamination.decontaminate(H.docs(spark, rows), d).collect()]
    assert H.order(got) == H.order(brute_hits(rows, items))
    assert not any(r.contaminated for r in decontamination.decontaminate(H.docs(spark, rows), d.limit(0)).collect())


def test_winnowing_keeps_a_hash_of_every_span(spark):
    row = spark.createDataFrame([(H.sentence(3, 60),)], "text string").select(decontamination.words_of(F.col("text")).alias("words"))
    marks = set(decontamination.with_fingerprints(row, []).first().fingerprints)
    for s in range(1, 52):
        part = row.select(F.slice("words", s, 10).alias("words"))
        assert marks & set(part.select(decontamination.gram_hashes(F.col("words"), 5).alias("g")).first().g)


@pytest.mark.parametrize("size", [1, 3, 9])
def test_short_items_are_found_wherever_they_start(spark, size):
    item = " ".join(f"item{i}" for i in range(size))
    rows = [(1, item), (2, f"a {item} b"), (3, f"a b c {item}"), (4, " ".join(["x"] * 30) + f" {item.upper()}, y"),
            (5, "item0 x item1" if size > 1 else "xitem0"), (6, f"{item} {item}")]
    d = spark.createDataFrame([("q", item)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontamination.decontaminate(H.docs(spark, rows), d).collect()}
    assert got == {1: (size, 1), 2: (size, 1), 3: (size, 1), 4: (size, 1), 5: (0, 0), 6: (2 * size, 1)}
    assert [r.doc_id for r in decontamination.without_contaminated(H.docs(spark, rows), d).collect()] == [5]

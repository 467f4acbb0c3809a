import random
import re
import zlib
from collections import Counter

import pytest

from netsift.llm import spelling as S
from tests.llm import helpers as H


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, min_length=6, min_count=5):
    """op 13 by comparing all pairs of words."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    form, near = {}, {}
    for w in n:
        near[w] = [v for v in n if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def got(frame):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in frame.collect())


def variants(rng, word, letters="abcé×"):
    i, c = rng.randrange(len(word) + 1), rng.choice(letters)
    return rng.choice([word[:i] + c + word[i:], word[:i] + c + word[i + 1:], word[:i] + word[i + 1:]])


def texts(seed):
    """Few letters, so that words have neighbours at every place; lengths around those where the tries end."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abÿ") for _ in range(rng.choice([5, 6, 7, 8, 12, 31, 32, 33, 34, 200]))) for _ in range(25)]
    words = base + [variants(rng, w) for w in base for _ in range(8)]
    words += [variants(rng, w) for w in words if rng.random() < .4 and w]
    rows = []
    for d in range(60):
        take = [rng.choice(words) for _ in range(80)] + [rng.choice(base[:5]) for _ in range(30)]
        rows.append((d, rng.choice([" ", "-", "7", "一", "Ā", "\n", " "]).join(w.upper() if rng.random() < .1 and w.isascii() else w for w in take)))
    return rows + [(None, " ".join(base)), (3, None), (4, ""), (5, "¿×÷ Ÿ")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = texts(seed)
    docs = H.docs(spark, rows).repartition(3)
    docs = docs.toDF(*[{"n": "near", "TEXT": "node", "c0": "word"}.get(c, c) for c in docs.columns])
    want = brute(rows)
    assert got(S.spelling_variants(docs)) == want
    assert any(w[1] for w in want) and any(len(w[0]) > S.DEPTH and w[4] for w in want)


def test_chains_ties_and_deleted_code_points(spark):
    rows = [(1, "casting " * 5 + "castings " * 25 + "kastings " * 130 + "castingz " * 25),  # casting -> castings -> kastings
            (2, "harbor " * 30 + "harbar " * 30 + "harbr0 " * 9 + "harbör " * 6)]
    run = next(w for w in (f"abcdef{a}{b}" for a in "ghij" for b in "klmnopqrstuvwxyzabcdefghij") if any(
        zlib.crc32(f"{d}:{w}".encode()) % 199 == 0 for d in range(200)))
    rows += [(d, f"{run.upper()} {run} " * 5) for d in range(200)]
    out = {r.word: r for r in S.spelling_variants(H.docs(spark, rows)).collect()}
    assert got(S.spelling_variants(H.docs(spark, rows))) == brute(rows)
    assert out["casting"].root == "kastings" and out["casting"].form == "castings"
    assert out["harbör"].form == "harbar" and out["harbor"].form is None  # equal counts: the smaller word
    assert any(r.root == run and len(r.word) == len(run) - 1 for r in out.values())


def test_empty_table(spark):
    assert S.spelling_variants(H.docs(spark, [])).collect() == []


def test_deletion_keys():
    own, keys = S.deletion_keys("abcabé")
    for i in range(6):
        assert S.deletion_keys(("abcabé")[:i] + ("abcabé")[i + 1:])[0] == int(keys[i])

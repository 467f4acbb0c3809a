"""Spelling variant grouping by a relational trie frontier (operator 13).

Words that occur often enough form a trie whose edges are a table (node, ch,
child); a node is named by the prefix that leads to it, so names never collide.
States (word, position, node, one edit spent) are joined with the edges level
by level: an unspent word leaves its own path by another edge (a replaced code
point) or without reading one (a deleted code point), and from then on must
follow edges that spell its rest. States that have read their whole word stand
on their neighbour if that node is a word.

Near the root nearly every edge exists, so branching there would only make
states that die some levels later. An edit therefore has to lie in the second
half of a word; a second trie of the reversed words finds those in the first
half. Insertions are deletions seen from the other word, and of two words that
differ by a replacement the one with the smaller code point finds the other.

Both tries are walked at once, one step per level up to DEPTH code points.
Longer words (and DEPTH-long ones, which may be near a longer one) are compared
by their hashed deletion keys instead and verified, so depth costs no steps.

A node's edges are at most as many as the letters, 116; where a third of all
words hang below one node, the adaptive skew join splits its states.

Null text has no words. A null id counts as the empty text in the hash of its
runs. Repeated rows count each time. An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.llm.common import narrow, stored

MIN_LENGTH = 6
MIN_COUNT = 5
#: A form occurs at least so many times as often as the word.
RATIO = 5
#: One run in so many loses a code point.
DAMAGED = 199
#: Levels of the tries.
DEPTH = 32
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 20

_NOT_LETTERS = "".join(c for c in map(chr, range(128)) if not c.isalpha())
_LOWER = bytes.maketrans(_NOT_LETTERS.encode() + bytes(range(65, 91)), b" " * len(_NOT_LETTERS) + bytes(range(97, 123)))
#: U+00C0 to U+00FF are the bytes C3 80 to C3 BF.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_OTHER_LEADS = bytes(range(128)) + bytes(range(0x80, 0xC0)) + b"\xc3"


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of letters, A-Z lower-cased, as UTF-8."""
    raw = (text or "").encode().translate(_LOWER)
    if raw.translate(None, _OTHER_LEADS):  # characters that are neither ASCII nor U+00C0 to U+00FF
        return _RUN.findall(raw)
    return raw.split()


def damaged(run: bytes, h: int) -> bytes:
    if h % DAMAGED:
        return run
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1:]).encode()


def word_counts(docs: DataFrame, min_length: int, min_count: int) -> DataFrame:
    """(word, n) of documents (doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()

        def out() -> pd.DataFrame:
            long_enough = [(w.decode(), n) for w, n in counts.items() if len(w) - w.count(b"\xc3") >= min_length]
            counts.clear()
            return pd.DataFrame(long_enough, columns=["word", "n"])

        for f in frames:
            for doc_id, text in zip(f["doc_id"], f["text"]):
                start = zlib.crc32(f"{'' if pd.isna(doc_id) else int(doc_id)}:".encode())
                for r, n in Counter(runs(text)).items():
                    if len(r) >= min_length:
                        counts[damaged(r, zlib.crc32(r, start))] += n
                if len(counts) > HELD:
                    yield out()
        yield out()

    return docs.mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# -- the tries ---------------------------------------------------------------------------------------------------------

def at(s: Column | str, i: Column | int) -> Column:
    """The code point at position i (from 0)."""
    return F.substring(s, (i if isinstance(i, Column) else F.lit(i)) + 1, F.lit(1))


def spellings(words: DataFrame) -> DataFrame:
    """(side, s): each word and its reverse."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("s")),
                    F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s")))
    return words.select(F.explode(sides).alias("x")).select("x.*").withColumn("size", F.length("s"))


def trie_edges(spelled: DataFrame, first: int) -> DataFrame:
    """(side, depth, node, ch) for the levels from ``first`` on."""
    each = spelled.select("side", "s", F.explode(F.sequence(F.lit(first), F.col("size") - 1)).alias("depth"))
    return each.select("side", "depth", F.substring("s", F.lit(1), F.col("depth")).alias("node"), at("s", F.col("depth")).alias("ch")).distinct()


def frontier_step(depth: int, spelled: DataFrame, edges: DataFrame, frontier: DataFrame | None) -> DataFrame:
    """States (side, s, pos, node) one level below ``depth``, and those that need no further edge.

    ``frontier``: states whose one edit is spent, at nodes of this depth.
    """
    here = edges.filter(F.col("depth") == depth).select("side", "node", "ch")
    unspent = spelled.filter((F.floor(F.col("size") / 2) <= depth) & (F.col("size") > depth)) \
        .select("side", "s", F.substring("s", 1, depth).alias("node"))
    replaced = unspent.withColumn("own", at("s", depth)).join(here, ["side", "node"]).filter(F.col("ch") > F.col("own")) \
        .select("side", "s", F.lit(depth + 1).alias("pos"), F.concat("node", "ch").alias("node"))
    # Of equal code points in a row only the last is deleted: the result is the same.
    deleted = unspent.filter(at("s", depth) != at("s", depth + 1)) \
        .select("side", "s", F.lit(depth + 1).alias("pos"), "node")
    states = deleted if frontier is None else deleted.unionAll(frontier.select("side", "s", "pos", "node"))
    moving = states.filter(F.col("pos") < F.length("s")).withColumn("ch", at("s", F.col("pos")))
    moved = moving.join(here, ["side", "node", "ch"]).select("side", "s", (F.col("pos") + 1).alias("pos"), F.concat("node", "ch").alias("node"))
    ended = states.filter(F.col("pos") >= F.length("s"))
    return replaced.unionAll(moved).unionAll(ended)


def trie_neighbours(words: DataFrame, min_length: int) -> DataFrame:
    """(word, near): each pair of words of at most DEPTH code points once or twice, in one direction."""
    words = words.filter(F.length("word") <= DEPTH)
    first = max(0, min_length // 2)
    spelled = stored(spellings(words), "spellings")
    longest = spelled.agg(F.max("size")).first()[0] or 0
    edges = stored(trie_edges(spelled, first), "trie-edges", by="depth")
    frontier, ended = None, []
    for depth in range(first, longest):
        states = stored(frontier_step(depth, spelled, edges, frontier), f"frontier-{depth}")
        ended.append(states.filter(F.col("pos") >= F.length("s")).select("side", "s", "node"))
        frontier = states.filter(F.col("pos") < F.length("s"))
    if not ended:
        return words.select("word", F.col("word").alias("near")).limit(0)
    found = ended[0]
    for more in ended[1:]:
        found = found.unionAll(more)
    straight = lambda c: F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c))
    return found.select(straight("s").alias("word"), straight("node").alias("near")) \
        .join(words.select(F.col("word").alias("near")), "near", "left_semi")


# -- words beyond the tries --------------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15


def deletion_keys(word: str) -> tuple[int, np.ndarray]:
    """A 64-bit hash of the word and of what is left without each of its code points, in linear time."""
    x = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    x = (x ^ (x << np.uint64(21))) * np.uint64(0xBF58476D1CE4E5B9)
    power = np.cumprod(np.append(np.uint64(1), np.full(len(x), _BASE, np.uint64)))
    weighed = x * power[:-1]
    before = np.append(np.uint64(0), np.cumsum(weighed))
    after = before[-1] - before[1:]
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    return int(before[-1]), before[:-1] + after * inverse


def long_neighbours(words: DataFrame) -> DataFrame:
    """(word, near) among words of DEPTH code points and more: equal keys are candidates, the words decide."""
    words = words.filter(F.length("word") >= DEPTH)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for w in f["word"]:
                own, keys = deletion_keys(w)
                yield pd.DataFrame({"word": w, "size": len(w), "place": np.arange(-1, len(w)),
                                    "key": np.append(np.uint64(own), keys).view(np.int64)})

    keys = stored(words.select("word").mapInPandas(run, "word string, size int, place int, key bigint"), "deletion-keys")
    whole = keys.filter("place < 0").select("key", (F.col("size") + 1).alias("size"), F.col("word").alias("near"))
    less = keys.filter("place >= 0")
    shorter = less.join(whole, ["key", "size"]).select("word", "near", "place") \
        .filter(F.concat(F.substring("word", F.lit(1), F.col("place")), rest("word", F.col("place") + 1)) == F.col("near"))
    other = less.select("key", "size", "place", F.col("word").alias("near"))
    same = less.join(other, ["key", "size", "place"]).filter(F.col("word") < F.col("near")) \
        .filter((F.substring("word", F.lit(1), F.col("place")) == F.substring("near", F.lit(1), F.col("place")))
                & (rest("word", F.col("place") + 1) == rest("near", F.col("place") + 1)))
    return shorter.select("word", "near").unionAll(same.select("word", "near"))


def rest(s: str, i: Column) -> Column:
    return F.substring(s, i + 1, F.length(s))


# -- forms and roots ---------------------------------------------------------------------------------------------------

def neighbours(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, near), both directions, each pair of the table's words that differ by one code point."""
    found = trie_neighbours(words, min_length).unionByName(long_neighbours(words)).distinct()
    return found.select("word", "near").unionAll(found.select("near", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) with null where the chain ends: pointers are doubled until none moves.

    Counts grow along a chain by RATIO at least, so it has no circle and few links.
    """
    up = stored(forms.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(up.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                         F.col("next").isNotNull().alias("moved")), "roots")
        up = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return up


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, text: str = "text",
                      doc_id: str = "doc_id") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each distinct word that is long and frequent enough."""
    words = stored(word_counts(narrow(docs, doc_id=(doc_id, "bigint"), text=(text, "string")), min_length, min_count), "words")
    pairs = stored(neighbours(words.select("word"), min_length), "neighbours")
    counted = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("form")))
    near = pairs.join(counted, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    clear = -F.col("best.order") >= RATIO * F.col("n")
    rows = words.join(near, "word", "left") \
        .select("word", F.when(clear, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                F.when(clear, -F.col("best.order")).alias("form_n"))
    rows = stored(rows, "forms")
    return rows.join(roots(rows), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

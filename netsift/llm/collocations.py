"""Phrase collocation mining with counting quotient filters (operator 11).

Texts become sequences of word ids, in chunks of one language. A phrase of k
ids is packed into ``k * b`` bits (``b``: bits of the language's largest id),
put through an invertible permutation of that domain and split into a quotient
and the full remainder. A filter is the sorted list of (quotient, remainder)
with counts: nothing is lost, a block of it holds the remainders of a range of
quotients as differences. Each task fills filters over its chunks; blocks of
the same quotients are merged across tasks, and what reaches the least count
is unpacked into word ids again.

Phrases grow word by word. A phrase of k + 1 words is counted only where the
two phrases of k words inside it both passed a bitmap of the frequent ones.
The bitmap has a fixed size (16 MB), so it may let others through, which the
exact counts then drop; it never holds one back.

Every chunk lists its own words, and its sequence is renumbered by the ids of
the frequent ones: a counted dictionary of at most ``dictionary`` words (about
100 bytes each) goes to the tasks; a larger one stays a table, with which the
chunks' lists are joined. Either way the numbers are the same. Blocks hold distinct phrases, so a phrase that makes up a third of
all words is one entry per filter.

Null text is empty; a null language is ``und``. Repeated rows count each time.
Empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.llm.common import narrow, stored

MAX_WORDS = 5
#: Words of one language that a chunk holds at least, unless its task ends or holds HELD words over all languages.
CHUNK = 1 << 20
HELD = 1 << 22
#: Frequent words that a task holds as a dictionary.
DICTIONARY = 1 << 20
#: Entries that a task's filter gathers before it is handed on.
FILTER = 1 << 21
#: Word occurrences per block of quotients.
PER_BLOCK = 1 << 21
BITMAP_BITS = 27
ROUNDS = 4
_U = np.uint64
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"\n" * 9)
#: Stands for the end of a piece; no UTF-8 text holds this byte.
_END = b"\xff"


def words_of(text: str | None) -> list[bytes]:
    """The words with ``_END`` at the ends of pieces; A-Z lower-cased."""
    return (text or "").encode().translate(_TABLE).replace(b"\n", b" \xff ").split()


# -- permutation and filters -------------------------------------------------------------------------------------------

def scrambled(x: np.ndarray, turn: int, bits: int) -> np.ndarray:
    """A pseudo-random number of ``bits`` bits for each x."""
    h = (x + _U(turn + 1)) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return (h ^ (h >> _U(32))) & _U((1 << bits) - 1)


def permuted(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A Feistel network over pairs of ``bits``-bit numbers: invertible whatever ``scrambled`` is."""
    for turn in range(ROUNDS):
        left, right = right, left ^ scrambled(right, turn, bits)
    return left, right


def restored(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    for turn in reversed(range(ROUNDS)):
        left, right = right ^ scrambled(left, turn, bits), left
    return left, right


def packed(ids: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of k ids as pairs of numbers with half of the ``k * b`` bits each (rounded up), and that half."""
    k = ids.shape[1]
    half = -(-k * b // 2)
    left, right = np.zeros(len(ids), _U), np.zeros(len(ids), _U)
    for j in range(k):  # bits of word j lie at k*b - (j+1)*b, counted from the right end
        low = (k - 1 - j) * b
        v = ids[:, j].astype(_U)
        if low >= half:
            left |= v << _U(low - half)
        elif low + b <= half:
            right |= v << _U(low)
        else:
            right |= (v << _U(low)) & _U((1 << half) - 1)
            left |= v >> _U(half - low)
    return left, right, half


def unpacked(left: np.ndarray, right: np.ndarray, k: int, b: int) -> np.ndarray:
    half = -(-k * b // 2)
    mask = _U((1 << b) - 1)
    out = np.zeros((len(left), k), np.int64)
    for j in range(k):
        low = (k - 1 - j) * b
        if low >= half:
            v = left >> _U(low - half)
        elif low + b <= half:
            v = right >> _U(low)
        else:
            v = (right >> _U(low)) | (left << _U(half - low))
        out[:, j] = (v & mask).astype(np.int64)
    return out


def summed(left: np.ndarray, right: np.ndarray, counts: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (left, right) with their summed counts."""
    if not len(left):
        return left, right, counts
    if 2 * half <= 64:
        one = (left << _U(half)) | right
        order = np.argsort(one, kind="stable")
        one = one[order]
        starts = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
        one = one[starts]
        return one >> _U(half), one & _U((1 << half) - 1), np.add.reduceat(counts[order], starts)
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    starts = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
    return left[starts], right[starts], np.add.reduceat(counts[order], starts)


class Filter:
    """A counting quotient filter: sorted permuted phrases of one language and length, with counts."""

    def __init__(self, k: int, b: int):
        self.k, self.b, self.half = k, b, -(-k * b // 2)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: np.ndarray) -> None:
        left, right, half = packed(ids, self.b)
        left, right = permuted(left, right, half)
        self.merge(*summed(left, right, np.ones(len(left), np.int64), half))

    def merge(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((left, right, counts))
        self.size += len(left)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.parts) != 1:
            cat = [np.concatenate(x) if self.parts else np.empty(0, t)
                   for x, t in zip(zip(*self.parts) if self.parts else [()] * 3, (_U, _U, np.int64))]
            self.parts = [summed(*cat, self.half)]
            self.size = len(self.parts[0][0])
        return self.parts[0]

    def blocks(self, block_bits: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(quotient's first bits, remainders, counts) for each block that holds something."""
        left, right, counts = self.entries()
        if not len(left):
            return
        bits = min(block_bits, self.half)
        low = self.half - bits
        at = (left >> _U(low)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at))
        for s, e in zip(cuts[:-1], cuts[1:]):
            yield int(at[s]), remainders(left[s:e] & _U((1 << low) - 1), right[s:e], low, self.half), varints(counts[s:e].astype(_U))


def remainders(left: np.ndarray, right: np.ndarray, low: int, half: int) -> bytes:
    """Sorted remainders: differences where they fit 64 bits, else differences of the upper part and the lower part."""
    if low + half <= 64:
        one = (left << _U(half)) | right
        return varints(np.diff(one, prepend=_U(0)))
    return varints(np.diff(left, prepend=_U(0))) + right.astype("<u8").tobytes()


def read_remainders(raw: bytes, n: int, block: int, low: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    top = _U(block) << _U(low)
    if low + half <= 64:
        one = np.cumsum(read_varints(raw, n), dtype=_U)
        return (one >> _U(half)) | top if half < 64 else top, one & _U((1 << half) - 1)
    cut = len(raw) - 8 * n
    return np.cumsum(read_varints(raw[:cut], n), dtype=_U) | top, np.frombuffer(raw[cut:], "<u8").astype(_U)


def varints(x: np.ndarray) -> bytes:
    """Numbers in 7-bit groups, low ones first; the high bit says that more follow."""
    if not len(x):
        return b""
    n = np.ones(len(x), np.int64)
    rest = x >> _U(7)
    while rest.any():
        n += rest > 0
        rest = rest >> _U(7)
    ends = np.cumsum(n)
    out = np.zeros(ends[-1], np.uint8)
    start = ends - n
    for j in range(int(n.max())):
        here = n > j
        v = (x[here] >> _U(7 * j)) & _U(127)
        out[start[here] + j] = v.astype(np.uint8) | np.where(n[here] > j + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def read_varints(raw: bytes, n: int) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(a < 128)[:n]
    starts = np.append(0, ends[:-1] + 1) if n else ends
    size = ends - starts + 1
    out = np.zeros(n, _U)
    for j in range(int(size.max()) if n else 0):
        here = size > j
        out[here] |= (a[starts[here] + j] & 127).astype(_U) << _U(7 * j)
    return out


# -- chunks of word ids ------------------------------------------------------------------------------------------------

def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, lang, words, counts, ids): texts of one language one after another, as positions in the chunk's own word list.

    ``words`` are UTF-8 bytes; id 0 ends a piece, id i is ``words[i - 1]``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        sizes: Counter[str] = Counter()

        def chunk(lang: str) -> pd.DataFrame:
            known, parts = held.pop(lang)
            del sizes[lang]
            ids = np.concatenate(parts)
            counts = np.bincount(ids, minlength=len(known) + 1)[1:]
            return pd.DataFrame({"lang": [lang], "words": [list(known)], "counts": [counts.tolist()], "ids": [ids.astype("<u4").tobytes()]})

        for f in frames:
            for text, lang in zip(f["text"], f["lang"]):
                lang = "und" if lang is None else lang
                words = words_of(text)
                if not words:
                    continue
                if lang not in held:
                    held[lang] = ({}, [np.zeros(1, np.uint32)])
                known, parts = held[lang]
                for w in set(words):
                    if w not in known and w != _END:
                        known[w] = len(known) + 1
                known[_END] = 0
                parts.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                del known[_END]
                parts.append(np.zeros(1, np.uint32))
                sizes[lang] += len(words)
                if sizes[lang] >= CHUNK:
                    yield chunk(lang)
            while sum(sizes.values()) > HELD:
                yield chunk(sizes.most_common(1)[0][0])
        for lang in list(held):
            yield chunk(lang)

    return docs.mapInPandas(run, "lang string, words array<binary>, counts array<bigint>, ids binary") \
        .withColumn("chunk", F.expr("uuid()"))


def numbered(frequent: DataFrame, parts: int = 64) -> DataFrame:
    """Adds ``id``, dense from 1 in each language: ranks inside hashed parts plus the sizes of the parts before."""
    f = frequent.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts)))
    sizes = f.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("lang", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("lang", "part").orderBy("word"))
    return f.join(sizes, ["lang", "part"]).select("lang", "word", "f", (inside + F.col("before")).cast("bigint").alias("id"))


def sequences(texts: DataFrame, words: DataFrame, dictionary: int = DICTIONARY) -> DataFrame:
    """(lang, ids) of the chunks, renumbered by the frequent words' ids; 0 for all other words and ends of pieces."""
    if words.count() <= dictionary:
        return by_dictionary(texts, words)
    return by_join(texts, words)


def by_dictionary(texts: DataFrame, words: DataFrame) -> DataFrame:
    known: dict[str, dict[bytes, int]] = {}
    for r in words.select("lang", "word", "id").toLocalIterator():
        known.setdefault(r["lang"], {})[bytes(r["word"])] = r["id"]
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for lang, own, ids in zip(f["lang"], f["words"], f["ids"]):
                table = shared.value.get(lang, {})
                to = np.fromiter((table.get(w, 0) for w in (b"", *own)), np.uint32, len(own) + 1)
                out.append(to[np.frombuffer(ids, "<u4")].astype("<u4").tobytes())
            yield pd.DataFrame({"lang": f["lang"], "ids": out})

    return texts.select("lang", "words", "ids").mapInPandas(run, "lang string, ids binary")


def by_join(texts: DataFrame, words: DataFrame) -> DataFrame:
    own = texts.select("chunk", "lang", F.posexplode("words").alias("at", "word"))
    table = own.join(words.select("lang", "word", "id"), ["lang", "word"]) \
        .groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("ids_of"))  # as long as the chunk's word list at most

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for n, ids, known in zip(f["n"], f["ids"], f["ids_of"]):
                to = np.zeros(n + 1, np.uint32)
                pairs = np.array([(r["at"], r["id"]) for r in known])
                to[pairs[:, 0] + 1] = pairs[:, 1]
                out.append(to[np.frombuffer(ids, "<u4")].astype("<u4").tobytes())
            yield pd.DataFrame({"lang": f["lang"], "ids": out})

    return texts.select("chunk", "lang", "ids", F.size("words").alias("n")).join(table, "chunk") \
        .select("lang", "ids", "n", "ids_of").mapInPandas(run, "lang string, ids binary")


# -- counting phrases --------------------------------------------------------------------------------------------------

def bitmap_places(ids: np.ndarray, lang: str) -> np.ndarray:
    """A place in the bitmap for each row of word ids."""
    h = np.full(len(ids), int.from_bytes(lang.encode()[:7], "little") + ids.shape[1], _U)
    for j in range(ids.shape[1]):
        h = scrambled(h ^ ids[:, j].astype(_U), j, 63)
    return (h & _U((1 << BITMAP_BITS) - 1)).astype(np.int64)


def bitmap(frequent: DataFrame, k: int, segments: int = 64) -> np.ndarray:
    """The places of the frequent phrases (lang, ids): put together by segments, always 2^BITMAP_BITS bits."""
    size = (1 << BITMAP_BITS) // segments

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lang, g in f.groupby("lang"):
                at = bitmap_places(np.array(g["ids"].tolist(), np.int64).reshape(len(g), k), lang)
                yield pd.DataFrame({"segment": (at // size).astype(np.int32), "at": (at % size).astype(np.int32)})

    def segment(f: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(size, np.uint8)
        bits[f["at"].to_numpy()] = 1
        return pd.DataFrame({"segment": [f["segment"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})

    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    rows = frequent.mapInPandas(places, "segment int, at int").distinct() \
        .groupBy("segment").applyInPandas(segment, "segment int, bits binary").collect()
    for r in rows:
        out[r["segment"] * (size // 8):(r["segment"] + 1) * (size // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def phrase_counts(texts: DataFrame, k: int, id_bits: dict[str, int], blocks: int, least: int, shorter: np.ndarray | None) -> DataFrame:
    """(lang, ids, f) of phrases of ``k`` words that occur ``least`` times; ``shorter``: bitmap of the frequent ones of k - 1 words."""
    spark = texts.sparkSession
    known = None if shorter is None else spark.sparkContext.broadcast(shorter)

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters: dict[str, Filter] = {}

        def out(lang: str) -> pd.DataFrame:
            rows = list(filters.pop(lang).blocks(blocks))
            return pd.DataFrame({"lang": lang, "block": [r[0] for r in rows],
                                 "remainders": [r[1] for r in rows], "counts": [r[2] for r in rows]})

        for f in frames:
            for lang, raw in zip(f["lang"], f["ids"]):
                a = np.frombuffer(raw, "<u4")
                if len(a) < k:
                    continue
                rows = np.lib.stride_tricks.sliding_window_view(a, k)
                rows = rows[(rows > 0).all(axis=1)] if known is None else rows[passed(a, k, lang, known.value)]
                if not len(rows):
                    continue
                mine = filters.setdefault(lang, Filter(k, id_bits[lang]))
                mine.add(rows)
                if mine.size > FILTER:
                    mine.entries()
                    if 2 * mine.size > FILTER:
                        yield out(lang)
        for lang in list(filters):
            yield out(lang)

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        lang, block = f["lang"].iloc[0], int(f["block"].iloc[0])
        whole = Filter(k, id_bits[lang])
        low = whole.half - min(blocks, whole.half)
        for raw, counts in zip(f["remainders"], f["counts"]):
            n = int((np.frombuffer(counts, np.uint8) < 128).sum())
            whole.merge(*read_remainders(raw, n, block, low, whole.half), read_varints(counts, n).astype(np.int64))
        left, right, counts = whole.entries()
        keep = counts >= least
        left, right = restored(left[keep], right[keep], whole.half)
        ids = pd.Series(list(unpacked(left, right, k, whole.b)), dtype=object)
        return pd.DataFrame({"lang": lang, "ids": ids, "f": counts[keep]})

    return texts.mapInPandas(fill, "lang string, block bigint, remainders binary, counts binary") \
        .groupBy("lang", "block").applyInPandas(merge, "lang string, ids array<bigint>, f bigint")


def passed(a: np.ndarray, k: int, lang: str, bits: np.ndarray) -> np.ndarray:
    """Starts of k words whose first and last k - 1 words the bitmap holds."""
    shorter = np.lib.stride_tricks.sliding_window_view(a, k - 1)
    there = np.flatnonzero((shorter > 0).all(axis=1))
    at = bitmap_places(shorter[there], lang)
    ok = np.zeros(len(shorter), bool)
    ok[there] = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
    return np.flatnonzero(ok[:-1] & ok[1:])


def frequent_phrases(docs: DataFrame, least: int, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of documents (text, lang): (lang, ids, f) of phrases of 1 to ``max_words`` words, (lang, word, f, id), (lang, n)."""
    texts = stored(chunks(docs), "chunks")
    counted = texts.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")) \
        .groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    counted = stored(counted, "word-counts")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = stored(numbered(counted.filter(F.col("f") >= least)), "frequent-words")
    largest = words.groupBy("lang").agg(F.max("id").alias("id")).collect()  # a row per language
    id_bits = {r["lang"]: max(1, int(r["id"]).bit_length()) for r in largest}
    if max(id_bits.values(), default=0) * max_words > 126:
        raise ValueError(f"phrases of {max_words} ids of {max(id_bits.values())} bits don't fit two 63-bit halves")
    total = totals.agg(F.sum("n")).first()[0] or 0
    blocks = max(4, int(total // PER_BLOCK).bit_length() + 2)
    ids = stored(sequences(texts, words), "sequences")
    found = [words.select("lang", F.array("id").alias("ids"), "f")]
    shorter = None
    for k in range(2, max_words + 1):
        these = stored(phrase_counts(ids, k, id_bits, blocks, least, shorter), f"phrases-{k}")
        if these.isEmpty():
            break
        found.append(these)
        shorter = bitmap(these, k) if k < max_words else None
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionAll(more)
    return phrases, words, totals


# -- scores ------------------------------------------------------------------------------------------------------------

def scored(phrases: DataFrame, totals: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, ids, a, l, r, n, score): the lowest-scoring cut of each phrase of two words or more."""
    cuts = phrases.filter(F.size("ids") > 1).select("lang", "ids", F.col("f").alias("a"),
                                                     F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    cuts = cuts.select("*", F.slice("ids", F.lit(1), F.col("k")).alias("first"),
                       F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("rest"))
    left = phrases.select("lang", F.col("ids").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("ids").alias("rest"), F.col("f").alias("r"))
    rows = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(F.broadcast(totals), "lang")  # a row per language
    number = "cast({} as decimal(18,0))"
    score = F.expr(f"cast((cast(1000 as decimal(4,0)) * cast({number.format('a')} * {number.format('n')} as decimal(34,0))) "
                   f"div cast({number.format('l')} * {number.format('r')} as decimal(36,0)) as bigint)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r", "n"))
    return rows.groupBy("lang", "ids", "a").agg(best.alias("v")).select("lang", "ids", "a", "v.l", "v.r", "v.n", "v.score")


def not_inside_longer(candidates: DataFrame) -> DataFrame:
    """Without those that occur only inside one longer candidate.

    Counts never grow with a phrase, so if any longer candidate is as frequent,
    one that is a single word longer is too.
    """
    longer = candidates.filter(F.size("ids") > 2)
    size = F.size("ids")
    inside = longer.select("lang", F.slice("ids", F.lit(1), size - 1).alias("ids"), "a") \
        .unionAll(longer.select("lang", F.slice("ids", F.lit(2), size - 1).alias("ids"), "a"))
    return candidates.join(inside.distinct(), ["lang", "ids", "a"], "left_anti")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, max_words: int = MAX_WORDS,
                 text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score, count and spelling."""
    phrases, words, totals = frequent_phrases(narrow(docs, text=(text, "string"), lang=(lang, "string")), least, max_words)
    rows = stored(not_inside_longer(scored(phrases, totals, max_words)), "scored")
    by_count = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    rows = rows.withColumn("place", F.rank().over(by_count)).filter(F.col("place") <= top)
    spelled = rows.select("*", F.posexplode("ids").alias("at", "id")).join(words.select("lang", "id", "word"), ["lang", "id"]) \
        .groupBy("lang", "ids", "a", "l", "r", "n", "score").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w")) \
        .withColumn("phrase", F.array_join(F.transform("w", lambda x: x["word"].cast("string")), " "))
    by_all = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return spelled.withColumn("rank", F.row_number().over(by_all).cast("bigint")).filter(F.col("rank") <= top) \
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Language identification by words first, n-grams after (operator 3).

A known word scores by its smoothed log frequency in each language. An unseen
word falls back to its character n-grams, the longest length of which any is
known. The document's language has the largest sum; its score is the share of
words whose own best language it is.

Learning uses a bounded sample: of more than ``max_docs`` labelled documents,
those whose hashed id falls below their language's share (so about ``max_docs``).
The tables keep words seen twice or more, at most ``max_entries`` of each kind
by count, so the model that every task loads is bounded whatever the corpus.
Both totals are dealt to the languages alike: one that needs less than an equal
part keeps all it has, and the others share the rest.

Null text or text without a letter: ``und`` and score 0; so is everything when
nothing could be learned. Rows without an id are not held out and not learned from.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import narrow

WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    max_docs: int = 6_000
    max_entries: int = 150_000
    longest_gram: int = 4
    smoothing: float = 0.5


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of the word between edge marks; of one letter, of the word itself."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


class LanguageModel:
    """Log-frequency tables: index 0 holds words, index n the n-grams of length n."""

    def __init__(self, counts: pd.DataFrame, totals: dict[str, list[float]], params: LanguageParams):
        self.languages = sorted(totals)
        self.params = params
        at = {lang: i for i, lang in enumerate(self.languages)}
        self.tables: list[dict[str, np.ndarray]] = [{} for _ in range(params.longest_gram + 1)]
        raw: list[dict[str, np.ndarray]] = [{} for _ in self.tables]
        for size, gram, lang, n in counts.itertuples(index=False):
            raw[size].setdefault(gram, np.zeros(len(at)))[at[lang]] += n
        for size, table in enumerate(raw):
            total = np.array([totals[lang][size] for lang in self.languages])
            norm = np.log(total + params.smoothing * (len(table) + 1))
            for gram, n in table.items():
                self.tables[size][gram] = np.log(n + params.smoothing) - norm

    def word_scores(self, word: str) -> np.ndarray:
        known = self.tables[0].get(word)
        if known is not None:
            return known
        for n in range(self.params.longest_gram, 0, -1):
            found = [s for g in grams_of(word, n) if (s := self.tables[n].get(g)) is not None]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.languages))


class Scorer:
    """Scores texts; remembers the score rows of words in one bounded matrix."""

    def __init__(self, model: LanguageModel, limit: int = 400_000):
        self.model, self.limit = model, limit
        self.rows = np.zeros((limit, max(1, len(model.languages))))
        self.best = np.full(limit, -1, np.int64)
        self.at: dict[str, int] = {}

    def row(self, word: str) -> int:
        k = len(self.at)
        scores = self.model.word_scores(word)
        self.rows[k] = scores
        self.best[k] = -1 if np.ptp(scores) == 0 else int(np.argmax(scores))
        self.at[word] = k
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORDS.findall(text.lower()) if text else []
        languages = self.model.languages
        if not words or not languages:
            return UNKNOWN, 0.0
        total, votes = np.zeros(len(languages)), np.zeros(len(languages) + 1)
        for k in range(0, len(words), 50_000):
            part = words[k:k + 50_000]
            if len(self.at) + len(part) > self.limit:
                self.at.clear()
            get = self.at.get
            ids = [i if (i := get(w)) is not None else self.row(w) for w in part]
            total += self.rows[ids].sum(axis=0)
            votes += np.bincount(self.best[ids] + 1, minlength=len(languages) + 1)
        best = int(np.argmax(total))
        return languages[best], float(votes[best + 1] / len(words))


def held_out(doc_id: str = "doc_id"):
    """Column: the id's remainder is the one kept away from learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def equal_part(sizes: list[int], total: int) -> int:
    """The largest limit for each of the sizes with which all together stay within the total."""
    left, limit = total, 0
    for i, size in enumerate(sorted(sizes)):
        limit = left // (len(sizes) - i)
        if size > limit:
            return limit
        left -= size
    return max(sizes, default=limit)


def learn(labelled: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Fit on rows (doc_id, text, lang); the tables that come to the driver are bounded by ``params``."""
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    n_docs = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if sum(n_docs.values()) > params.max_docs:
        part = max(1, equal_part(list(n_docs.values()), params.max_docs))
        shares = [x for lang, n in n_docs.items() if n > part for x in (F.lit(lang), F.lit(int(part / n * (1 << 30))))]
        if shares:
            rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
                               < F.coalesce(F.try_element_at(F.create_map(*shares), F.col("lang")), F.lit(1 << 30)))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sums: defaultdict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(f["lang"], f["text"]):
                sums[lang].update(WORDS.findall(text.lower()))
            yield pd.DataFrame([(lang, w, n) for lang, words in sums.items() for w, n in words.items()], columns=["lang", "word", "n"])

    words = rows.select("lang", "text").mapInPandas(split, "lang string, word string, n bigint") \
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def to_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sums: Counter = Counter()
            for lang, word, n in f.itertuples(index=False):
                sums[0, lang, word] += n
                for size in range(1, params.longest_gram + 1):
                    for gram in grams_of(word, size):
                        sums[size, lang, gram] += n
            yield pd.DataFrame([(*key, n) for key, n in sums.items()], columns=["size", "lang", "gram", "n"])

    grams = words.mapInPandas(to_grams, "size int, lang string, gram string, n bigint") \
        .groupBy("size", "gram", "lang").agg(F.sum("n").alias("n")).persist()
    try:
        totals: dict[str, list[float]] = {}
        entries: dict[int, dict[str, int]] = defaultdict(dict)
        for r in grams.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("entries")).collect():
            totals.setdefault(r["lang"], [0.0] * (params.longest_gram + 1))[r["size"]] = float(r["n"])
            entries[r["size"]][r["lang"]] = r["entries"]
        limits = {size: equal_part(list(held.values()), params.max_entries) for size, held in entries.items()}
        repeated = grams.filter(F.col("n") > 1)
        over = [(size, lang) for size, held in entries.items() for lang, n in held.items() if n > limits[size]]
        is_over = F.lit(False)
        for size in limits:
            is_over |= (F.col("size") == size) & F.col("lang").isin([lang for its, lang in over if its == size])
        kept = repeated.filter(~is_over)
        for size, lang in over:
            kept = kept.unionAll(repeated.filter((F.col("size") == size) & (F.col("lang") == lang))
                                 .orderBy(F.desc("n"), "gram").limit(limits[size]))
        counts = kept.select("size", "gram", "lang", "n").toPandas()
    finally:
        grams.unpersist()
    return LanguageModel(counts, totals, params)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; reads nothing but the text for its prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for f in frames:
            out = pd.DataFrame([scorer.predict(t) for t in f["text"]], columns=["lang_pred", "score"])
            out.insert(0, "held_out", f["held_out"].to_numpy())
            out.insert(0, "doc_id", f["doc_id"].to_numpy())
            yield out

    rows = narrow(docs, doc_id=(doc_id, "bigint"), text=(text, "string")) \
        .select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """Learn from the labelled rows that aren't held out, then judge every row."""
    rows = narrow(docs, doc_id=("doc_id", "bigint"), text=("text", "string"), lang=("lang", "string"))
    model = learn(rows.filter(F.col("doc_id").isNotNull() & ~held_out()), params)
    return identify(docs, model)

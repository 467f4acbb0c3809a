"""N-gram Jaccard self-join by a blocked sparse matrix product (operator 6).

Rows of the incidence matrix are distinct shingle sets (copies share a row),
columns are shingles. Columns are ordered by rarity. Two rows that reach the
similarity share at least ``n // SPARE + 1`` of their first ``n // 5 + 1 +
n // SPARE`` columns, n being the smaller size for the first number and each
row's own for the second; only these entries enter the product, block by block
(a block is a shuffle partition of columns). A row with fewer columns in
common with other rows than its smallest possible partner requires is dropped
whole, before any pairing. In the product itself a cell needs a column early
enough in both rows to be the first that a linked pair shares, and a pair whose
accumulated count cannot reach the bound of its two sizes with the columns that
follow is dropped; the full overlap is computed for the rest.

Rows sharing a column are not paired one by one with each other: first each is
paired with one row of the column, and links merge rows into components. Only
columns that still hold several components go on, and only rows that still have
enough of them; once the cross-component cells are few (in proportion to the
entries), when a round leaves nearly all entries, or after ``MAX_ROUNDS`` such
rounds, all of these cells are accumulated. So every link either is computed or lies inside one component.

Rarity comes from a fixed table of 2^20 hashed counts (4 MB whatever the
corpus); any order is right, rarity makes it quick. Shingles and sets are
named by 64-bit hashes.

Null or empty text (or white space only): no shingles, a component of its own.
Fewer words than a shingle: the whole sequence is the one shingle. Repeated
rows are copies. A null id never names a component unless no other id is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.llm.common import clear, column_index, narrow, step_folder, stored, with_plain_names
from netsift.llm.components import components

WORDS = 5
#: Similarity of at least 4/5: 9 * overlap >= 4 * (size + size).
MAX_ROUNDS = 4
#: One further prefix column for every SPARE shingles, and one more column that two linked rows must share.
SPARE = 10
SLOTS = 1 << 20
BLOCK = 4096
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit names of the text's word shingles; A-Z are lower-cased, words end at ASCII white space."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    one = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(one, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _MULTIPLIER + h[i:len(h) - k + 1 + i]
    return np.unique(mixed(out))


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    key = xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles))
    return key - (1 << 64) if key >= 1 << 63 else key


def set_rows(docs: DataFrame, words: int) -> DataFrame:
    """Per document (doc_id, digest, n, key); per task also its share of the hashed counts, in blocks (slot_block, counts, salt)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SLOTS, np.int64)
        for f in frames:
            n, keys = [], []
            for t in f["text"]:
                s = shingle_set(t, words)
                n.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                np.add.at(counts, (s & np.uint64(SLOTS - 1)).astype(np.int64), 1)
            yield pd.DataFrame({"doc_id": f["doc_id"], "digest": f["digest"], "n": n, "key": pd.array(keys, "Int64"),
                                "slot_block": None, "counts": None, "salt": None})
        if counts.any():
            blocks = counts.reshape(-1, BLOCK)
            yield pd.DataFrame({"doc_id": None, "digest": None, "n": None, "key": None, "slot_block": range(len(blocks)),
                                "counts": [b.astype("<i8").tobytes() for b in blocks],
                                "salt": TaskContext.get().partitionId() % 64})

    return docs.mapInPandas(run, "doc_id bigint, digest bigint, n bigint, key bigint, slot_block int, counts binary, salt int")


def hashed_counts(rows: DataFrame) -> np.ndarray:
    """The summed counts: always ``SLOTS`` numbers, added up in two levels."""

    def add(f: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for b in f["counts"]:
            total += np.frombuffer(b, "<i8")
        return pd.DataFrame({"slot_block": [f["slot_block"].iloc[0]], "counts": [total.tobytes()]})

    blocks = rows.filter("slot_block is not null").select("slot_block", "counts", "salt")
    kind = "slot_block int, counts binary"
    blocks = blocks.groupBy("slot_block", "salt").applyInPandas(add, kind).groupBy("slot_block").applyInPandas(add, kind)
    out = np.zeros(SLOTS, np.int64)
    for r in blocks.collect():
        out[r["slot_block"] * BLOCK:(r["slot_block"] + 1) * BLOCK] = np.frombuffer(r["counts"], "<i8")
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def prefix_entries(docs: DataFrame, counts: np.ndarray, words: int) -> DataFrame:
    """(token, key, n, p): the prefix columns of each set, rare ones first."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for f in frames:
            out, seen = [], set()
            for t in f["text"]:
                s = shingle_set(t, words)
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                first = np.lexsort((s, table[(s & np.uint64(SLOTS - 1)).astype(np.int64)]))[:len(s) // 5 + 1 + len(s) // SPARE]
                out.append((s[first].view(np.int64), key, len(s)))
            if out:
                sizes = [len(x[0]) for x in out]
                yield pd.DataFrame({"token": np.concatenate([x[0] for x in out]),
                                    "key": np.repeat([x[1] for x in out], sizes), "n": np.repeat([x[2] for x in out], sizes),
                                    "p": np.concatenate([np.arange(k) for k in sizes])})

    return docs.mapInPandas(run, "token bigint, key bigint, n int, p int")


def spare(n):
    """Column: prefix columns beyond the first that two rows share if ``n`` is the smaller size."""
    return F.floor(n / SPARE)


def reachable(n1, p1, n2, p2, before):
    """Column: sizes and positions of the shared column, with ``before`` shared ones ahead of it, still allow the similarity."""
    return (5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)) \
        & (9 * (F.least(n1 - p1, n2 - p2) + before) >= 4 * (n1 + n2))


def with_mates(entries: DataFrame) -> DataFrame:
    """Entries whose column holds a row of a size that fits: the next smaller or larger one decides.

    A row at least as large leaves a bound on the position; the prefix itself allows every smaller one of fitting size.
    """
    by_size = Window.partitionBy("token").orderBy("n", "key")
    e = entries.withColumn("under", F.lag("n").over(by_size)).withColumn("above", F.lead("n").over(by_size))
    smaller = 5 * F.col("under") >= 4 * F.col("n")
    larger = (5 * F.col("n") >= 4 * F.col("above")) \
        & (9 * (F.col("n") - F.col("p") + spare(F.col("n"))) >= 4 * (F.col("n") + F.col("above")))
    return e.filter(F.coalesce(smaller, F.lit(False)) | F.coalesce(larger, F.lit(False))).select("token", "key", "n", "p")


def with_enough(entries: DataFrame) -> DataFrame:
    """Entries of rows that keep as many columns as a link with a partner of the smallest fitting size needs."""
    rows = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")) \
        .filter(F.col("c") > spare(F.ceil(4 * F.col("n") / 5)))
    return entries.join(rows.select("key"), "key", "left_semi")


def pivot_pairs(entries: DataFrame, round_no: int) -> DataFrame:
    """Each row of a column with the column's pivot: the row with the fewest rarer shingles, later rows by turn.

    A row meets different pivots in its columns, so what a pair accumulates here is no bound; all pairs are verified.
    """
    by_turn = F.col("p") / F.col("n") if round_no == 0 else F.xxhash64("key", F.lit(round_no))
    best = F.min(F.struct(by_turn.alias("o"), "key", "n", "p", "label")).over(Window.partitionBy("token"))
    e = entries.withColumn("v", best)
    fits = reachable(F.col("n"), F.col("p"), F.col("v.n"), F.col("v.p"), spare(F.least("n", "v.n")))
    return e.filter((F.col("label") != F.col("v.label")) & fits) \
        .select(F.least("key", "v.key").alias("a"), F.greatest("key", "v.key").alias("b")).distinct()


def cross_pairs(entries: DataFrame) -> DataFrame:
    """Pairs of different components whose accumulated cells allow the similarity.

    The first column that a linked pair shares leaves the overlap's bound in both rows,
    so only columns that do make cells: rows that share a passage later on, after what is
    rarer in each, never meet. Such columns lie in both prefixes and lose no entry on the way here.
    """
    x = entries.select("token", *[F.col(c).alias(f"{c}1") for c in ("key", "n", "p", "label")])
    y = entries.select("token", *[F.col(c).alias(f"{c}2") for c in ("key", "n", "p", "label")])
    first = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("key1") < F.col("key2")))
    cells = x.join(y, "token").filter(first & (F.col("label1") != F.col("label2"))
                                      & reachable(F.col("n1"), F.col("p1"), F.col("n2"), F.col("p2"), 0))
    return accumulated(cells)


def accumulated(cells: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose count of cells, with the columns after the last one, can reach the overlap of their sizes."""
    after = F.least(F.min(F.col("n1") - F.col("p1")), F.min(F.col("n2") - F.col("p2"))) - 1
    return cells.groupBy("key1", "key2") \
        .agg(F.count(F.lit(1)).alias("c"), after.alias("after"), F.min(F.col("n1") + F.col("n2")).alias("total")) \
        .filter(9 * (F.col("c") + F.col("after")) >= 4 * F.col("total")) \
        .select(F.least("key1", "key2").alias("a"), F.greatest("key1", "key2").alias("b"))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose accumulated overlap reaches the similarity."""
    left = sets.select(F.col("key").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("key").alias("b"), F.col("tokens").alias("tb"))
    overlap = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b") \
        .filter(9 * overlap >= 4 * (F.size("ta") + F.size("tb"))).select("a", "b")


def sets_of(docs: DataFrame, rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(key, tokens) of the wanted sets, read again from one document of each (repeated rows of it may repeat a set)."""
    reps = rows.groupBy("key").agg(F.min("doc_id").alias("rep")).join(wanted, "key", "left_semi")
    found = docs.join(reps, docs["doc_id"].eqNullSafe(reps["rep"])).select("key", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(key, s.view(np.int64)) for key, t in zip(f["key"], f["text"])
                   if len(s := shingle_set(t, words)) and set_key(s) == key]
            yield pd.DataFrame(out, columns=["key", "tokens"])

    return found.mapInPandas(run, "key bigint, tokens array<bigint>")


def similarity_links(docs: DataFrame, rows: DataFrame, words: int, folder: str) -> DataFrame:
    """(node, root): the components of the linked sets (``rows`` as stored from set_rows); steps go to ``folder``."""
    entries = prefix_entries(docs, hashed_counts(rows), words).repartition("token") \
        .groupBy("token", "key").agg(F.min("n").alias("n"), F.min("p").alias("p"))
    entries = stored(with_mates(entries), "mated", large=True, folder=folder)
    entries = stored(with_enough(entries).withColumn("label", F.col("key")), "entries", folder=folder)
    size = entries.count()
    sets = stored(sets_of(docs, rows, entries.select("key").distinct(), words), "sets", large=True, folder=folder)
    links, left, stalled = None, size, False
    for round_no in range(MAX_ROUNDS + 1):
        counts = entries.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c")) \
            .groupBy("token").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        cells = counts.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0
        last = stalled or round_no == MAX_ROUNDS or cells <= 2 * size
        new = linked(cross_pairs(entries) if last else pivot_pairs(entries, round_no), sets)
        links = stored(new if links is None else links.unionAll(new), "similar", folder=folder)
        roots = components(links, folder=folder)
        if last:
            return roots
        labelled = entries.drop("label").join(roots.select(F.col("node").alias("key"), "root"), "key", "left") \
            .select("token", "key", "n", "p", F.coalesce("root", "key").alias("label"))
        several = labelled.groupBy("token").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l <> h")
        entries = stored(with_enough(labelled.join(several.select("token"), "token", "left_semi")), "entries", folder=folder)
        before, left = left, entries.count()
        stalled = round_no > 0 and left > 0.9 * before
    return roots


def grouped_rows(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, digest, n, key, component) for each row of (doc_id, text); no component without shingles."""
    docs = docs.withColumn("digest", F.xxhash64("text"))
    folder = step_folder(docs.sparkSession)
    everything = stored(set_rows(docs, words), "sets-named", folder=folder)
    roots = similarity_links(docs, everything, words, folder).toDF("key", "component")
    grouped = everything.filter("slot_block is null").select("doc_id", "digest", "n", "key") \
        .join(roots, "key", "left").withColumn("component", F.coalesce("component", "key"))
    grouped = stored(grouped, "grouped")
    clear(docs.sparkSession, folder)
    return grouped


def ngram_jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: the smallest id reachable over links of similarity >= 0.8."""
    rows = grouped_rows(narrow(docs, doc_id=(doc_id, "bigint"), text=(text, "string")), words)
    least = rows.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "component", "left") \
        .select("doc_id", F.col("n").alias("n_shingles"),
                F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """One row of ``docs`` per component, of the smallest id (null ids last), and all rows without shingles; all columns stay."""
    rows = grouped_rows(narrow(docs, doc_id=(doc_id, "bigint"), text=(text, "string")), words)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("v")
    kept = rows.filter("component is not null").groupBy("component").agg(first) \
        .select(F.col("v.doc_id").alias("kept_id"), F.col("v.digest").alias("kept_digest"), F.lit(True).alias("once"))
    kept = kept.unionAll(rows.filter("component is null").select("doc_id", "digest", F.lit(False)).distinct())
    plain, names = with_plain_names(docs)
    t, i = f"c{column_index(docs, text)}", f"c{column_index(docs, doc_id)}"
    same = F.col(i).cast("bigint").eqNullSafe(F.col("kept_id")) & (F.xxhash64(F.col(t).cast("string")) == F.col("kept_digest"))
    found = plain.join(kept, same)
    nth = F.row_number().over(Window.partitionBy("kept_id", "kept_digest").orderBy("kept_id"))
    return found.withColumn("nth", nth).filter("nth = 1 or not once").select(*plain.columns).toDF(*names)

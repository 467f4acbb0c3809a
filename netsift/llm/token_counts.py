"""Token counts by an exact length histogram (operator 2).

Documents are aggregated by their encoded length; sums over the histogram from
the long end answer, for every context limit at once, how many documents and
tokens lie beyond it and how many tokens remain when texts are cut there.

Null and empty texts have length 0 and count as documents. An empty table
gives an empty histogram. Repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.llm.bpe import loaded
from netsift.llm.common import column_index, narrow, stored, with_plain_names

#: Lengths per block of the suffix sums.
BLOCK = 64


def token_lengths(docs: DataFrame, path: str, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: the ``by`` columns as strings ``g0, g1, ...`` and ``n_tokens``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for f in frames:
            counts = [len(bpe.encode_bytes(t or "")) // 4 for t in f["text"]]
            yield f.drop(columns="text").assign(n_tokens=counts)

    groups = {f"g{i}": (c, "string") for i, c in enumerate(by)}
    schema = "".join(f"{g} string, " for g in groups) + "n_tokens bigint"
    return narrow(docs, **groups, text=(text, "string")).mapInPandas(run, schema)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(group columns, n_tokens, n_docs): combined on the map side, at most one row per group and length."""
    return lengths.groupBy(*lengths.columns).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with totals for a context limit of each of its lengths.

    ``docs_at_least`` and ``tokens_at_least``: of documents this long or
    longer; ``total_docs``, ``total_tokens``; ``truncated_tokens``: what remains
    when every text is cut at ``n_tokens``. Sums run over blocks of lengths
    first, then inside each block, so no task sees the whole histogram.
    """
    groups = [c for c in histogram.columns if c not in ("n_tokens", "n_docs")]
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)) \
        .withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy(*groups, "block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.partitionBy(*groups).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    blocks = blocks.select(*groups, "block",
                           F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("docs_after"),
                           F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("tokens_after"),
                           F.sum("bd").over(whole).alias("total_docs"), F.sum("bt").over(whole).alias("total_tokens"))
    same = h["block"] == blocks["block"]
    for g in groups:
        same &= h[g].eqNullSafe(blocks[g])
    inside = Window.partitionBy(*[h[g] for g in groups], h["block"]).orderBy(F.desc("n_tokens")) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = F.col("docs_after") + F.sum("n_docs").over(inside)
    tokens = F.col("tokens_after") + F.sum("tokens").over(inside)
    out = h.join(blocks, same).select(*[h[g].alias(g) for g in groups], "n_tokens", "n_docs", docs.alias("docs_at_least"),
                                      tokens.alias("tokens_at_least"), "total_docs", "total_tokens")
    return out.withColumn("truncated_tokens", F.col("total_tokens") - F.col("tokens_at_least")
                          + F.col("n_tokens") * F.col("docs_at_least"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """(group columns, tokens): what remains when texts are cut at any ``limit``, also one that is no length."""
    groups = [c for c in sums.columns if c not in SUM_COLUMNS]
    longer = F.col("n_tokens") > limit
    docs = F.max(F.when(longer, F.col("docs_at_least")).otherwise(0))
    tokens = F.max(F.when(longer, F.col("tokens_at_least")).otherwise(0))
    return sums.groupBy(*groups).agg((F.max("total_tokens") - tokens + limit * docs).alias("tokens"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """(group columns, length): the smallest length that at least the share ``q`` of documents doesn't exceed."""
    groups = [c for c in sums.columns if c not in SUM_COLUMNS]
    up_to = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    return sums.filter(up_to >= q * F.col("total_docs")).groupBy(*groups).agg(F.min("n_tokens").alias("length"))


SUM_COLUMNS = ("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "total_docs", "total_tokens", "truncated_tokens")


def token_counts(docs: DataFrame, path: str, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """Histogram with suffix sums per group of the ``by`` columns, under their names."""
    out = suffix_sums(stored(length_histogram(token_lengths(docs, path, text, by)), "lengths"))
    _, names = with_plain_names(docs)
    return out.toDF(*[names[column_index(docs, c)] for c in by], *out.columns[len(by):])

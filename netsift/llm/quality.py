"""Quality rules by compression bands (operator 4).

A document is rejected when the base counts fail, when the zstandard ratio of
the whole text (compressed / raw bytes) leaves the band of its length, or when
too large a part of its bytes lies in fixed chunks outside their band. Short
texts compress badly whatever they hold, so each length has its own limits: a
last partial chunk is judged by the band of a whole text of its length.

Null and empty text: all counts 0, ``base_failed`` (fewer than 20 words), not
kept, ratios null. Every input row gives one output row, repeated rows too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from netsift.llm.common import column_index, narrow, with_plain_names

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 8

SCHEMA = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
          "n_repeat_words bigint, base_failed boolean, whole_ratio double, bad_chunk_share double, kept boolean")


@dataclass(frozen=True)
class CompressionBands:
    """Limits; a band holds from its length in bytes up to the next one's."""

    #: (bytes from, lowest ratio, highest ratio)
    whole: tuple[tuple[int, float, float], ...] = field(default=(
        (0, 0.0, 9.9), (64, 0.45, 1.6), (128, 0.36, 1.3), (256, 0.34, 0.95), (512, 0.32, 0.82), (1024, 0.30, 0.75),
        (2048, 0.28, 0.71), (4096, 0.27, 0.68), (8192, 0.25, 0.66), (65536, 0.20, 0.64)))
    chunk_bytes: int = 1024
    chunk: tuple[float, float] = (0.28, 0.76)
    #: Rejected when chunks with more than this share of the bytes leave their band.
    bad_chunks: float = 0.3
    level: int = 3
    min_words: int = 20
    repeat_percent: int = 30


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside a ``window``-word span found twice or more in the text.

    Spans are named exactly: ids of words are paired to ids of 2, 4, 8 words.
    """
    if len(words) <= window:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    step = 1
    while step < window:
        _, ids = np.unique(ids[:-step] * len(words) + ids[step:], return_inverse=True)
        step *= 2
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    words = WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif WORD.search(line):
            seen.add(line)
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), dup, repeated_words(words)


def whole_band(n: int, bands: CompressionBands) -> tuple[float, float]:
    """(lowest, highest) ratio of a text of n bytes."""
    return [b for b in bands.whole if b[0] <= n][-1][1:]


def compression(raw: bytes, bands: CompressionBands, zstd: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """(ratio of the whole, share of bytes in chunks outside their band, verdict)."""
    n, size = len(raw), bands.chunk_bytes
    whole = len(zstd.compress(raw)) / n
    low, high = whole_band(n, bands)
    bad = 0
    for i in range(0, n, size):
        chunk = raw[i:i + size]
        least, most = bands.chunk if len(chunk) == size else whole_band(len(chunk), bands)
        ratio = len(zstd.compress(chunk)) / len(chunk)
        bad += len(chunk) * (not least <= ratio <= most)
    return whole, bad / n, low <= whole <= high and bad <= bands.bad_chunks * n


def judge(text: str | None, bands: CompressionBands, zstd: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    n_words, chars, symbols, dup, repeat = base_counts(text)
    failed = n_words < bands.min_words or 100 * repeat > bands.repeat_percent * n_words
    whole, share, good = compression(text.encode(), bands, zstd) if text else (None, None, False)
    return n_words, chars, symbols, dup, repeat, failed, whole, share, good and not failed


def quality_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  bands: CompressionBands = CompressionBands()) -> DataFrame:
    """Counts, ratios and verdict for each row of ``docs``; no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zstd = zstandard.ZstdCompressor(level=bands.level)
        names = [c.split()[0] for c in SCHEMA.split(", ")][1:]
        for f in frames:
            out = pd.DataFrame([judge(t, bands, zstd) for t in f["text"]], columns=names)
            out.insert(0, "doc_id", f["doc_id"].to_numpy())
            yield out

    return narrow(docs, doc_id=(doc_id, "bigint"), text=(text, "string")).mapInPandas(run, SCHEMA)


def keep_good(docs: DataFrame, text: str = "text", bands: CompressionBands = CompressionBands()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    plain, names = with_plain_names(docs)
    at = f"c{column_index(docs, text)}"

    def run(frames):
        zstd = zstandard.ZstdCompressor(level=bands.level)
        for batch in frames:
            kept = [judge(t, bands, zstd)[-1] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)

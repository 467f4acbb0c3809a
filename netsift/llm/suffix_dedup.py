"""Repeated byte strings by bucket-pointer refinement of suffixes (operator 7).

A byte goes when a 50-byte string covering it also starts in a document with a
smaller id. Suffixes only have to be told apart to a depth of 50 bytes, so the
suffix sort stops there, and it runs as a few shuffles instead of one sort.

1. A suffix's bucket is the name of its first 12 bytes. Every 50-byte window
   points to the smallest bucket among the 39 that lie inside it; windows that
   share the pointer make one run (20 suffixes in the mean). Equal windows
   point to equal buckets at equal distance, so only runs in one bucket are
   ever compared.
2. Inside a bucket runs are refined by the names of their first and last
   window, each made of the bucket names at later offsets (0, 12, 24, 36, 38).
   Runs that stay equal share all their windows: all but the smallest
   document's are done, and the result holds for all suffixes of the run at once.
3. Runs of different documents that also agree in the 19 bytes before (or
   after) the pointer may share the windows that reach as far: the ends of
   repeats. Only these windows are refined to the full depth one by one.

Equal runs meet inside each block of text first, so a passage that a third of
all documents holds enters a shuffle once per block. Names are hashes; what
counts as equal agrees in 96 bits or more. Texts over 2 MB are cut into overlapping blocks.

Null and empty texts have no bytes. A null id counts as larger than any other;
equal ids never remove each other, so repeated rows keep what a row alone would.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.llm.common import column_index, narrow, stored, with_plain_names

DEPTH = 50
GRAM = 12
PER_WINDOW = DEPTH - GRAM + 1
SIDE = (DEPTH - GRAM + 1) // 2
BLOCK = 1 << 21
#: Text per refinement group.
GROUP_BYTES = 1 << 25
NO_ID = np.iinfo(np.int64).max
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    return x ^ (x >> np.uint64(27))


def join_names(*names: np.ndarray) -> np.ndarray:
    """One name for several in a row."""
    out = mix(names[0])
    for n in names[1:]:
        out = mix(out * _A + n)
    return out


def eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view("<u8").ravel()


@dataclass
class Names:
    """Bucket names of the suffixes of a byte buffer."""

    raw: np.ndarray

    def __post_init__(self):
        self.word = eights(self.raw)
        self.bucket = join_names(self.word[:8 - GRAM], self.word[GRAM - 8:])

    def pointers(self) -> np.ndarray:
        """For each window start, the first position of its smallest bucket."""
        low, at = self.bucket, np.arange(len(self.bucket), dtype=np.int32)
        width = 1
        while width < PER_WINDOW:
            k = min(width, PER_WINDOW - width)
            later = low[k:] < low[:-k]
            low, at = np.where(later, low[k:], low[:-k]), np.where(later, at[k:], at[:-k])
            width += k
        return at

    def windows(self, start: np.ndarray) -> np.ndarray:
        b = self.bucket
        return join_names(*[b[start + k] for k in (*range(0, DEPTH - GRAM, GRAM), DEPTH - GRAM)])

    def side(self, start: np.ndarray) -> np.ndarray:
        """16-bit names of SIDE bytes, never 0."""
        w = self.word
        return (join_names(w[start], w[start + 8], w[start + SIDE - 8]) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


def blocks(frame: pd.DataFrame) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Lists of (doc_id, digest, base, bytes) of about BLOCK bytes; long texts in overlapping parts."""
    out, size = [], 0
    for doc_id, digest, text in zip(frame["doc_id"], frame["digest"], frame["text"]):
        raw = (text or "").encode()
        for base in range(0, max(1, len(raw) - DEPTH + 1), BLOCK):
            part = raw[base:base + BLOCK + DEPTH - 1]
            if len(part) >= DEPTH:
                out.append((NO_ID if pd.isna(doc_id) else int(doc_id), int(digest), base, part))
                size += len(part)
            if size >= BLOCK:
                yield out
                out, size = [], 0
    if out:
        yield out


RUN = [("bucket", "<u8"), ("ends", "<u4"), ("ends_more", "u1"), ("before", "<u2"), ("after", "<u2"), ("offset", "u1"),
       ("doc_id", "<i8"), ("digest", "<i4"), ("start", "<i4"), ("length", "u1")]
START = [name for name, _ in RUN].index("start")


def runs_of(block: list[tuple[int, int, int, bytes]]) -> np.ndarray:
    """The runs of all texts of a block, in order."""
    size = np.array([len(x[3]) for x in block])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    names = Names(np.frombuffer(b"".join(x[3] for x in block), np.uint8))
    at = names.pointers()
    count = size - DEPTH + 1
    start = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    doc = np.repeat(np.arange(len(block)), count)
    pointer = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (pointer[1:] != pointer[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(start)))
    s, d, p = start[first], doc[first], pointer[first].astype(np.int64)
    out = np.zeros(len(first), RUN)
    out["bucket"] = names.bucket[p]
    ends = join_names(names.windows(s), names.windows(s + length - 1), (p - s).astype(np.uint64), length.astype(np.uint64))
    out["ends"], out["ends_more"], out["offset"] = ends >> np.uint64(32), ends >> np.uint64(24) & np.uint64(255), p - s
    limit = (begin + size)[d]
    room = p - begin[d] >= SIDE
    out["before"][room] = names.side(p[room] - SIDE)
    room = p + GRAM + SIDE <= limit
    out["after"][room] = names.side(p[room] + GRAM)
    out["doc_id"] = np.array([x[0] for x in block], np.int64)[d]
    out["digest"] = np.array([x[1] for x in block], np.int32)[d]
    out["start"] = s - begin[d] + np.array([x[2] for x in block], np.int64)[d]
    out["length"] = length
    return out


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def settled(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs equal to one of a smaller document, the others), by sorting on bucket, then on the later names."""
    runs = runs[np.lexsort((runs["doc_id"], runs["ends_more"], runs["ends"], runs["bucket"]))]
    if not len(runs):
        return runs, runs
    first = group_starts(runs["bucket"], runs["ends"], runs["ends_more"])
    least = np.repeat(runs["doc_id"][first], np.diff(np.append(first, len(runs))))
    done = runs["doc_id"] > least
    return runs[done], runs[~done]


def unsettled(runs: np.ndarray) -> np.ndarray:
    """The parts of runs that another document's run may share: same bucket, same bytes before or after the pointer.

    A window that starts SIDE bytes or more before the pointer holds the bytes
    before it, any other the bytes after it.
    """
    early = np.zeros(len(runs), bool)
    late = np.zeros(len(runs), bool)
    for side, keep in (("before", early), ("after", late)):
        some = np.flatnonzero(runs[side])
        if not len(some):
            continue
        some = some[np.lexsort((runs[side][some], runs["bucket"][some]))]
        first = group_starts(runs["bucket"][some], runs[side][some])
        ids, counts = runs["doc_id"][some], np.diff(np.append(first, len(some)))
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        keep[some[np.repeat(several, counts)]] = True
    offset, length = runs["offset"].astype(np.int64), runs["length"].astype(np.int64)
    n_early = np.clip(offset - SIDE + 1, 0, length)
    a, b = runs[early & (n_early > 0)], runs[late & (n_early < length)]
    a["length"] = n_early[early & (n_early > 0)]
    cut = n_early[late & (n_early < length)]
    b["start"] += cut
    b["length"] -= cut.astype(np.uint8)
    return np.concatenate([a, b])


def packed(runs: np.ndarray) -> bytes:
    """Column by column, starts as differences: compresses better than rows."""
    runs = runs[np.lexsort((runs["start"], runs["digest"], runs["doc_id"]))]
    columns = [np.ascontiguousarray(runs[name]) for name, _ in RUN]
    columns[START] = np.diff(columns[START], prepend=np.int32(0)).astype("<i4")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def unpacked(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at = len(raw) // np.dtype(RUN).itemsize, 0
    out = np.zeros(n, RUN)
    for name, kind in RUN:
        column = np.frombuffer(raw, kind, n, at)
        at += column.nbytes
        out[name] = np.cumsum(column) if name == "start" else column
    return out


def per_document(runs: np.ndarray, kind: int) -> pd.DataFrame:
    """(doc_id, digest, kind, marks): the runs' places as packed (start, length) pairs."""
    runs = runs[np.lexsort((runs["start"], runs["digest"], runs["doc_id"]))]
    if not len(runs):
        return pd.DataFrame({"doc_id": np.zeros(0, np.int64), "digest": np.zeros(0, np.int32), "kind": np.zeros(0, np.int32), "marks": []})
    first = group_starts(runs["doc_id"], runs["digest"])
    pairs = np.stack([runs["start"].astype("<i4"), runs["length"].astype("<i4")], axis=1)
    marks = [pairs[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(runs)))]
    return pd.DataFrame({"doc_id": runs["doc_id"][first], "digest": runs["digest"][first], "kind": kind, "marks": marks})


MARKS = "doc_id bigint, digest int, kind int, marks binary"
DONE, OPEN = 0, 1


def run_marks(docs: DataFrame, groups: int) -> DataFrame:
    """Per document the runs that are settled (DONE) and those to refine further (OPEN)."""

    def name(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for block in blocks(f):
                done, rest = settled(runs_of(block))
                group = (rest["bucket"] % np.uint64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                rest, group = rest[order], group[order]
                first = group_starts(group) if len(group) else group
                parts = [rest[a:b] for a, b in zip(first, np.append(first[1:], len(rest)))]
                out = pd.DataFrame({"part": group[first], "runs": [packed(p) for p in parts]})
                yield out.assign(doc_id=0, digest=0, kind=DONE, marks=None)  # no nulls: pandas would make the ids floats
                if len(done):
                    found = per_document(done, DONE)
                    yield found.assign(part=[int(d) % groups for d in found["digest"]], runs=None)

    def refine(f: pd.DataFrame) -> pd.DataFrame:
        own = f["runs"].notna()
        parts = [unpacked(x) for x in f.loc[own, "runs"]]
        done, rest = settled(np.concatenate(parts) if parts else np.zeros(0, RUN))
        return pd.concat([f.loc[~own, ["doc_id", "digest", "kind", "marks"]],
                          per_document(done, DONE), per_document(unsettled(rest), OPEN)])

    return docs.mapInPandas(name, f"part bigint, runs binary, {MARKS}").groupBy("part").applyInPandas(refine, MARKS)


def window_names(raw: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a 32-bit name of the windows at ``start``, from the 8-byte names at offsets 0, 8, ... and the last 8 bytes."""
    window = raw[start[:, None] + np.arange(DEPTH)]
    words = [np.ascontiguousarray(window[:, k:k + 8]).view("<u8").ravel() for k in (*range(0, DEPTH - 8, 8), DEPTH - 8)]
    other = join_names(*words[::-1], words[3]) >> np.uint64(32)
    return join_names(*words), other.astype(np.uint32).view(np.int32)


def window_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Refines the OPEN runs window by window; the windows that start in a smaller document, as DONE marks."""

    def name(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a, b, starts, rows = [], [], [], []
            for row, (text, lists) in enumerate(zip(f["text"], f["lists"])):
                pairs = np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 2) for x in lists]).astype(np.int64)
                before = np.cumsum(pairs[:, 1]) - pairs[:, 1]
                start = np.unique(np.repeat(pairs[:, 0] - before, pairs[:, 1]) + np.arange(pairs[:, 1].sum()))
                raw = np.frombuffer(text.encode(), np.uint8)
                for k in range(0, len(start), BLOCK // DEPTH):
                    part = start[k:k + BLOCK // DEPTH]
                    one, other = window_names(raw, part)
                    a.append(one)
                    b.append(other)
                starts.append(start)
                rows.append(np.full(len(start), row))
            if rows:
                row = np.concatenate(rows)
                yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b), "doc_id": f["id"].to_numpy()[row],
                                    "digest": f["digest"].to_numpy()[row], "start": np.concatenate(starts).astype(np.int32)})

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            marks = [np.stack([np.sort(x).astype("<i4"), np.ones(len(x), "<i4")], axis=1).tobytes() for x in f["starts"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "digest": f["digest"], "kind": DONE, "marks": marks})

    found = with_lists(docs, marks.filter(F.col("kind") == OPEN), "inner")
    rows = found.mapInPandas(name, "a bigint, b int, doc_id bigint, digest int, start int")
    least = F.min("doc_id").over(Window.partitionBy("a", "b"))
    return rows.withColumn("least", least).filter("doc_id > least").groupBy("doc_id", "digest") \
        .agg(F.collect_list("start").alias("starts")).mapInPandas(pack, MARKS)


def with_lists(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Documents with all their marks in one list."""
    lists = marks.groupBy(F.col("doc_id").alias("m_id"), F.col("digest").alias("m_digest")).agg(F.collect_list("marks").alias("lists"))
    plain = docs.withColumn("id", F.coalesce("doc_id", F.lit(int(NO_ID))))
    return plain.join(lists, (plain["id"] == lists["m_id"]) & (plain["digest"] == lists["m_digest"]), how).drop("m_id", "m_digest")


def repeat_marks(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, kind, marks) of all window starts to remove; ``docs``: (doc_id, digest, text)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marks = stored(run_marks(docs, max(64, size // GROUP_BYTES)), "runs", large=True)
    more = stored(window_marks(docs, marks), "windows", large=True)
    return marks.filter(F.col("kind") == DONE).unionByName(more)


def removed_mask(n: int, lists) -> np.ndarray:
    """Which of ``n`` bytes are covered by the marked windows."""
    edge = np.zeros(n + 1, np.int64)
    for x in lists if lists is not None else ():
        pairs = np.frombuffer(x, "<i4").reshape(-1, 2)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 0] + pairs[:, 1] + DEPTH - 1, -1)
    return np.cumsum(edge)[:-1] > 0


def narrowed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    rows = narrow(docs, doc_id=(doc_id, "bigint"), text=(text, "string"))
    return rows.select("doc_id", digest_of(F.col("text")).alias("digest"), "text")


def digest_of(text: Column) -> Column:
    """Tells apart rows of the same id: a non-negative 32-bit hash of the text."""
    return F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def repeat_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""
    rows = narrowed(docs, text, doc_id)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for d, t, lists in zip(f["doc_id"], f["text"], f["lists"]):
                raw = (t or "").encode()
                gone = spans = 0
                kept = raw
                if lists is not None and len(lists):
                    mask = removed_mask(len(raw), lists)
                    gone, spans = int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                out.append((d, len(raw), gone, spans, hashlib.sha256(kept).hexdigest()))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            yield frame.astype({"doc_id": "Int64"})

    return with_lists(rows, repeat_marks(rows), "left").select("doc_id", "text", "lists") \
        .mapInPandas(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the repeated bytes cut from the text; a character cut in part goes whole. Other columns stay."""
    marks = repeat_marks(narrowed(docs, text, doc_id))
    lists = marks.groupBy(F.col("doc_id").alias("m_id"), F.col("digest").alias("m_digest")).agg(F.collect_list("marks").alias("lists"))
    plain, names = with_plain_names(docs)
    t, i = f"c{column_index(docs, text)}", f"c{column_index(docs, doc_id)}"
    plain = plain.withColumn(t, F.col(t).cast("string"))
    same = (F.coalesce(F.col(i).cast("bigint"), F.lit(int(NO_ID))) == F.col("m_id")) & (digest_of(F.col(t)) == F.col("m_digest"))

    columns = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, marks_of in zip(batch.column(t).to_pylist(), batch.column("lists").to_pylist()):
                if value is not None and marks_of:
                    raw = np.frombuffer(value.encode(), np.uint8)
                    value = raw[~removed_mask(len(raw), marks_of)].tobytes().decode("utf-8", "ignore")
                texts.append(value)
            out = [batch.column(c) if c != t else pa.array(texts, batch.column(c).type) for c in columns]
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return plain.join(lists, same, "left").select(*columns, "lists").mapInArrow(run, plain.schema).toDF(*names)

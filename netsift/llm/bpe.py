"""Byte-level BPE encoding and decoding (operator 9).

Encoder: an Aho-Corasick automaton over the vocabulary gives the longest token
at each byte; tokens are placed greedily and kept only when every neighbouring
pair is compatible (encoding the two tokens' bytes alone gives just these two),
with one step back when no shorter token fits. Each byte position is left for
good at most once, so a piece takes linear time, and the result equals the
merge procedure exactly. Decoder: all token bytes lie in one buffer, an offset
table gives each token's place.

Null and empty text: no tokens; both hashes are those of the empty string.
Every input row gives one output row.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from netsift.llm.common import narrow

# The white space of the pre-tokenizer's pattern, and its contractions.
SPACE = "\t-\r \x85\xa0  -     　"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def category_class(first: str) -> str:
    """Ranges of the code points whose general category starts with ``first``, by the newer tables of ``regex``."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    runs = regex.findall(rf"\p{{{first}}}+", every)
    return "".join(f"{re.escape(run[0])}-{re.escape(run[-1])}" for run in runs)


def piece_pattern(compiler, letter: str, number: str, space: str):
    """The pre-tokenizer's pattern over the given character ranges.

    Letters stand first: no other alternative can match where they do.
    """
    return compiler(f" ?[{letter}]+|{CONTRACTIONS}| ?[{number}]+| ?[^{space}{letter}{number}]+"
                    f"|[{space}]+(?![^{space}])|[{space}]+")


def latin(ranges: str) -> str:
    """The part of the ranges below U+0100: texts of these characters alone get the quicker pattern."""
    member = re.compile(f"[{ranges}]")
    return "".join(re.escape(chr(c)) for c in range(256) if member.match(chr(c)))


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Pieces(dict):
    """piece -> its ids as little-endian bytes; two generations bound the memory."""

    def __init__(self, bpe: "ByteBpe", limit: int):
        super().__init__()
        self.bpe, self.limit, self.old = bpe, limit, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = b"".join(map(self.bpe.packed.__getitem__, self.bpe.encode_piece(piece.encode())))
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class ByteBpe:
    """One vocabulary: encoder tables and the decoder's offset table."""

    def __init__(self, path: str, cache: int = 100_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        unmask = byte_alphabet()
        raw = lambda token: bytes(unmask[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        self.tokens = [b""] * size
        for t, i in vocab.items():
            self.tokens[i] = t
        #: merged pair -> (rank, id); id -> the pair it was merged from
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            if pair not in self.merges:
                self.merges[pair] = (rank, made)
                self.parts.setdefault(made, (*pair, rank))
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        for t, i in vocab.items():
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in vocab:
                    self.shorter[i] = vocab[t[:n]]
                    break
        self.length = [len(t) for t in self.tokens]
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.compatible: dict[tuple[int, int], bool] = {}
        self.whole = vocab
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.added = added
        for s, i in added.items():
            self.tokens[i] = s.encode()
        self.buffer = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in self.tokens])]).astype(np.int64)
        letter, number = category_class("L"), category_class("N")
        self.find_any = piece_pattern(regex.compile, r"\p{L}", r"\p{N}", SPACE).findall
        self.find_latin = piece_pattern(re.compile, latin(letter), latin(number), latin(SPACE)).findall
        self.pieces = Pieces(self, cache)

    # -- encoding -----------------------------------------------------------

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens leaves exactly these two tokens.

        The last merge inside either token is undone step by step; a merge
        across the border that ranks before the one undone would have run first.
        """
        known = self.compatible.get((left, right))
        if known is not None:
            return known
        a, b, good = left, right, True
        a_done = b_done = 1 << 60  # ranks from which on the left (right) token is whole
        while True:
            across = self.merges.get((a, b))
            # It would run before the merge that uses up ``a`` (to the left: ties go left first) or ``b``.
            if across is not None and across[0] < a_done and across[0] < b_done:
                good = False
                break
            pa, pb = self.parts.get(a), self.parts.get(b)
            if pa is None and pb is None:
                break
            if pb is None or (pa is not None and pa[2] >= pb[2]):
                a, a_done = pa[1], pa[2]
            else:
                # A pair across equal in rank to the right token's own merge lies further left and runs first.
                b, b_done = pb[0], pb[2] + 1
        if len(self.compatible) >= 2_000_000:
            self.compatible.clear()
        self.compatible[left, right] = good
        return good

    def encode_piece(self, raw: bytes) -> list[int]:
        whole = self.whole.get(raw)
        if whole is not None and (whole in self.parts or len(raw) == 1):
            return [whole]
        n, shorter, length = len(raw), self.shorter, self.length
        longest = [-1] * n
        reach = [0] * n
        for end, (size, token) in self.automaton.iter(raw.decode("latin-1")):
            at = end - size + 1
            if size > reach[at]:
                reach[at], longest[at] = size, token
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            if open_at[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
                continue
            if shorter[token] >= 0:
                token = shorter[token]
                continue
            open_at[at] = 0  # nothing fits from here: take the last token back and try a shorter one
            token = out.pop()
            at -= length[token]
        return out

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        get = self.pieces.__getitem__
        try:
            text.encode("latin-1")
            find = self.find_latin
        except UnicodeEncodeError:
            find = self.find_any
        if self.special is None:
            return b"".join(map(get, find(text)))
        out = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            else:
                out.extend(map(get, find(part)))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    # -- decoding -----------------------------------------------------------

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        out = []
        for k in range(0, len(ids), 65536):  # bounds the index arrays on very long texts
            part = ids[k:k + 65536].astype(np.int64)
            start = self.offset[part]
            size = self.offset[part + 1] - start
            before = np.cumsum(size) - size
            out.append(self.buffer[np.repeat(start - before, size) + np.arange(int(size.sum()))].tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """The tables of a vocabulary file, made once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids) for each row; ids as an integer array."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for f in frames:
            for part in slices(f):
                ids = [np.frombuffer(bpe.encode_bytes(t or ""), "<u4").astype(np.int32) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": [len(x) for x in ids], "ids": ids})

    return narrow(docs, doc_id=(doc_id, "bigint"), text=(text, "string")) \
        .mapInPandas(run, "doc_id bigint, n_tokens bigint, ids array<int>")


def slices(frame: pd.DataFrame, rows: int = 1000) -> Iterator[pd.DataFrame]:
    for k in range(0, len(frame), rows):
        yield frame.iloc[k:k + rows]


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) for each row of token ids; a null list gives the empty text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"],
                                "text": [bpe.decode(np.asarray(x, np.int64)) if x is not None else "" for x in f["ids"]]})

    return narrow(rows, doc_id=(doc_id, "bigint"), ids=(ids, "array<int>")).mapInPandas(run, "doc_id bigint, text string")


def round_trip_digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode and decode each row; counts and hashes of both results, without shipping the ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for f in frames:
            n, ids_hash, text_hash = [], [], []
            for t in f["text"]:
                ids = bpe.encode_bytes(t or "")
                back = bpe.decode(np.frombuffer(ids, "<u4"))
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(back.encode()).hexdigest())
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": text_hash})

    return narrow(docs, doc_id=(doc_id, "bigint"), text=(text, "string")) \
        .mapInPandas(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

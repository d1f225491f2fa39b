"""Best-fit packing of documents into sequences, by vector best-fit.

Each piece of a document takes tokens, one document slot and an attention cost
from the sequence that holds it: the square of its length, as each token looks at
its own document. Each sequence has a capacity of all three. Pieces are placed
longest first. Among the open sequences with room in every dimension, the one is
taken that leaves the smallest weighted norm of residual capacity (rule
"residual") or that has the largest weighted dot product of need and residual
(rule "dot").

By default a sequence has as many slots as tokens, and the attention cost of one
piece that fills it: pieces that fit by their tokens fit by both others, so these
choose among sequences but never cost one. A trainer with tighter masks or
kernels that compute in tiles says so by a Capacity of its own.

Tokenising runs where the documents are; only (doc_id, piece, start, length,
crc) is shuffled, dealt by hash into groups of a bounded number of pieces.
Sequences that a group leaves open are dealt and packed once more, so that the
number of groups does not show in the number of sequences.

Defined results: null or empty text is the single end token; a null doc_id is
kept as such; repeated rows are packed as often as they occur; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.session import materialize, read, unused

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """What a sequence can hold, and the weight of each dimension."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    tile: int = 1

    def cost(self, n: int) -> int:
        """The attention cost of a piece of n tokens."""
        return (-(-n // self.tile) * self.tile) ** 2


# ------------------------------------------------------------ tokenising
#: A word of plain Latin letters, perhaps with ASCII punctuation (no quote,
#: which may begin a contraction) after it: its letters are one pre-token.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*[A-Za-z])([!-&(-/:-@\[-`{-~]+)|([A-Za-zÀ-ÖØ-öø-ÿ]+)")
#: The byte-level alphabet: printable Latin-1 stands for itself, each other
#: byte for the next free character from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _SELF} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SELF)}


class WordIds(dict):
    """The token ids (little-endian unsigned 32-bit) of words, by need. The
    tokenizer drops white space before it splits, so a text's ids are its
    words' ids in order. Plain words go to the BPE model as they would come
    out of the tokenizer's normaliser; all others take the whole tokenizer.
    About `most` words are kept."""

    def __init__(self, path: str, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        normal, split = str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)
        self.plain = "Lowercase" in normal and "ByteLevel" in split and not self.tokenizer.model.ignore_merges
        self.bpe, self.most, self.stems = self.tokenizer.model.tokenize, most, {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain and (m := PLAIN.fullmatch(text)):
            stem = (m[1] or m[3]).lower()
            ids = self.stems.get(stem)
            if ids is None:
                mapped = stem if stem.isascii() else "".join(map(BYTE_CHARS.__getitem__, stem.encode()))
                ids = self.stems[stem] = struct.pack(f"<{len(t := self.bpe(mapped))}I", *[x.id for x in t])
            if m[2]:
                if (tail := self.stems.get(m[2])) is None:
                    tail = self.stems[m[2]] = self.whole(m[2])
                ids += tail
        else:
            ids = self.whole(text)
        self[word] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        if len(self) > self.most:
            self.clear()
        if len(self.stems) > self.most:
            self.stems.clear()
        return b"".join(map(self.__getitem__, (text or "").encode().split()))


_WORDS: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """The pieces of each document's ids and the end id, cut only after each
    `size` tokens. tokenizer: a file that each executor has."""
    end = np.asarray([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _WORDS:
            _WORDS[tokenizer] = WordIds(tokenizer)
        ids_of = _WORDS[tokenizer].of
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = ids_of(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)


# --------------------------------------------------------------- packing
def best_fit(lengths: np.ndarray, cap: Capacity, rule: str = "residual") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length: bin and place in it; and the tokens that each bin has
    left. Open bins are kept in the order of tokens left, of equal ones the
    newest first, which is also how ties are broken. Every bin with room is
    scored, but under "residual" those whose tokens alone score no less than
    the best found."""
    wt, wd, wa = cap.weights
    order = np.argsort(-lengths, kind="stable")
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left: list[int] = []
    open_, m = np.zeros((4, 1024), np.int64), 0  # tokens, documents, attention; bin
    for i in order.tolist():
        n = int(lengths[i])
        c = cap.cost(n)
        if n > cap.tokens or c > cap.attention or cap.documents < 1:
            raise ValueError(f"a piece of {n} tokens fits into no sequence")
        best, score = -1, np.inf
        at, step = int(open_[0, :m].searchsorted(n)), 64
        while at < m:
            if rule != "dot" and wt * ((int(open_[0, at]) - n) / cap.tokens) ** 2 >= score:
                break
            to = m if rule == "dot" else min(m, at + step)
            t, d, a = open_[:3, at:to]
            if rule == "dot":
                s = -(wt * n / cap.tokens * t / cap.tokens + wd / cap.documents * d / cap.documents + wa * c / cap.attention * a / cap.attention)
            else:
                s = wt * ((t - n) / cap.tokens) ** 2 + wd * ((d - 1) / cap.documents) ** 2 + wa * ((a - c) / cap.attention) ** 2
            s[a < c] = np.inf
            k = int(s.argmin())
            if s[k] < score:
                best, score = at + k, s[k]
            at, step = to, 4 * step
        if best < 0:
            if m == open_.shape[1]:
                open_ = np.concatenate([open_, np.zeros_like(open_)], 1)
            best, m = m, m + 1
            open_[:, best] = cap.tokens, cap.documents, cap.attention, len(left)
            left.append(cap.tokens)
        t, d, a, b = open_[:, best].tolist()
        bins[i], places[i] = b, cap.tokens - t
        left[b] = t - n
        if t > n and d > 1 and a > c:
            to = int(open_[0, :best].searchsorted(t - n))
            open_[:, to + 1 : best + 1] = open_[:, to:best].copy()
            open_[:, to] = t - n, d - 1, a - c, b
        else:
            open_[:, best : m - 1] = open_[:, best + 1 : m].copy()
            m -= 1
    return bins, places, np.asarray(left, np.int64)


def pack(pieces: DataFrame, cap: Capacity = Capacity(), rule: str = "residual", group_rows: int = 50_000, open_share: float = 0.01) -> DataFrame:
    """Adds sequence_id and offset to pieces (with a length column).

    pieces should be a table that is cheap to read twice. A group holds about
    group_rows pieces; what its sequences with more than open_share of their
    tokens left hold is packed anew, over groups of the same size."""
    cols = pieces.columns
    group_, left_ = unused(pieces, "_group", "_left")

    def dealt(df: DataFrame, base: int) -> tuple[DataFrame, int]:
        """By place and not by value, so that equal rows are spread; df is read
        from files, so a lost task deals its rows as before."""
        groups = max(1, -(-df.count() // group_rows))
        return df.withColumn(group_, F.lit(base) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))), groups

    def packed(df: DataFrame) -> DataFrame:
        def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", *cols], kind="stable", ignore_index=True)
            bins, places, left = best_fit(pdf["length"].to_numpy(), cap, rule)
            out = pdf[cols].copy()
            out["sequence_id"], out["offset"] = (int(key[0]) << 32) + bins, places
            out[left_] = left[bins]
            return out

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
        return df.groupBy(group_).applyInPandas(group, f"{types}, sequence_id long, offset long, `{left_}` long")

    df, n = dealt(pieces, 0)
    first = packed(df)
    if n == 1:
        return first.drop(left_)
    first = materialize(first, "packed")
    full = F.col(left_) <= int(open_share * cap.tokens)
    rest, _ = dealt(first.where(~full).select(*cols), n)
    return first.where(full).drop(left_).unionByName(packed(rest).drop(left_))


def op6_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = token_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(materialize(pieces, "pieces"))

"""BPE encoding and decoding with content-defined chunk reuse.

1. Each text is cut into chunks where a rolling hash of the last 32 bytes says
   so; equal passages are cut alike, wherever they stand. A text is one row of
   its chunks' 64-bit digests.
2. Digests that occur twice, in two texts or in one, are shared. One text of each
   brings the chunk's bytes, which are encoded once for all.
3. Each text gets the ids of its shared chunks (held against 128 bits of its
   own chunk, so that a collision is encoded anew), encodes the stretches between
   them, and repairs each join: the words around it are encoded together, in
   windows that grow by a word on each side until one more word changes nothing
   and both sides have encoded the window's parts in the same way. A window ends
   at an anchor, one space between two ASCII letters or digits, where neither
   this family of tokenizers nor byte-level ones look across; it grows to the
   whole text where there is none.

Equal texts are encoded once, whatever their ids. A text is shuffled once, by
its hash; what joins on digests is narrow, and a frequent chunk's occurrences are
a plain join side that Spark may split. Of a text, only its own chunks meet in
one row.

Defined results: null text is empty and has no ids; a null doc_id is kept as
such; repeated rows are returned as often as they occur; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.packing import WordIds
from almanac.session import materialize, read, unused

U64 = np.uint64
MULTIPLIER = 0x9E3779B97F4A7C15
GEAR = np.random.default_rng(20).integers(1, 2**64 - 1, 256, dtype=U64)
SPAN = 32  # bytes that decide about a cut
LEAST, BITS, MOST = 128, 9, 8192  # bytes of a chunk: at least, 2^BITS more on average, at most


# -------------------------------------------------------------- chunks
@np.errstate(over="ignore")
def cuts(data: bytes, least: int = LEAST, bits: int = BITS, most: int = MOST) -> list[int]:
    """The ends of a text's chunks (UTF-8), none of them inside a character."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h, k = GEAR[raw], 1
    while k < SPAN:
        power = U64(pow(MULTIPLIER, k, 1 << 64))
        h[k:] += h[:-k] * power  # the right side is worked out first
        k *= 2
    at = np.flatnonzero((h[:-1] >> U64(64 - bits)) == 0) + 1
    ends, start = [], 0
    for end in [*at[(raw[at] & 0xC0) != 0x80].tolist(), n]:
        while end - start > most:
            forced = start + most
            while raw[forced] & 0xC0 == 0x80:
                forced -= 1
            ends.append(start := forced)
        if end - start >= least or end == n:
            ends.append(start := end)
    return ends


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def narrow(long_digest: bytes) -> int:
    return int.from_bytes(long_digest[:8], "little", signed=True)


# ------------------------------------------------------------- encoding
class Codec:
    """A tokenizer's encode and decode on bytes. Ids are little-endian 32-bit."""

    def __init__(self, path: str):
        self.words = WordIds(path)
        tokenizer = self.words.tokenizer
        tokenizer.no_truncation()
        tokenizer.no_padding()
        # where white space is dropped before the split, words are independent
        self.by_word = "Removed" in str(tokenizer.pre_tokenizer)
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [tokenizer.id_to_token(i) or "" for i in range(size)] if tokenizer.decoder is None else None

    def encode(self, data: bytes) -> bytes:
        if not data:
            return b""
        text = data.decode()
        return self.words.of(text) if self.by_word else self.words.whole(text)

    def decode(self, ids: np.ndarray) -> str:
        if self.tokens is None:
            return self.words.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _plain(byte: int) -> bool:
    return 48 <= byte <= 57 or 65 <= byte <= 90 or 97 <= byte <= 122


def anchor(data: bytes, at: int, forward: bool) -> int:
    """The nearest anchor beyond a place, or the end of the text there."""
    at = data.find(b" ", at + 1) if forward else data.rfind(b" ", 0, max(at, 0))
    while at > 0:
        if at + 1 < len(data) and _plain(data[at - 1]) and _plain(data[at + 1]):
            return at
        at = data.find(b" ", at + 1) if forward else data.rfind(b" ", 0, at)
    return len(data) if forward else 0


def joined(data: bytes, parts: list[tuple[int, int, bytes]], encode) -> bytes:
    """The ids of a text from the ids of its parts (start, end, ids), which
    cover it in order, with every join repaired."""
    out, i = bytearray(), 0
    while i < len(parts):
        start, end, ids = parts[i]
        if start == 0:
            out += ids
            i += 1
            continue
        left, right = anchor(data, start, False), anchor(data, start, True)
        while True:
            window = encode(data[left:right])
            wider_left, wider_right = anchor(data, left, False), anchor(data, right, True)
            whole = left == 0 and right == len(data)
            agreed = whole or encode(data[wider_left:wider_right]) == encode(data[wider_left:left]) + window + encode(data[right:wider_right])
            before = encode(data[left:start]) if left else bytes(out)
            k = i
            while parts[k][1] < right:
                k += 1
            last_start, last_end, last_ids = parts[k]
            head = encode(data[last_start:right]) if right < last_end else last_ids
            if agreed and out.endswith(before) and last_ids.startswith(head):
                break
            left, right = wider_left, wider_right
        del out[len(out) - len(before) :]
        out += window
        out += last_ids[len(head) :]
        i = k + 1
    return bytes(out)


def parts_of(data: bytes, known: dict[int, tuple[bytes, bytes]], encode, sizes: tuple[int, int, int]) -> list[tuple[int, int, bytes]]:
    """A text as shared chunks with their ids, and stretches between, encoded here."""
    parts, start, pending = [], 0, 0
    if known:
        for pos, end in enumerate(cuts(data, *sizes)):
            if (entry := known.get(pos)) and entry[0] == digest(chunk := data[start:end]):
                if pending < start:
                    parts.append((pending, start, encode(data[pending:start])))
                parts.append((start, start + len(chunk), entry[1]))
                pending = end
            start = end
    if pending < len(data):
        parts.append((pending, len(data), encode(data[pending:])))
    return parts


# ------------------------------------------------------------ DataFrames
def _rows(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def chunked(texts: DataFrame, sizes: tuple[int, int, int]) -> DataFrame:
    """key and the digests of each text's chunks, for texts (key, text)."""
    schema = pa.schema([("key", pa.binary()), ("digests", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1):
                data, start, row = text.as_py().encode(), 0, []
                for end in cuts(data, *sizes):
                    row.append(narrow(digest(data[start:end])))
                    start = end
                out.append(row)
            yield _rows([b.column(0).to_pylist(), out], schema)

    return texts.mapInArrow(run, "key binary, digests array<long>")


def encoded_chunks(wanted: DataFrame, tokenizer: str, sizes: tuple[int, int, int]) -> DataFrame:
    """digest, its 128 bits and the ids of the chunks `places` of each text."""
    schema = pa.schema([("digest", pa.int64()), ("full", pa.binary()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(tokenizer).encode
        for b in batches:
            rows = []
            for text, places in zip(b.column(0), b.column(1), strict=True):
                data = text.as_py().encode()
                ends = [0, *cuts(data, *sizes)]
                for pos in places.as_py():
                    chunk = data[ends[pos] : ends[pos + 1]]
                    full = digest(chunk)
                    rows.append((narrow(full), full, encode(chunk)))
            yield _rows([list(c) for c in zip(*rows, strict=True)] or [[], [], []], schema)

    return wanted.select("text", "places").mapInArrow(run, "digest long, full binary, ids binary")


def assembled(texts: DataFrame, tokenizer: str, sizes: tuple[int, int, int]) -> DataFrame:
    """key, ids and decoded of each text (key, text, known: its shared chunks)."""
    schema = pa.schema([("key", pa.binary()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in batches:
            ids, decoded, offsets = [], [], [0]
            for text, known in zip(b.column(1), b.column(2), strict=True):
                data = text.as_py().encode()
                have = {k["pos"]: (k["full"], k["ids"]) for k in known.as_py() or ()}
                ids.append(np.frombuffer(joined(data, parts_of(data, have, c.encode, sizes), c.encode), "<u4"))
                decoded.append(c.decode(ids[-1]))
                offsets.append(offsets[-1] + len(ids[-1]))
            values = pa.array(np.concatenate(ids).astype(np.int32)) if ids else pa.array([], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()), lists, pa.array(decoded, pa.string())], schema=schema)

    return texts.select("key", "text", "known").mapInArrow(run, "key binary, ids array<int>, decoded string")


def encode_texts(docs: DataFrame, tokenizer: str, sizes: tuple[int, int, int] = (LEAST, BITS, MOST)) -> DataFrame:
    """key (128 bits of the text), ids and decoded of each distinct text.
    tokenizer: a file that each executor has."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text_key(text).alias("key"), text.alias("text"))
    occurring = materialize(chunked(rows, sizes).groupBy("key").agg(F.first("digests").alias("digests")), "chunks")
    places = occurring.select("key", F.posexplode("digests").alias("pos", "digest"))
    met = places.groupBy("digest").agg(F.min(F.struct("key", "pos")).alias("at"), F.count(F.lit(1)).alias("n"))
    shared = met.where("n > 1").select(F.col("at.key").alias("key"), F.col("at.pos").alias("pos"))
    wanted = shared.groupBy("key").agg(F.collect_list("pos").alias("places"))
    # both uses of this table read both columns and keys that are not null, and
    # so share one exchange of the texts
    kept = rows.groupBy("key").agg(F.first("text").alias("text")).where("key IS NOT NULL")
    ids = encoded_chunks(kept.join(wanted, "key"), tokenizer, sizes)
    known = places.join(ids, "digest").groupBy("key").agg(F.collect_list(F.struct("pos", "full", "ids")).alias("known"))
    return assembled(kept.join(known, "key", "left"), tokenizer, sizes)


def text_key(text):
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def encode_decode(docs: DataFrame, tokenizer: str, sizes: tuple[int, int, int] = (LEAST, BITS, MOST)) -> DataFrame:
    """docs with key, ids and decoded for each row."""
    key, = unused(docs, "key")
    out = encode_texts(docs, tokenizer, sizes).withColumnRenamed("key", key)
    return docs.withColumn(key, text_key(F.coalesce(F.col("text").cast("string"), F.lit("")))).join(out, key)


def op11_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    out = encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda c: F.unhex(F.sha2(c, 256))  # noqa: E731  half as long on its way to the documents
    digests = out.select("key", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join("ids", " ")).alias("ids_"), sha(F.col("decoded")).alias("decoded_"))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.coalesce("text", F.lit(""))).alias("key"))
    return keys.join(digests, "key").select("doc_id", "n_tokens", F.lower(F.hex("ids_")).alias("ids_sha256"), F.lower(F.hex("decoded_")).alias("decoded_sha256"))

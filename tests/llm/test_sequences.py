"""BPE with chunk reuse, the conversation trie and fill-in-the-middle against
brute force, DuckDB and the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import bpe, middle, trie
from almanac.session import read

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, key long, n int, copies int, `first` string"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    texts = [(None, "no id here at all"), (None, "no id here at all"), (1, None), (2, ""), (3, " \t\n"), (4, "one two three four"), (4, "one two three four"), (4, "another"), (5, long), (6, long + " and more"), (7, "é" * 3000), (8, "<P>marked"), (9, "a<b>c <S <M P> x"), (10, "x <|endoftext|> y 日本語 😀 don't"), (11, "one")]
    return spark.createDataFrame([(i, t, 1, 2, 3, "f") for i, t in texts], CLASH)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


def duck(sql, table):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = c.execute(sql)
    names = [d[0] for d in want.description]
    return names, sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize(("query", "sql", "table"), [(middle.op13_fill_in_middle, middle.OP13_SQL, "documents"), (trie.op12_conversation_trie, trie.OP12_SQL, "conversations")])
def test_queries_give_duckdbs_rows(spark, query, sql, table):
    names, want = duck(sql, table)
    got = query(spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(tuple(r[c] for c in names)) for r in got.collect()) == want


# ------------------------------------------------------------- fill in middle
def filled(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_a_plain_scan(spark, odd, none):
    many = spark.createDataFrame([(i, t, 1, 2, 3, "f") for i in range(100, 160) for t in ("<<S P<M x1 y22\n\nzz é", "a" * 70 + " 1" * 64, ".")], CLASH)
    docs = odd.unionByName(many)
    out = middle.fill_in_middle(docs)
    got = out.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert all(r["back"] == r["text"] for r in got)
    key = lambda r: repr(r)
    have = sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key)
    assert have == sorted(((r["doc_id"], r["text"] or "", *filled(r["doc_id"], r["text"])) for r in docs.collect()), key=key)
    assert middle.fill_in_middle(none).count() == 0


def test_fill_in_middle_shuffles_texts_once(spark):
    df = middle.op13_fill_in_middle(spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 2 and plan.count("FileScan parquet") == 1


# ----------------------------------------------------------------- trie
def trie_rows(turns):
    """(conv_id, turn, role, text) rows to nodes, by plain dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - c % 100, [])
        path = tuple(base[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def hot(copies=150):
    """A third of all conversations begin alike, many are equal, some share
    long chains, some have no turns when rebuilt."""
    rng, rows = random.Random(5), [(None, 0, "user", "nobody's")]
    chain = [("system", "be brief")] + [("user", f"step {i}") for i in range(12)]
    for c in range(1000, 1000 + 3 * copies):
        if c % 3 == 0:
            turns = chain[: rng.choice((1, 5, 9, 13))] + [("user", f"q{rng.randrange(4)}") for _ in range(rng.randrange(4))]
        elif c % 3 == 1:
            turns = [("user", f"hello {c % 17}"), ("assistant", "x" * (c % 5)), (None, None)][: rng.randrange(1, 4)]
        else:
            turns = [("user", "same")] * 7
        rows += [(c, i or None, role, text) for i, (role, text) in enumerate(turns)]
    rows += [(77, 0, "user", "short"), (5, 3, "user", "no base")]
    return rows


def test_trie_equals_plain_dictionaries_however_it_is_dealt(spark):
    rows = hot()
    turns = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, path int, `group` string")
    want = trie_rows(rows)
    for most in (5, 60, 100_000):
        got = trie.prefix_trie(trie.rebuilt(trie.conversations(turns)), most)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want, key=lambda r: tuple(r)), most
    assert trie.prefix_trie(trie.rebuilt(trie.conversations(turns.limit(0)))).count() == 0
    alone = trie.prefix_trie(trie.rebuilt(trie.conversations(turns.where("conv_id IS NULL OR conv_id = 77")))).collect()
    assert sorted(tuple(r) for r in alone) == trie_rows([r for r in rows if r[0] == 77])


def test_trie_of_the_table_is_the_same_in_small_groups(spark):
    convs = trie.rebuilt(trie.conversations(read(spark, "/root/testdata/sf0.01", "conversations")))
    a, b = (sorted(map(repr, trie.prefix_trie(convs, most).collect())) for most in (20, 5_000))
    assert a == b


# ------------------------------------------------------------------ BPE
def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    return path, Tokenizer.from_file(path)


@pytest.mark.parametrize(("name", "sizes"), [("word_bpe_49k.json", (128, 9, 8192)), ("word_bpe_49k.json", (8, 4, 64)), ("byte_bpe_50k.json", (16, 5, 256))])
def test_bpe_equals_the_library(spark, odd, none, name, sizes):
    path, library = tokenizer(name)
    docs = odd.select("doc_id", "text", "key").unionByName(read(spark, SF, "documents").select("doc_id", "text", F.lit(1).cast("long").alias("key")))
    got = bpe.encode_decode(docs, path, sizes).collect()
    assert len(got) == docs.count()
    for r in got:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_decode(none, path).count() == 0


def test_bpe_query_gives_digests_of_every_row(spark):
    _, library = tokenizer("word_bpe_49k.json")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in read(spark, SF, "documents").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in bpe.op11_chunk_reuse_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted(want)


def test_cuts_find_a_passage_wherever_it_stands():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(2000)).encode()
    sets = []
    for before in ("", "x", "some other beginning of the text " * 9):
        data, start, found = before.encode() + passage, 0, set()
        for end in bpe.cuts(data):
            found.add(bpe.digest(data[start:end]))
            start = end
        assert start == len(data)
        sets.append(found)
    assert len(sets[0] & sets[1] & sets[2]) >= len(sets[0]) - 3
    assert bpe.cuts(b"") == [] and bpe.cuts("é".encode() * 9000)[-1] == 18_000


def test_joins_are_repaired_where_parts_were_encoded_apart():
    path, library = tokenizer("word_bpe_49k.json")
    encode = bpe.codec(path).encode
    text = "the quick brownish fox's étude <|endoftext|> jumped over 12345 unbelievable things 日本語テキスト"
    data = text.encode()
    starts = [i for i in range(len(data)) if data[i] & 0xC0 != 0x80]
    for step in (1, 2, 3, 7):
        ends = [*starts[step::step], len(data)]
        parts = [(a, b, encode(data[a:b])) for a, b in zip([0, *ends], ends, strict=False) if a < b]
        assert np.frombuffer(bpe.joined(data, parts, encode), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids

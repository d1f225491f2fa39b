"""Prefix trie of conversations: what a cache of shared beginnings would save.

A conversation is a path of turns; a turn is 128 bits of its role and text and
the length of its text, so texts never move. Equal conversations are one path
with the number and the least of their ids, counted in blocks of ids first, so
that many copies are no group of their own.

Paths are dealt by the digest of their first turn into groups of about `most`
turns, and each group builds dictionary tries inside applyInPandas, whose numbers
are summed in an iterative postorder. A first turn with more turns than that is
dealt again by the turn after those that all of its paths share, and so on, until
each group fits. The turns that are shared on the way form a segment: a chain
of nodes that Spark counts with partial sums, and whose totals come from the
groups and segments below it, from the last round back to the first. Only a single
path has to fit into a task.

Defined results: turns go by turn (null first), then role and digest; null
role or text is empty; rows without conv_id belong to no conversation and are
left out; repeated rows are turns of their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.session import forget, made, materialize, read, sized

TURN = 16  # bytes of a turn in a path
BLOCK = 1 << 16  # ids that are joined into one string at once
EMPTY = hashlib.sha256(b"").hexdigest()
NODES = "parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def short(value: Column) -> Column:
    """128 bits of a value, as binary."""
    return F.unhex(F.substring(F.sha2(value, 256), 1, 2 * TURN))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order: turn, role, digest (hex), chars."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.char_length(text).alias("chars"))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("one"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def rebuilt(convs: DataFrame, family: int = 100, most_shared: int = 6) -> DataFrame:
    """Each conversation begins with the first h turns of the first one of its
    family, if there is one, and goes on with its own after its first h;
    h is crc32 of its id modulo most_shared."""
    heads = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most_shared - 1).alias("head"))
    own = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % family, "h": (F.crc32(F.col("conv_id").cast("string")) % most_shared).cast("int")})
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    begin = F.when(F.col("head").isNull() | (F.col("h") == 0), F.slice("turns", 1, 0)).otherwise(F.slice("head", 1, F.col("h")))
    return own.join(heads, "base", "left").select("conv_id", F.concat(begin, rest).alias("turns"))


def paths(convs: DataFrame) -> DataFrame:
    """Distinct paths: path (TURN bytes a turn), chars of each turn, members n,
    the least id, and the hash of all ids."""
    path = F.unhex(F.concat_ws("", F.transform("turns", lambda t: t["digest"])))
    rows = convs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"), F.floor(F.col("conv_id") / BLOCK).alias("block"))
    blocks = rows.groupBy("path", "chars", "block").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    joined = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("block", "ids"))), lambda b: b["ids"]))
    return blocks.groupBy("path", "chars").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sha2(joined, 256).alias("ends"))


def build(pdf: pd.DataFrame) -> pd.DataFrame:
    """The tries of a group's paths below what each has shared so far (`at`
    turns, the segment `parent`): a row for each node, with `parent` only where it
    is the first below a segment or the root."""
    kids: list[dict[bytes, int]] = []
    tops: dict[bytes | None, int] = {}
    up, depth, n, least, chars, ends = ([] for _ in range(6))

    def node(above: int, level: int, size: int) -> int:
        for column, value in ((kids, {}), (up, above), (depth, level), (n, 0), (least, None), (chars, size), (ends, EMPTY)):
            column.append(value)
        return len(kids) - 1

    for parent, at, path, sizes, count, first, end in pdf[["parent", "at", "path", "chars", "n", "least", "ends"]].itertuples(index=False):
        if (here := tops.get(parent)) is None:
            here = tops[parent] = node(-1, at, 0)
        for level in range(at, len(sizes)):
            turn = path[TURN * level : TURN * level + TURN]
            if (below := kids[here].get(turn)) is None:
                below = kids[here][turn] = node(here, level + 1, int(sizes[level]))
            here = below
            n[here] += count
            least[here] = first if least[here] is None else min(least[here], first)
        ends[here] = end

    leaves, saved, rows = [0] * len(kids), [0] * len(kids), []
    for parent, top in tops.items():
        before, stack = [], [top]
        while stack:
            before.append(here := stack.pop())
            stack += kids[here].values()
        for here in reversed(before[1:]):  # every node after all below it
            leaves[here] += not kids[here]
            saved[here] += (n[here] - 1) * chars[here]
            leaves[up[here]] += leaves[here]
            saved[up[here]] += saved[here]
            first_below = up[here] == top
            rows.append((parent if first_below else None, least[here], depth[here], None if first_below else least[up[here]], n[here], len(kids[here]), leaves[here], saved[here], ends[here]))
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])
    return out.astype({"parent_conv_id": "Int64"})


def shared_turns(low: Column, high: Column) -> Column:
    """How many whole turns two paths begin with alike."""
    some = F.least(F.length(low), F.length(high)) / TURN
    same = F.transform(F.sequence(F.lit(1), some.cast("int")), lambda i: F.substring(low, (i - 1) * TURN + 1, F.lit(TURN)) == F.substring(high, (i - 1) * TURN + 1, F.lit(TURN)))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, some).cast("int")


def segments(active: DataFrame, most: int) -> DataFrame:
    """Of paths (`at`: turns consumed so far), the groups by next turn that hold
    more than `most` turns in several paths: what their paths share from there."""
    sums = active.groupBy("group", "parent", "at").agg(
        F.sum(F.size("chars") - F.col("at")).alias("turns"), F.count(F.lit(1)).alias("paths"), F.sum("n").alias("n"), F.min("least").alias("least"),
        F.min(F.struct("path", "chars", "ends")).alias("low"), F.max("path").alias("high"),
    )
    big = sums.where((F.col("turns") > most) & (F.col("paths") > 1)).withColumn("to", shared_turns(F.col("low.path"), F.col("high")))
    # a path that ends where the segment does sorts before all others of it
    ends = F.when(F.size("low.chars") == F.col("to"), F.col("low.ends")).otherwise(EMPTY)
    return big.select("group", "parent", "at", "to", "n", "least", F.slice("low.chars", 1, F.col("to")).alias("chars"), ends.alias("ends"))


def grouped(df: DataFrame) -> DataFrame:
    return df.withColumn("group", short(F.substring(F.col("path"), F.lit(1), (F.col("at") + 1) * TURN)))


def prefix_trie(convs: DataFrame, most: int = 5_000) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turns). A group holds
    about `most` turns, at most as many again for each first turn dealt to it."""
    spark, since = convs.sparkSession, made()
    every = materialize(paths(convs), "paths")
    root = every.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max(F.when(F.size("chars") == 0, F.col("ends"))).alias("ends")).first()
    if root["n"] is None:
        return spark.createDataFrame([], NODES).select(*RESULT)

    active = grouped(every.where(F.size("chars") > 0).withColumns({"at": F.lit(0), "parent": F.lit(None).cast("binary")}))
    rest, rounds = [], []
    while True:
        found = materialize(segments(active, most), "segments")
        if found.isEmpty():
            rest.append(active)
            break
        rounds.append(found)
        tagged = active.join(sized(found.select("group", "to")), "group", "left")
        rest.append(tagged.where("to IS NULL").drop("to"))
        deeper = tagged.where(F.size("chars") > F.col("to")).select("path", "chars", "n", "least", "ends", F.col("to").alias("at"), F.col("group").alias("parent"))
        active = grouped(materialize(deeper, "deeper"))
    small = reduce(DataFrame.unionByName, rest)
    total = small.agg(F.sum(F.size("chars") - F.col("at"))).first()[0] or 0
    buckets = small.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(max(1, -(-total // most)))))
    nodes = materialize(buckets.groupBy("bucket").applyInPandas(build, NODES), "nodes")

    columns = ["parent", "n_leaves", "saved_tokens"]
    reports = nodes.where("parent_conv_id IS NULL").select(*columns)
    chains = []
    for found in reversed(rounds):
        below = reports.groupBy(F.col("parent").alias("group")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"), F.count(F.lit(1)).alias("below_n"))
        own = F.transform(F.slice("chars", F.col("at") + 1, F.col("to") - F.col("at")), lambda c: (F.col("n") - 1) * c)
        done = materialize(found.join(sized(below), "group").withColumn("own", own), "chains")
        chains.append(done)
        reports = reports.unionByName(done.select("parent", "n_leaves", (F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x) + F.col("below")).alias("saved_tokens")))
    top = reports.where("parent IS NULL").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")).first()

    parts = [nodes]
    for done in chains:
        rows = done.select("*", F.posexplode("own").alias("i", "_"))
        deep = F.col("at") + F.col("i") + 1
        saved = F.aggregate(F.slice("own", F.col("i") + 1, F.size("own")), F.col("below"), lambda a, x: a + x)
        last = deep == F.col("to")
        parts.append(rows.select(F.when(F.col("i") == 0, F.col("parent")).alias("parent"), F.col("least").alias("conv_id"), deep.cast("long").alias("depth"), F.when(F.col("i") > 0, F.col("least")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, F.col("below_n")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(EMPTY).alias("ends_sha256")))
    table = reduce(DataFrame.unionByName, parts)
    if rounds:
        above = reduce(DataFrame.unionByName, [r.select(F.col("group").alias("parent"), F.col("least").alias("above")) for r in rounds])
        table = table.join(sized(above), "parent", "left")
    else:
        table = table.withColumn("above", F.lit(None).cast("long"))
    table = table.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above", F.lit(root["least"]))).select(*RESULT)
    first = (root["least"], 0, None, root["n"], top["n_children"], top["n_leaves"] or 1, top["saved_tokens"] or 0, root["ends"] or EMPTY)
    out = materialize(table.unionByName(spark.createDataFrame([first], ", ".join(NODES.split(", ")[1:]))), "trie")
    forget(spark, since, made() - 1)
    return out


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(conversations(read(spark, sf_dir, "conversations"))))


OP12_SQL = r"""
WITH ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda k: k)),
             lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 6 AS h
  FROM ordered),
rebuilt AS (
  SELECT h.conv_id, o.i, o.role, o.text FROM hashed h JOIN ordered o ON o.conv_id = h.base AND o.i <= h.h
  UNION ALL
  SELECT h.conv_id, o.i, o.role, o.text FROM hashed h JOIN ordered o ON o.conv_id = h.conv_id AND o.i > h.h),
numbered AS (
  SELECT conv_id, text, md5(length(role) || ':' || role || text) AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth FROM rebuilt),
path AS (
  SELECT conv_id, depth, length(text) AS chars, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM numbered
  UNION ALL SELECT conv_id, 0, 0, '' FROM hashed),
ended AS (SELECT conv_id, max(depth) AS depth FROM path GROUP BY conv_id),
node AS (
  SELECT p.prefix, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(p.chars) AS chars,
         sha256(coalesce(string_agg(CASE WHEN e.depth = p.depth THEN p.conv_id::VARCHAR END, ',' ORDER BY p.conv_id), '')) AS ends_sha256
  FROM path p JOIN ended e ON e.conv_id = p.conv_id GROUP BY p.prefix, p.depth),
linked AS (
  SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM node k WHERE k.depth = n.depth + 1 AND k.prefix[1:32 * n.depth] = n.prefix) AS n_children
  FROM node n LEFT JOIN node u ON u.depth = n.depth - 1 AND u.prefix = n.prefix[1:32 * (n.depth - 1)]),
below AS (
  SELECT n.prefix[1:32 * a.d] AS prefix, sum((n.n_children = 0)::BIGINT) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM linked n, LATERAL (SELECT unnest(range(n.depth + 1)) AS d) a GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, n.parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
       b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM linked n JOIN below b ON b.prefix = n.prefix
"""

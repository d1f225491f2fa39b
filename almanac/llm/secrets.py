"""Secret scans: base patterns, and weak parts that complete each other.

Base kinds are found by themselves: assign (a named value), access (an access
identifier) and hex (a long hexadecimal run). Weak candidates are an endpoint
(a URL or host:port), an identifier (user, client or key id with a value) and
an opaque value (20 or more characters of a mixed alphabet). Alone they say
nothing; they are reported only where complementary parts co-occur within
`scope` characters in one text:

* an endpoint, where a secret is in scope;
* an identifier, where a secret or an opaque value is in scope;
* an opaque value, where an identifier and an endpoint are both in scope, or
  an access span is.

The interval join runs on buckets of `scope` characters: of each kind a bucket
keeps its first start and last end, which tell whether any part of that kind
is in reach of a candidate in this bucket or the next ones. So a hot document
costs as many rows as it has parts, and no pairs are emitted. All of it is
DataFrame functions.

Positions are code points from 0, ends exclusive. Matches of a kind are
leftmost and do not overlap; those too short are dropped after matching.

Defined results: null text counts as empty and has no spans; a null doc_id is
kept as such; rows are told apart by doc_id and text, equal rows each get the
same result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.session import materialize, read, sized, unused

#: The base patterns, the group that is measured, its least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "endpoint": (r"(?i)\b(?:https?|ssh|s3|postgres|mysql|amqp|redis|mongodb)://[A-Za-z0-9._~:@/?&=%+-]+", 0, 10),
    "ident": (r"""(?i)\b(?:user(?:name)?|login|client_?id|account_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)""", 1, 3),
    "opaque": (r"[A-Za-z0-9+/_]{20,}", 0, 20),
}
#: What a match must have besides; of each of these one character.
MIXED = {"opaque": ("[0-9]", "[A-Z]", "[a-z]")}
ORDER = [*BASE, *WEAK]
SPAN = "array<struct<start:int,end:int,rank:int>>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def matches(text: Column, kind: str, chunk: int = 256) -> Column:
    """Spans of one kind: gaps and matches alternate, so a match starts after
    all gaps up to it and all matches before it. Each pattern reads a text once
    and never looks ahead; where it is met, once more for the gaps. Positions
    are summed in chunks, so that work grows with the number of matches."""
    pattern, group, least = (BASE | WEAK)[kind]
    none = F.array().cast(SPAN)

    def enough(m: Column) -> Column:
        met = F.char_length(F.regexp_extract(m, pattern, group) if group else m) >= least
        for p in MIXED.get(kind, ()):
            met = met & m.rlike(p)
        return met

    def part(gap: Column, m: Column) -> Column:
        size = F.char_length(m)
        return F.struct((F.char_length(gap) + size).alias("step"), size.alias("size"), enough(m).alias("kept"))

    def spans(chunk_: Column, base: Column) -> Column:
        """The spans of a chunk that starts at base."""
        zero = F.struct(base.alias("at"), none.alias("spans"))

        def step(state: Column, x: Column) -> Column:
            end = state["at"] + x["step"]
            span = F.array(F.struct((end - x["size"]).alias("start"), end.alias("end"), F.lit(ORDER.index(kind)).alias("rank")))
            return F.struct(end.alias("at"), F.when(x["kept"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

        return F.aggregate(chunk_, zero, step, lambda s: s["spans"])

    def chunked(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / chunk).cast("int")), lambda c: F.slice(parts, c * chunk + 1, F.lit(chunk)))

    def placed(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["step"]))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        first = F.aggregate(totals, zero, lambda s, t: F.struct((s["at"] + t).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
        return F.flatten(F.zip_with(chunks, first, spans))

    def all_of(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        return F.when(F.size(found) > 0, let(F.zip_with(gaps, found, part), lambda p: let(chunked(p), placed))).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), all_of)


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """(doc_id, print, base, added) for each row: spans in order; print tells the
    texts of a repeated doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = rows.select(
        "doc_id",
        F.xxhash64("text").alias("print"),
        *[matches(F.col("text"), k).alias(k) for k in ORDER],
    )
    # by row, so that equal rows stay apart until they are joined again
    found = materialize(found.select("doc_id", "print", F.array_sort(F.concat(*BASE)).alias("base"), F.array_sort(F.concat(*WEAK)).alias("weak")), "parts")
    keyed = found.where(F.size("weak") > 0).select(F.coalesce("doc_id", F.lit(-1)).alias("doc"), "print", F.concat("base", "weak").alias("parts")).dropDuplicates(["doc", "print"])
    parts = keyed.select("doc", "print", F.explode("parts").alias("p")).select("doc", "print", "p.*")
    secret = F.col("rank").isin(ORDER.index("assign"), ORDER.index("hex"))
    kinds = {"secret": secret, "access": F.col("rank") == ORDER.index("access"), **{k: F.col("rank") == ORDER.index(k) for k in WEAK}}
    # a part counts in each bucket that it touches
    placed = parts.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))))
    edges = placed.groupBy("doc", "print", "bucket").agg(*[f(F.when(c, F.col(v))).alias(f"{k}_{v}") for k, c in kinds.items() for f, v in ((F.min, "start"), (F.max, "end"))])
    asked = parts.where(F.col("rank") >= len(BASE)).withColumn("near", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))))
    met = asked.join(edges.withColumnRenamed("bucket", "near"), ["doc", "print", "near"])

    def reached(k: str) -> Column:
        """An edge part of kind k lies within scope, before or after."""
        lo, hi = F.col(f"{k}_start"), F.col(f"{k}_end")
        return F.coalesce((lo <= F.col("end") + scope) & (hi >= F.col("start") - scope), F.lit(False))

    seen = met.groupBy("doc", "print", "start", "end", "rank").agg(*[F.max(reached(k)).alias(k) for k in kinds])
    rank = F.col("rank")
    linked = seen.where(
        ((rank == ORDER.index("endpoint")) & F.col("secret"))
        | ((rank == ORDER.index("ident")) & (F.col("secret") | F.col("opaque")))
        | ((rank == ORDER.index("opaque")) & ((F.col("ident") & F.col("endpoint")) | F.col("access")))
    )
    added = linked.groupBy("doc", "print").agg(F.array_sort(F.collect_list(F.struct("start", "end", "rank"))).alias("added"))
    keyed_rows = found.withColumn("doc", F.coalesce("doc_id", F.lit(-1)))
    return keyed_rows.join(added, ["doc", "print"], "left").select("doc_id", "print", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"))


def ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))


def listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(ordered(spans), lambda s: F.concat_ws(":", F.element_at(name, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == ORDER.index(kind))).cast("long")


def masked(docs: DataFrame, scope: int = 200, mark: str = "[secret]", piece: int = 4096) -> DataFrame:
    """docs with each base span and each linked opaque value replaced by
    `mark`; overlapping spans are one. All columns and rows are kept; a null
    text stays null. Texts are rewritten in pieces of `piece` characters, each
    with the spans that reach into it."""
    found = scan(docs, scope)
    opaque = F.filter("added", lambda s: s["rank"] == ORDER.index("opaque"))
    doc, print_, spans = unused(docs, "doc", "print", "hits")
    hits = found.withColumn("hits", ordered(F.concat("base", opaque))).where(F.size("hits") > 0)
    hits = materialize(hits.select(F.coalesce("doc_id", F.lit(-1)).alias(doc), F.col("print").alias(print_), F.col("hits").alias(spans)).dropDuplicates([doc, print_]), "hits")
    keyed = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn(print_, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))

    def rewritten(part: Column, low: Column) -> Column:
        """A piece that starts at low. A span that began before it has its mark
        there; one that begins inside another has none."""
        size = F.char_length(part)
        near = F.filter(spans, lambda s: (s["end"] > low) & (s["start"] < low + size))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(state: Column, s: Column) -> Column:
            start, end = s["start"] - low, F.least(s["end"] - low, size)
            fresh = start >= state["at"]
            told = F.array(F.substring(part, state["at"] + 1, start - state["at"]), F.lit(mark))
            return F.struct(F.greatest(state["at"], end).alias("at"), F.when(fresh, F.concat(state["out"], told)).otherwise(state["out"]).alias("out"))

        return F.aggregate(near, zero, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(part, s["at"] + 1, size)))

    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(F.transform(parts, lambda p, i: rewritten(p, i * piece)), ""))
    return keyed.join(sized(hits), [doc, print_], "left").withColumn("text", text).select(*docs.columns)


def op8_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[count(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
    )

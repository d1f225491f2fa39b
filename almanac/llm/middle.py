"""Fill-in-the-middle transformation, as joins over units of text.

A unit is a run of ASCII letters or any other code point. Two cuts, told by a
hash of the document's id, split its units into prefix, middle and suffix, which
are put together anew behind marks (`Form`). Nothing walks over a text:

1. Each text is exploded into pieces of `PIECE` units; a running sum of their
   lengths says where each begins.
2. A cut is a request for the last unit before it; requests meet pieces by
   ordinal. Only pieces that are asked for are exploded into units, and a running
   sum of unit lengths up to the requested ordinal says where the cut is.
3. The two offsets of a document meet its text, and substrings are put together.

So a text takes one row for each 64 units, and one for each unit near its two
cuts. Texts are shuffled once; all other steps follow that partitioning.

Defined results: null text is empty and stays plain; a null doc_id counts as the
empty string in the hash; repeated rows (equal id and text) are worked out
once and returned as often as they occur; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.session import read

UNIT = "[A-Za-z]+|[^A-Za-z]"
PIECE = 64


@dataclass(frozen=True)
class Form:
    """Marks, the hash's seed, and how many of 100 documents stay plain or,
    of those cut, begin with the suffix."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "1"
    plain: int = 10
    suffix_first: int = 20

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def name(self, text: Column, third: Column, fourth: Column) -> Column:
        marked = F.lit(False)
        for m in self.marks:
            marked |= F.contains(text, F.lit(m))
        plain = (text == "") | marked | (third % 100 >= 100 - self.plain)
        return F.when(plain, "plain").when(fourth % 100 < self.suffix_first, "spm").otherwise("psm")


def numbers(doc_id: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers of a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def split(text: Column, most: int) -> Column:
    """The text as pieces of `most` units each, the last one perhaps shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?:[A-Za-z]++|[^A-Za-z]){{1,{most}}}+"), F.lit(0))


def requests(docs: DataFrame, form: Form) -> DataFrame:
    """docs (doc_id, text) with n units, the form, and after how many units the
    prefix (first) and the middle (second) end."""
    h1, h2, h3, h4 = numbers(F.col("doc_id"), form.seed)
    pieces = split(F.col("text"), PIECE)
    n = F.when(F.col("text") == "", F.lit(0)).otherwise(PIECE * (F.size(pieces) - 1) + F.regexp_count(F.element_at(pieces, -1), F.lit(UNIT)))
    cut = docs.withColumn("n", n.cast("long"))
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    return cut.withColumns({"form": form.name(F.col("text"), h3, h4), "first": F.least(a, b), "second": F.greatest(a, b)})


def offsets(asked: DataFrame) -> DataFrame:
    """key, prefix_end and middle_end in code points, of documents with a
    request after their first unit. asked: key, text, first, second."""
    pieces = asked.select("key", F.posexplode(split(F.col("text"), PIECE)).alias("pos", "piece"))
    before = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("base", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)))

    cuts = asked.select("key", "first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("units")).where("units > 0")
    cuts = cuts.withColumnsRenamed({"key": "of"}).withColumn("last", ((F.col("units") - 1) % PIECE).cast("int"))

    # an interval and no second key: both sides stay where the texts lie
    start = F.col("pos").cast("long") * PIECE
    held = pieces.join(cuts, (F.col("key") == F.col("of")) & (start < F.col("units")) & (F.col("units") <= start + PIECE))
    units = held.select("key", "first", "second", "units", "base", "last", F.posexplode(split(F.col("piece"), 1)).alias("ordinal", "unit")).where("ordinal <= last")
    upto = Window.partitionBy("key", "units").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    ends = units.withColumn("end", F.col("base") + F.sum(F.char_length("unit")).over(upto)).where("ordinal = last")
    return ends.groupBy("key").agg(F.max(F.when(F.col("units") == F.col("first"), F.col("end"))).alias("prefix_end"), F.max(F.when(F.col("units") == F.col("second"), F.col("end"))).alias("middle_end"))


def fill_in_middle(docs: DataFrame, form: Form = Form()) -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars, output for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text")), 256))
    # every branch below reads all columns of this table and keys that are not
    # null, so that they share one exchange of the texts
    kept = rows.groupBy(key.alias("key")).agg(F.first(F.struct("doc_id", "text")).alias("row"), F.count(F.lit(1)).alias("copies")).where("copies > 0 AND key IS NOT NULL")
    asked = requests(kept.select("key", "copies", "row.doc_id", "row.text"), form)
    found = asked.join(offsets(asked.where("form <> 'plain'")), "key", "left")

    text, a, b = F.col("text"), F.coalesce(F.col("prefix_end"), F.lit(0)), F.coalesce(F.col("middle_end"), F.lit(0))
    first, middle, last = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, F.char_length(text))
    p, s, m = map(F.lit, form.marks)
    plain = F.col("form") == "plain"
    output = F.when(plain, text).when(F.col("form") == "psm", F.concat(p, first, s, last, m, middle)).otherwise(F.concat(s, last, p, first, m, middle))
    out = found.select("doc_id", "text", "n", "form", F.when(~plain, a).alias("prefix_chars"), F.when(~plain, b - a).alias("middle_chars"), output.alias("output"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")


def restored(output: Column, form_name: Column, form: Form = Form()) -> Column:
    """The text that an output of a form was made of. A text that was cut holds
    none of the marks, so their first places are those that were put there."""
    p, s, m = form.marks

    def between(a: str, b: str) -> Column:
        return F.substring_index(F.substring(output, F.lit(len(a) + 1), F.char_length(output)), b, 1)

    def after(mark: str) -> Column:
        return F.substring(output, F.locate(mark, output) + len(mark), F.char_length(output))

    def inner(a: str, b: str) -> Column:
        return F.substring_index(after(a), b, 1)

    psm = F.concat(between(p, s), after(m), inner(s, m))
    spm = F.concat(inner(p, m), after(m), between(s, p))
    return F.when(form_name == "plain", output).when(form_name == "psm", psm).otherwise(spm)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", F.col("prefix_chars").cast("long").alias("prefix_chars"), F.col("middle_chars").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
hashed AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM units),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output
  FROM parts)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
              WHEN 'psm' THEN split_part(output[4:], '<S>', 1) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1)
              ELSE split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || split_part(output[4:], '<P>', 1) END) AS restored_sha256
FROM made
"""

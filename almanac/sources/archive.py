"""Archives of events whose JSON has drifted over the years.

A text is an array of events, an object with them under `events`, or an object
of events by id. Nothing is inferred over all files: each item is a VARIANT, fields
are read out of it with a type each, and what does not fit is put aside with the
reason, so that one odd item costs neither its file nor its column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is read of an item: column, type, the names that it has had.
FIELDS = {
    "titulo": ("string", ("titulo", "title")), "day": ("date", ("day", "fecha")), "municipio": ("string", ("municipio",)), "hora": ("string", ("hora",)),
    "lugar": ("string", ("lugar",)), "orquestas": ("array<string>", ("orquestas",)), "score": ("int", ("score",)),
}
NEEDED = ("day", "municipio")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(archivo, value) of the files at path, each read whole as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("archivo"), "value")


def items(texts: DataFrame) -> DataFrame:
    """(archivo, pos, clave, item) of each item of texts (archivo, value): where
    in its text it stood from 0, under which key (null in an array), and the item as
    VARIANT. A text that is no JSON or holds no collection is one row with null
    pos and itself as item; an empty or null one is no JSON."""
    parsed = texts.select("archivo", "value", F.expr("try_parse_json(value)").alias("v"))
    inner = F.expr("coalesce(try_variant_get(v, '$.events', 'variant'), v)")
    kind = F.expr("coalesce(schema_of_variant(v), '')")
    held = parsed.withColumn("v", inner).withColumn("_many", kind.startswith("ARRAY") | kind.startswith("OBJECT"))
    exploded = texts.sparkSession.sql("SELECT archivo, e.pos AS pos, e.key AS clave, e.value AS item FROM {held}, LATERAL variant_explode(v) e", held=held.where("_many").select("archivo", "v"))
    odd = held.where("NOT _many").select("archivo", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("clave"), F.expr("to_variant_object(named_struct('texto', value))").alias("item"))
    return exploded.unionByName(odd)


def _read(names: tuple[str, ...], kind: str) -> Column:
    """The first of these fields that has the type."""
    return F.coalesce(*[F.expr(f"try_variant_get(item, '$.{n}', '{kind}')") for n in names])


def _there(names: tuple[str, ...]) -> Column:
    """Whether one of these fields is told at all, JSON's null aside."""
    raw = [F.expr(f"try_variant_get(item, '$.{n}', 'variant')") for n in names]
    return F.coalesce(*[F.when(r.isNotNull() & ~F.is_variant_null(r), True) for r in raw], F.lit(False))


def typed(found: DataFrame, fields: dict = FIELDS, needed: tuple[str, ...] = NEEDED) -> DataFrame:
    """items with the fields read, motivo and item: motivo is null, "no json" (the
    file), "no object", "no <field>" (a needed one is lacking) or "bad <field>" (one
    that is told has another type), the first of these; item keeps all that the
    fields do not name."""
    is_object = F.expr("schema_of_variant(item)").startswith("OBJECT")
    bad = [F.when(_there(names) & _read(names, kind).isNull(), f"bad {c}") for c, (kind, names) in fields.items()]
    lacks = [F.when(~_there(fields[c][1]), f"no {c}") for c in needed]
    why = F.coalesce(F.when(F.col("pos").isNull(), "no json"), F.when(~F.coalesce(is_object, F.lit(False)), "no object"), *lacks, *bad)
    return found.select("archivo", "pos", "clave", *[_read(names, kind).alias(c) for c, (kind, names) in fields.items()], why.alias("motivo"), "item")


def events(texts: DataFrame) -> DataFrame:
    """The items of texts that fit, with id: their key, else the file and position."""
    rows = typed(items(texts)).where("motivo IS NULL").drop("motivo")
    return rows.select(F.coalesce("clave", F.concat_ws("#", "archivo", F.col("pos").cast("string"))).alias("id"), "*")


def aside(texts: DataFrame) -> DataFrame:
    """(archivo, motivo, n): how many items of each text were put aside, and why."""
    return typed(items(texts)).where("motivo IS NOT NULL").groupBy("archivo", "motivo").agg(F.count("*").alias("n"))


def calendar(rows: DataFrame, share: float = 0.15, least: int = 2) -> DataFrame:
    """(municipio, total, mes, n, caliente): events of each place by month; a month
    is hot that holds this share of the place's events, and so many at least.
    Counted by place and month first, so a large place is twelve rows."""
    n = rows.groupBy(F.trim("municipio").alias("municipio"), F.date_format("day", "MM").alias("mes")).agg(F.count("*").alias("n")).where("municipio <> ''")
    total = n.groupBy("municipio").agg(F.sum("n").alias("total"))
    return n.join(total, "municipio").select("municipio", "total", "mes", "n", (F.col("n") >= F.greatest(F.lit(float(least)), F.col("total") * share)).alias("caliente"))

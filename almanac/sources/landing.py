"""Landed files as tables: crawled posts, CMS and calendar JSON, sitemaps, OCR
texts, images. Fetching is somebody else's work; Spark reads what has landed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions import text as T
from almanac.operators.social import is_image, post_age

POSTS = "cuenta string, url string, revisadoEl string, posts array<struct<texto:string,comentarios:array<string>,url:string,imagenes:array<string>,pdfs:array<string>,esReel:boolean,fecha:string,ocrTexto:string,ocrAt:string>>"
CMS = "array<struct<date:string,link:string,featured_media:bigint,title:struct<rendered:string>,content:struct<rendered:string>>>"
MEDIA = "array<struct<id:bigint,date:string,source_url:string,mime_type:string>>"
CALENDAR = "struct<events:array<struct<id:string,title:string,url:string,start_date:string,end_date:string,venue:struct<venue:string,address:string>,description:string>>>"
OCR = "url string, at long, paginas int, parcial boolean, texto string"


@dataclass(frozen=True)
class SourceSpec:
    """A registered source: where its files land, how they become event rows,
    and where it comes in the order of merging."""

    name: str
    path: str
    parse: object
    rank: int = 0
    options: dict = field(default_factory=dict)


def union(spark: SparkSession, specs: list[SourceSpec], only: str | None = None, failed: dict[str, str] | None = None) -> DataFrame:
    """All sources' rows with their name and rank; `only` prunes to one, and
    the others are not read. With `failed`, a source that cannot be opened is
    noted there by its name, and the others go on."""
    chosen = [s for s in specs if only is None or s.name.lower() == only.lower()]
    if not chosen:
        raise ValueError(f"no source is named {only!r}")
    out = None
    for s in chosen:
        try:
            rows = s.parse(spark, s.path, **s.options).withColumn("fuente", F.lit(s.name)).withColumn("rango", F.lit(s.rank))
        except AnalysisException as e:
            if failed is None:
                raise
            failed[s.name] = str(e).splitlines()[0]
            continue
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no source could be opened: {failed}")
    return out


def posts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each crawled post; files that are no JSON are skipped."""
    files = spark.read.schema(POSTS).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    p = files.select("cuenta", F.col("url").alias("pagina"), F.to_date("revisadoEl").alias("revisado"), F.explode("posts").alias("p")).select("cuenta", "pagina", "revisado", "p.*")
    return p.where(F.char_length("texto") > 0).withColumn("dias", post_age(F.col("fecha"), F.col("revisado")))


def cms_posts(spark: SparkSession, path: str, year: int) -> DataFrame:
    """(day, titulo, url, texto) of a CMS's posts of one year."""
    found = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", CMS)).alias("p"))
    rows = found.select(F.to_date(F.substring("p.date", 1, 10)).alias("fecha"), T.html_lines(F.col("p.title.rendered")).alias("titulo"), F.col("p.link").alias("url"), T.html_lines(F.col("p.content.rendered")).alias("texto"), F.col("p.featured_media").alias("medio"))
    return rows.where(F.year("fecha") == year)


def cms_media(spark: SparkSession, path: str, year: int, keyword: str = "programa", most: int = 5) -> DataFrame:
    """PDF attachments of one year whose address has the keyword, newest first."""
    found = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", MEDIA)).alias("m")).select("m.*")
    mine = found.where((F.col("mime_type") == "application/pdf") & F.col("date").startswith(str(year)) & F.contains(T.fold(F.col("source_url")), F.lit(keyword)))
    return mine.orderBy(F.desc("date"), "id").limit(most)


def calendar(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Events of a calendar's REST answer that start between two days."""
    found = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", CALENDAR)["events"]).alias("e"))
    at = F.try_to_timestamp(F.col("e.start_date"))
    rows = found.select(F.col("e.id").alias("id"), T.html_lines(F.col("e.title")).alias("titulo"), F.date_format(at, "dd-MM-yyyy").alias("day"), F.date_format(at, "HH:mm").alias("hora"), F.coalesce("e.venue.venue", F.lit("")).alias("lugar"), F.col("e.url").alias("url"), F.to_date(at).alias("fecha"))
    return rows.where(F.col("fecha").between(first, last)).drop("fecha")


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(url, titulo) of each address; the title is read off its last part."""
    urls = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url")).distinct()
    return urls.select("url", F.initcap(F.replace(F.regexp_extract("url", "([^/]+)/?$", 1), F.lit("-"), F.lit(" "))).alias("titulo"))


def with_ocr(documents: DataFrame, texts: DataFrame, least: int = 200) -> DataFrame:
    """Adds the OCR text of each row's url, where it is long enough."""
    known = texts.where(F.char_length("texto") >= least).select(F.sha1("url").alias("_k"), F.col("texto").alias("ocr"))
    return documents.withColumn("_k", F.sha1("url")).join(known, "_k", "left").drop("_k")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Files that are images by their first bytes."""
    return spark.read.format("binaryFile").load(path).where(is_image(F.col("content")))


def program_links(pages: DataFrame, year: int, most: int = 5) -> DataFrame:
    """(url, href) of PDF links of the year with a programme's words."""
    from pyspark.sql import Window

    href = F.col("href")
    found = pages.select("url", F.explode(T.links(F.col("html"))).alias("href")).distinct()
    named: Column = T.fold(href).rlike("programa|fiestas|cartel|agenda") & F.contains(href, F.lit(str(year))) & F.lower(href).rlike(r"\.pdf(\?|$)")
    return found.where(named).withColumn("r", F.row_number().over(Window.partitionBy("url").orderBy("href"))).where(F.col("r") <= most).drop("r")

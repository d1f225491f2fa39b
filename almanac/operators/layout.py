"""Mending of texts before they are cut into sections: article bodies, venue
bullets, weekdays misread on posters, hours told apart from their act, columns
read across, and the years, months and page numbers that addresses tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.functions import text as T
from almanac.operators import dictionary as N
from almanac.operators import spelling as S

#: Weekdays as written, where an article ends, months by what a
#: slug hints at (tried in this order), words that follow a name but name none.
WRITTEN = "lunes martes miércoles jueves viernes sábado domingo".split()
BODY_CLASS = "post-title"
BODY_ENDS = ["compartir", "share-post", "post-navigation", "related", "relacionad"]
SLUGS = [("navidad", 12), ("carnaval", 2), ("habaneras", 7), ("carmen", 7), *((m, i + 1) for i, m in enumerate(D.MONTHS))]
NO_NAME = "fuego fuegos procesion misa festival feria gala romeria verbena baile plaza parque recinto iglesia ermita banda musica".split()
PAGE_WORDS = ["page", "pag", "p"]
BULLET = r"•\s*([^.\n•]{3,80}?)\s*\."


def article_body(html: Column) -> Column:
    """Lines of an article from its heading to the sharing links below it, where
    these end it; without a heading from the start. The page is taken as pieces
    that begin with a tag each."""
    heading = lambda b: F.lower(b).startswith("<h1") & F.contains(F.regexp_extract(F.lower(b), r'^<h1[^>]*class="([^"]*)"', 1), F.lit(BODY_CLASS))

    def ending(b: Column) -> Column:
        """Where the first ending word begins in a piece, from 1; 0 without."""
        found = lambda low: F.coalesce(F.array_min(F.array(*[F.nullif(F.instr(low, F.lit(w)), F.lit(0)) for w in BODY_ENDS])), F.lit(0))
        return T.let(F.lower(b), found)

    def from_heading(blocks: Column) -> Column:
        first = T.let(F.array_position(F.transform(blocks, heading), F.lit(True)), lambda i: F.greatest(F.coalesce(i, F.lit(0)), F.lit(1)))
        return F.slice(blocks, first.cast("int"), F.size(blocks))

    def body(rest: Column) -> Column:
        # the first piece with an ending word: its place among all, and the word's in it
        ends = F.filter(F.transform(rest, lambda b, i: F.struct((i + 1).alias("piece"), ending(b).alias("at"))), lambda e: e["at"] > 0)
        return T.let(F.try_element_at(ends, F.lit(1)), lambda end: F.when(end.isNull() | ((end["piece"] == 1) & (end["at"] == 1)), F.array_join(rest, "")).otherwise(
            # of the piece that ends it, what stands before the word, if it is text
            F.concat(F.array_join(F.slice(rest, 1, F.coalesce(end["piece"], F.lit(1)) - 1), ""), F.regexp_replace(F.substring(F.element_at(rest, F.coalesce(end["piece"], F.lit(1))), F.lit(1), end["at"] - 1), "<[^>]*$", ""))
        ))

    return F.when(html.isNotNull(), T.html_lines(T.let(T.let(F.split(html, "(?=<)", -1), from_heading), body)))


def by_place(sections: DataFrame, text: str = "texto") -> DataFrame:
    """One row for each venue bullet ("• Plaza Mayor. ...") of a section, with
    parte (from 0) and lugar; a section without bullets is one row, lugar ''."""
    parts = F.filter(F.split(text, f"(?={BULLET})"), lambda p: p.rlike(f"^{BULLET}"))
    told = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, BULLET, 1).alias("lugar"), p.alias("texto")))
    whole = F.array(F.struct(F.lit("").alias("lugar"), F.coalesce(F.col(text), F.lit("")).alias("texto")))
    rows = sections.select("*", F.posexplode(F.when(F.size(told) > 0, told).otherwise(whole)).alias("parte", "_p"))
    return rows.select(*[c for c in sections.columns if c != text], "parte", F.col("_p.lugar").alias("lugar"), F.col("_p.texto").alias(text))


def mended_weekdays(text: Column) -> Column:
    """Words before a day's number that are one edit from a weekday, and begin
    like it, as that weekday, with a capital if the word has one; for transcribed
    posters alone. Each such word's forms are looked up in those of the weekdays."""
    word = r"(?<![\p{L}\d])\p{L}{5,10}(?=\s+\d{1,2}\b(?!\s*[:.]\d))"
    plain = F.transform(F.regexp_extract_all(text, F.lit(word), F.lit(0)), lambda w: F.struct(w.alias("w"), T.fold(w).alias("f")))
    written = F.create_map(*[F.lit(x) for pair in zip(D.WEEKDAYS, WRITTEN, strict=True) for x in pair])

    def mended(x: Column) -> Column:
        day = F.try_element_at(written, S.corrected(x["f"], D.WEEKDAYS, 3))
        capital = F.substring(x["w"], 1, 1) == F.upper(F.substring(x["w"], 1, 1))
        right = F.array_contains(F.array(*map(F.lit, D.WEEKDAYS)), x["f"])
        return F.when(day.isNull() | right, x["w"]).when(capital, F.initcap(day)).otherwise(day)

    return F.array_join(F.zip_with(F.split(text, word, -1), F.transform(plain, mended), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def hour_with_act(text: Column) -> Column:
    """A line "21:00 h – Plaza" above an act as one line with it, "21:00 - act
    (Plaza)", looked at line by line; a line that begins with a weekday, or with
    neither a capital, a number nor a quote, is no act."""
    lines = F.split(text, "\n", -1)
    days = F.array(*map(F.lit, [*WRITTEN, *D.WEEKDAYS]))
    told = lambda i: F.try_element_at(lines, i)
    half = lambda i, k: F.coalesce(F.try_element_at(F.split(told(i), r"\s*[–-]\s*", 2), F.lit(k)), F.lit(""))
    timed = lambda i: half(i, 1).rlike(r"^\d{1,2}:\d{2}\s*h(?:oras?)?\.?$")
    above = lambda i: timed(i) & F.char_length(half(i, 2)).between(2, 80) & ~F.contains(half(i, 2), F.lit("."))
    act = lambda i: F.coalesce(told(i).rlike(r'^[A-ZÁÉÍÓÚÑ“"0-9]') & ~F.array_contains(days, F.lower(F.regexp_extract(told(i), r"^(\p{L}+)", 1))), F.lit(False))
    # the line that an act's head was is gone; a head whose act is a head itself stays
    pairs = lambda i: above(i) & act(i + 1)
    joined = lambda i: F.concat(F.regexp_extract(half(i, 1), r"^[\d:]+", 0), F.lit(" - "), told(i + 1), F.lit(" ("), half(i, 2), F.lit(")"))
    numbers = F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1)))
    taken = lambda i: (i > 1) & pairs(i - 1) & ~((i > 2) & pairs(i - 2))
    kept = F.transform(F.filter(numbers, lambda i: ~taken(i)), lambda i: F.when(pairs(i), joined(i)).otherwise(told(i)))
    return F.when(text.isNotNull(), F.array_join(kept, "\n"))


def page_number(url: Column) -> Column:
    """The page that an image's address tells, 0 without: the number of two to
    four digits after a word for page, else the one just before the ending."""
    runs = F.regexp_extract_all(F.lower(url), F.lit(r"[a-z]+|\d+|[^a-z\d]+"), F.lit(0))
    run = lambda i: F.coalesce(F.when(i > 0, F.try_element_at(runs, F.greatest(i, F.lit(1)))), F.lit(""))
    number = lambda i: run(i).rlike(r"^\d{2,4}$")
    page = lambda x: F.regexp_extract(x, f"({'|'.join(PAGE_WORDS)})$", 1) != ""
    named = lambda i: number(i) & (page(run(i - 1)) | (run(i - 1).isin("-", "_") & page(run(i - 2))))
    size = F.size(runs)
    at = F.filter(F.sequence(F.lit(2), F.greatest(size, F.lit(2))), named)
    last = F.when((size >= 3) & (run(size - 1) == ".") & run(size).rlike("^[a-z]+$") & run(size - 2).rlike(r"^\d{2,}$"), F.right(run(size - 2), F.lit(4)))
    return F.coalesce(run(F.try_element_at(at, F.lit(1))).try_cast("int"), last.try_cast("int"), F.lit(0))


def year_of(url: Column, html: Column, current: int) -> Column:
    """A page's year: of its address, else its stated time of publication, else
    its first visible date with a year, else the current one."""
    ways = [(url, r"(20\d{2})"), (html, r'article:published_time"\s+content="(20\d{2})'), (html, r'datetime="(20\d{2})-\d{2}-\d{2}'), (T.fold(html), r"\d{1,2}\s+[a-z]+,?\s*(20\d{2})")]
    return F.coalesce(*[F.regexp_extract(c, p, 1).try_cast("int") for c, p in ways], F.lit(current))


def month_by_day(day: Column, turn: int, before: str, after: str) -> Column:
    """The month of a feast that runs over two: late days are of the first."""
    return F.when(day >= turn, before).otherwise(after)


def month_in_slug(slug: Column) -> Column:
    """The month (1-12) that an address hints at, -1 without."""
    t, out = T.fold(slug), F.lit(-1)
    for word, month in reversed(SLUGS):
        out = F.when(F.contains(t, F.lit(word)), month).otherwise(out)
    return out


def rescued(texts: DataFrame, key: str, text: Column, names: DataFrame) -> DataFrame:
    """(key, nombres): of each piece of a poster the names of the dictionary
    (rango, nombre) that it holds, by rank, without those that hold an earlier
    one or are held by it, and after them the capitalised word that follows such
    a name by "y" ("UNO y OTRO"), once each. Texts without a name have none."""
    letters = T.MARKED + T.MARKED.upper()
    words = texts.select(key, F.regexp_extract_all(text, F.lit(f"[A-Za-z0-9{letters}]+"), F.lit(0)).alias("_w"))
    found = N.hits(texts, key, text, names)
    first = found.groupBy(key, "rango", "nombre").agg(F.min("desde").alias("desde"))
    size = F.size(F.split(T.words_and_digits(F.col("nombre")), " "))
    after = F.col("desde") + size
    word = lambda i: F.try_element_at("_w", (i + 1).cast("int"))
    second = word(after + 1)
    follows = (F.lower(word(after)) == "y") & second.rlike(f"^[A-Z{T.MARKED.upper()}].") & ~F.array_contains(F.array(*map(F.lit, NO_NAME)), T.fold(second))
    told = first.join(words, key).select(key, F.struct("rango", "nombre", F.when(follows, F.initcap(second)).alias("otro")).alias("_x"))
    lists = told.groupBy(key).agg(F.array_sort(F.collect_list("_x")).alias("_l"))
    holds = lambda a, b: F.contains(T.fold(a), T.fold(b)) | F.contains(T.fold(b), T.fold(a))
    none = F.array().cast("array<string>")
    kept = F.aggregate("_l", none, lambda acc, x: F.when(F.exists(acc, lambda a: holds(a, x["nombre"])), acc).otherwise(F.array_append(acc, x["nombre"])))
    others = F.transform(F.filter("_l", lambda x: x["otro"].isNotNull() & F.array_contains("_kept", x["nombre"])), lambda x: x["otro"])
    same = lambda acc, x: F.exists(acc, lambda a: T.fold(a) == T.fold(x))
    return lists.withColumn("_kept", kept).select(key, F.aggregate(others, F.col("_kept"), lambda acc, x: F.when(same(acc, x), acc).otherwise(F.array_append(acc, x))).alias("nombres"))


def across_columns(acts: DataFrame, sections: DataFrame, key: str = "id") -> DataFrame:
    """Acts (key, ord, day, orquestas) of a poster read across its columns: one
    without a line-up takes day and names of the next section (key, ord, day,
    nombres), where that has names and a day but no act of its own. Of several
    sections with one key and ord the one of least day and names counts."""
    following = sections.where((F.size("nombres") > 0) & (F.col("day") != "")).select(F.col(key).alias("_k"), (F.col("ord") - 1).alias("_o"), F.col("day").alias("_day"), "nombres")
    taken = acts.select(F.col(key).alias("_k"), (F.col("ord") - 1).alias("_o")).distinct()
    one = following.groupBy("_k", "_o").agg(F.min(F.struct("_day", "nombres")).alias("_s")).select("_k", "_o", "_s.*")
    free = one.join(taken, ["_k", "_o"], "left_anti")
    joined = acts.join(free, (F.col(key) == F.col("_k")) & (F.col("ord") == F.col("_o")) & (F.size("orquestas") == 0), "left")
    new = {"day": F.coalesce("_day", "day"), "orquestas": F.coalesce("nombres", "orquestas")}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in acts.columns])

"""Places in texts, as Column expressions: the venue before or after a title,
prose cut off a name, known hamlets, the place of a headline or an account."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions import text as T

#: Nouns of venues, words of routes, particles inside a name.
VENUES = "plaza parque cancha recinto auditorio teatro pabellón pabellon polideportivo mercado iglesia ermita escenario campo calle casa atrio caserío caserio terrero".split()
ROUTES = "hasta desde hacia recorrido trayecto salida llegada acompaña acompañada acompañado acompañamiento itinerario".split()
PARTICLES = "de del la el los las y e".split()
#: What an account's name says before its place.
OFFICES = "fiestas fiesta festejos ayuntamiento concejalía concejalia comisión comision".split()

#: Characters that a venue's name may have, in which its first
#: words are its own, and around a title in which a venue belongs to it; those
#: of a title by which it is found, and of a text that is looked at without it.
NAME, OWN, BEFORE, AFTER, KNOWN_BY, OPENING = 40, 12, 400, 200, 30, 600
#: Signs by which program text that was pasted into a page shows.
CODE_MARKS, CODE_SHARE = "{}$#;=<>()[]|&\\", 0.08

_UP = "[A-ZÁÉÍÓÚÑ]"
_PART = "|".join(PARTICLES)
_NAME = rf"\b(?:(?i:{'|'.join(VENUES)})|Casco)[ \t]+(?:(?:{_PART})[ \t]+)*{_UP}[^.\n,]{{0,{NAME}}}"
_ROUTE = rf"(?i)\b({'|'.join(ROUTES)})\b"


def venue_name(told: Column) -> Column:
    """The name that a piece of text beginning with a venue has: its words up to
    a time, or to where, beyond its first characters, a capitalised word leads to
    a small one that is no particle, as another phrase begins there."""
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    return T.let(told, lambda t: F.when(t.isNotNull(), T.let(words(t), _phrase)))


def _phrase(words: Column) -> Column:
    """The words of a venue's name, of those that a piece has."""
    at = lambda i: F.try_element_at(words, i)
    begins = lambda i: F.char_length(F.array_join(F.slice(words, 1, i - 1), " "))
    particle = F.array(*map(F.lit, PARTICLES))
    small = lambda w: w.rlike(r"^[a-záéíóúñ]{2}") & ~F.array_contains(particle, F.regexp_extract(w, r"^[a-záéíóúñ]+", 0))
    phrase = lambda i: (begins(i) >= OWN) & at(i).rlike(rf"^{_UP}(?:[a-záéíóúñ]*|{_UP}+)$") & F.coalesce(small(at(i + 1)), F.lit(False))
    ends = F.filter(F.sequence(F.lit(2), F.greatest(F.size(words), F.lit(2))), lambda i: F.coalesce(at(i).rlike(r"^\d{1,2}:\d{2}h?$") | phrase(i), F.lit(False)))
    return F.array_join(F.slice(words, 1, F.coalesce(F.try_element_at(ends, F.lit(1)), F.size(words) + 1) - 1), " ")


def venues(text: Column) -> Column:
    """(at, name) of the venues with a name of their own that a text tells, in
    order, but routes; at counts characters from 0."""
    hits = F.regexp_extract_all(text, F.lit(_NAME), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,told:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        at = state["at"] + F.char_length(x["piece"])
        return F.struct((at + F.coalesce(F.char_length(x["hit"]), F.lit(0))).alias("at"), F.array_append(state["out"], F.struct(at.alias("at"), x["hit"].alias("told"))).alias("out"))

    zipped = F.arrays_zip(F.split(text, _NAME, -1).alias("piece"), hits.alias("hit"))
    found = F.filter(F.aggregate(zipped, start, step, lambda s: s["out"]), lambda v: v["told"].isNotNull() & ~v["told"].rlike(_ROUTE))
    return F.transform(found, lambda v: F.struct(v["at"].alias("at"), venue_name(v["told"]).alias("name")))


def venue_in(text: Column) -> Column:
    """The last venue of a text, '' without."""
    hits = F.filter(F.regexp_extract_all(text, F.lit(_NAME), F.lit(0)), lambda v: ~v.rlike(_ROUTE))
    return F.coalesce(venue_name(F.try_element_at(hits, F.lit(-1))), F.lit(""))


def is_code(text: Column) -> Column:
    """Whether so many marks of programs stand in a text that it is none."""
    marks = F.char_length(text) - F.char_length(F.translate(text, CODE_MARKS, ""))
    return (marks > CODE_SHARE * F.char_length(text)) | text.rlike(r"^\s*(?:function|var|const|let)\s")


def place_before(text: Column, title: Column, reach: int = BEFORE) -> Column:
    """The last venue with a name of its own in the reach characters before a
    title, or in the opening of a text that lacks it; '' without."""
    at = F.instr(text, F.substring(title, 1, KNOWN_BY)) - 1
    end = F.when(at >= 0, at).otherwise(OPENING)
    near = F.filter(venues(text), lambda v: (v["at"] < end) & (v["at"] >= F.when(at >= 0, at - reach).otherwise(0)))
    return F.coalesce(F.try_element_at(near, F.lit(-1))["name"], F.lit(""))


def place_after(text: Column, title: Column, reach: int = AFTER) -> Column:
    """The first venue with a name of its own in the reach characters after the
    title; '' without."""
    at = F.instr(text, F.substring(title, 1, KNOWN_BY)) - 1
    end = at + F.char_length(title)
    near = F.filter(venues(text), lambda v: (at >= 0) & (v["at"] >= end) & (v["at"] < end + reach))
    return F.coalesce(F.try_element_at(near, F.lit(1))["name"], F.lit(""))


def place_in_title(title: Column) -> Column:
    """The venue that a headline names after "en"; '' without."""
    told = F.regexp_extract(title, rf"\b[Ee]n[ \t]+(?:el|la|los|las)[ \t]+({_NAME})", 1)
    return F.coalesce(F.nullif(venue_name(F.nullif(told, F.lit(""))), F.lit("")), F.lit(""))


def place_continued(text: Column, title: Column, reach: int = AFTER) -> Column:
    """The venue on the line or in the brackets that follow the title's line,
    where nothing else stands in them; '' without."""
    at = F.instr(text, F.substring(title, 1, KNOWN_BY))
    rest = F.substring(text, at + F.char_length(title), F.lit(reach))
    told = F.regexp_extract(rest, rf"^[^\n(]*[\n(]\s*(?:[Ee]n[ \t]+(?:el|la)[ \t]+)?({_NAME})\s*(?:[).\n]|$)", 1)
    return F.coalesce(F.when(at > 0, venue_name(F.nullif(F.regexp_replace(told, r"\).*", ""), F.lit("")))), F.lit(""))


def place_told(text: Column) -> Column:
    """What a text says after "Lugar:", unless it is program text; '' without."""
    told = F.trim(F.regexp_extract(text, r"(?i)\blugar:\s*([^.\n]{3,80})", 1))
    return F.when(~is_code(told), told).otherwise("")


def known_in(text: Column, names: list[str]) -> Column:
    """The first of the names, in their order, that a text holds; '' without."""
    folded = T.fold(text)
    return F.coalesce(*[F.when(F.contains(folded, T.fold(F.lit(n))), n) for n in names], F.lit(""))


def hamlet(title: Column) -> Column:
    """What a headline says before its first comma."""
    return F.trim(F.split(F.coalesce(title, F.lit("")), ",")[0])


def municipality(title: Column, names: list[str], elsewhere: list[str]) -> Column:
    """The municipality that one of the first two parts of a headline is, alone
    or with more words around it; null without and where it names a place that
    is elsewhere. Later parts name saints."""
    if not names:
        return F.lit(None).cast("string")
    spaced = lambda c: F.concat(F.lit(" "), T.words_and_digits(c), F.lit(" "))
    part = lambda i: spaced(F.coalesce(F.try_element_at(F.split(title, ","), F.lit(i)), F.lit("")))
    found = [F.when(F.contains(part(i), spaced(F.lit(n))), n) for i in (1, 2) for n in sorted(names, key=lambda n: (-len(n), n))]
    away = [F.contains(spaced(title), spaced(F.lit(e))) for e in elsewhere]
    outside = F.lit(False)
    for a in away:
        outside = outside | a
    return F.when(~outside, F.coalesce(*found))


def account_place(url: Column, name: Column) -> Column:
    """The place that an account is of: its name, else the last part of its
    address, without the office before it; dots and dashes are spaces."""
    last = F.regexp_extract(F.regexp_replace(url, r"/+$", ""), r"([^/]*)$", 1)
    told = F.coalesce(F.nullif(F.trim(name), F.lit("")), last, F.lit(""))
    office = rf"(?i)^(?:{'|'.join(OFFICES)})(?:\s+de\s+fiestas)?\s+(?:(?:del|de)\s+)?(?:(?:la|los|el|las)\s+)?"
    return F.trim(F.regexp_replace(F.regexp_replace(told, office, ""), "[._-]+", " "))


def slug_core(text: Column, url: Column, municipio: Column, generic: list[str], reach: int = 2000) -> Column:
    """The one word of an address that is neither generic nor of the
    municipality nor a number, as the start of the text spells it, with its
    article; '' where there is no such word, more than one, or the text lacks it."""
    words = F.split(F.lower(F.regexp_extract(F.regexp_replace(url, r"/+$", ""), r"([^/]*)$", 1)), "-")
    common = F.concat(F.array(*map(F.lit, generic)) if generic else F.array().cast("array<string>"), F.split(T.words_only(municipio), " "))
    left = F.filter(words, lambda w: (F.char_length(w) > 2) & ~w.rlike(r"^\d+$") & ~F.array_contains(common, w))
    start = F.substring(text, 1, reach)
    word = T.fold(left[0])
    plain = T.fold(start)
    pattern = F.concat(F.lit(r"(?:\b(?:el|la|los|las)\s+)?"), F.lit(r"\b\Q"), word, F.lit(r"\E\b"))
    at = F.regexp_instr(plain, pattern)
    found = F.regexp_substr(plain, pattern)
    return F.when((F.size(left) == 1) & (at > 0), F.substring(start, at, F.char_length(found))).otherwise("")

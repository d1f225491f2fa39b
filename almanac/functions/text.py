"""Text functions as Column expressions: folding, tokens, slugs, HTML lines."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters with marks of the languages at hand and what they fold to.
MARKED = "áàäâãåéèëêíìïîóòöôõúùüûñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"
#: All letters with marks and what Unicode makes of them without; marks that stand
#: by themselves.
_BARE = {chr(i): "".join(c for c in unicodedata.normalize("NFD", chr(i)) if not unicodedata.combining(c)) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x2000))}
_BARE = {c: b for c, b in _BARE.items() if len(b) == 1 and b != c}
LETTERS, BARE, MARKS = "".join(_BARE), "".join(_BARE.values()), "".join(map(chr, range(0x300, 0x370)))
#: Entities that are decoded by name.
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&aacute;": "á", "&eacute;": "é", "&iacute;": "í", "&oacute;": "ó", "&amp;": "&"}
#: Words that say nothing in a title, folded: particles, kinds of
#: performers, venues.
STOP = (
    "de la el las los del en con por una uno y al fin gran san santa para the and for "
    "orquesta orquestas grupo grupos amenizado amenizada amenizados amenizadas "
    "plaza calle parque teatro iglesia avenida recinto cancha auditorio ermita parroquia plazoleta pabellon campo puente"
).split()
#: What columns of programmes break or abbreviate, and how it reads.
_M, _D = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre", "lunes|martes|mi[ée]rcoles|jueves|viernes|s[áa]bado|domingo"
PROGRAMME = [("(?iu)SÁBAD O", "SÁBADO"), ("(?i)D OMINGO", "DOMINGO"), (r"(?i)\bJUl\b", "julio"), (r"(?i)\b(\d{1,2}):(\d{2})\s*H\b", "$1:$2"), (rf"(?iu)\b({_M})\s+({_D})\s+(\d{{1,2}})", "$2 $3 DE $1")]
CLOSING = r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|section|article|header|footer|ul|ol|table|nav|title)>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is worked out once, however often then uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def fold(c: Column) -> Column:
    """Lower case, letters without marks; as long as the text."""
    return F.translate(F.lower(c), LETTERS, BARE)


def bare(c: Column) -> Column:
    """fold without marks that stand by themselves, so that a letter and its
    mark fold like the one letter that both make."""
    return F.translate(F.lower(c), LETTERS + MARKS, BARE)


@F.pandas_udf(StringType())
def spelled_plain(texts: pd.Series) -> pd.Series:
    """Letters as they are meant, without marks: those drawn bold, circled, wide
    or joined become plain ones, whole texts, null stays null."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def words_only(c: Column) -> Column:
    """Folded letters; all else, digits too, is one space."""
    return F.trim(F.regexp_replace(bare(c), "[^a-z]+", " "))


def words_and_digits(c: Column) -> Column:
    """Folded letters and digits; all else is one space."""
    return F.trim(F.regexp_replace(bare(c), "[^a-z0-9]+", " "))


def compact(c: Column) -> Column:
    """Folded letters and digits alone."""
    return F.regexp_replace(bare(c), "[^a-z0-9]", "")


def tokens(c: Column, longer_than: int = 3) -> Column:
    """Distinct words of words_only that are long enough and say something."""
    stop = F.array(*map(F.lit, STOP))
    return F.array_distinct(F.filter(F.split(words_only(c), " "), lambda t: (F.char_length(t) > longer_than) & ~F.array_contains(stop, t)))


def slug(c: Column, most: int = 5) -> Column:
    stop = F.array(*map(F.lit, STOP))
    kept = F.filter(F.split(words_only(c), " "), lambda t: (F.char_length(t) > 2) & ~F.array_contains(stop, t))
    return F.array_join(F.slice(kept, 1, most), "-")


def entities(c: Column) -> Column:
    """The named ones as themselves, decimal and hexadecimal ones as their
    character; other named ones as a space."""
    for name, to in ENTITIES.items():
        if name != "&amp;":
            c = F.replace(c, F.lit(name), F.lit(to))
    c = numeric_entities(F.replace(c, F.lit("&amp;"), F.lit("\x01")))
    return F.replace(F.regexp_replace(c, "&[a-zA-Z]+;", " "), F.lit("\x01"), F.lit("&"))


def numeric_entities(c: Column) -> Column:
    """&#233; and &#xe9; as the character; what is no code point stays."""
    pattern = "&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    between = F.split(c, pattern, -1)

    def char(e: Column) -> Column:
        code = F.substring(e, 3, F.char_length(e) - 3)
        n = F.when(F.lower(code).startswith("x"), F.conv(F.substring(code, 2, F.char_length(code)), 16, 10)).otherwise(code).try_cast("int")
        good = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(e)

    joined = F.array_join(F.zip_with(between, F.transform(found, char), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.contains(c, F.lit("&#")), joined).otherwise(c)


def html_lines(html: Column) -> Column:
    """Lines of visible text: block ends and <br> break, scripts and styles go."""
    c = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(F.regexp_replace(c, CLOSING, "\n"), "(?s)<[^>]*>", " ")
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(entities(x), r"[ \t\r]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, "^https?://([^/:?#]+)", 1), r"^(www|m)\.", "")


def unwrapped(url: Column) -> Column:
    """Where a redirecting address (l.php?u=...) leads; others as they are."""
    inner = F.regexp_extract(url, r"/l\.php\?(?:[^#]*&)?u=([^&#]+)", 1)
    return F.when(inner != "", F.try_url_decode(inner)).otherwise(url)


def handle(url: Column) -> Column:
    """The account that an address names: profile.php's id, else its first part."""
    number = F.regexp_extract(url, r"profile\.php\?(?:[^#]*&)?id=([0-9]+)", 1)
    return F.when(number != "", number).otherwise(F.lower(F.regexp_extract(url, r"^https?://[^/]+/([A-Za-z0-9._-]+)", 1)))


def hours(c: Column) -> Column:
    """21.30h and 21.30 horas as 21:30h and 21:30 horas; prices stay."""
    return F.regexp_replace(c, r"(\d{1,2})\.(\d{2})(\s*(?:h|horas)(?:[^a-z]|$))", "$1:$2$3")


def clean_title(c: Column, most: int = 90) -> Column:
    """A title without marks of layout, in single spaces, of most characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[|*_#>`↓]+", " "), r"\s+", " ")), 1, most)


def says(c: Column, word: Column) -> Column:
    """Whether a text has a word, whatever the marks and case of either."""
    return F.contains(F.concat(F.lit(" "), words_and_digits(c), F.lit(" ")), F.concat(F.lit(" "), words_and_digits(word), F.lit(" ")))


def rewritten(c: Column, rules: list[tuple[str, str]]) -> Column:
    """A text after (pattern, replacement) rules, in their order."""
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def last_number_year(c: Column) -> Column:
    """The largest year 2020-2099 named in a text."""
    return F.array_max(F.transform(F.regexp_extract_all(c, F.lit("(20[2-9][0-9])"), F.lit(1)), lambda x: x.cast("int")))

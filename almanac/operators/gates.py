"""Gates: which posts, accounts, images and texts go on to the next step.

Column expressions, but for covered(), which is an anti-join. Null inputs give
what an empty value gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.functions import text as T
from almanac.operators.social import NIGHT, any_word, is_container

#: Words of a feast, and of what a text must hold to be promoted.
FEAST = "fiestas?|festejos|romeria|verbenas?|bailes?|orquestas?|tardeo"
SUBSTANCE = "verbena|baile|orquesta"
POSTER = "programa|fiesta|cartel|verbena|romer"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_priority(handle: Column, url: Column, first: list[str]) -> Column:
    """An account that always goes first, by its handle or its address."""
    address = F.lower(_text(url))
    named = F.lower(F.trim(_text(handle))).isin(first) if first else F.lit(False)
    return F.exists(F.array(*map(F.lit, first)).cast("array<string>"), lambda p: F.contains(address, F.concat(F.lit("/"), p))) | named


def is_fresh(days: Column, most: int = 7) -> Column:
    """At most so many days old; of unknown age is not."""
    return F.coalesce(days <= most, F.lit(False))


def is_recent(at: Column, now: Column, hours: int = 30) -> Column:
    """Not older than so many hours."""
    return F.coalesce(at >= now - F.make_interval(hours=F.lit(hours)), F.lit(False))


def is_read(level: str, pace: Column, priority: Column) -> Column:
    """Whether an account is read at a level: todo reads all; auto all but
    abandoned ones, which those that go first never are; else those of one
    pace, where an account of unknown pace counts as caliente."""
    if level == "todo":
        return F.lit(True)
    alive = priority | (_text(pace) != "abandonada")
    return alive if level == "auto" else alive & (F.coalesce(F.nullif(pace, F.lit("")), F.lit("caliente")) == level)


def is_promoted(place: Column, judged: Column, relevant: Column, score: Column, poster: Column, names: Column, text: Column) -> Column:
    """A candidate with a known place becomes an event by a verdict that is not
    no, or by 4 points and a poster, a line-up or a word of substance."""
    held = poster | (F.coalesce(F.size(names), F.lit(0)) > 0) | T.fold(_text(text)).rlike(SUBSTANCE)
    told = F.coalesce(judged, F.lit(False)) & F.coalesce(relevant, F.lit(True))
    return (_text(place) != "") & (told | F.coalesce((score >= 4) & held, F.lit(False)))


def says_something(text: Column, names: list[str] = ()) -> Column:
    """A transcribed poster that names a feast, an hour, a month, a weekday, a
    year or a performer of the dictionary; else it is noise."""
    t = T.fold(_text(text))
    calendar = any_word([*D.MONTHS, "setiembre", *D.WEEKDAYS])
    hay = F.concat(F.lit(" "), T.words_only(_text(text)), F.lit(" "))
    known = F.exists(F.array(*map(F.lit, names)).cast("array<string>"), lambda n: F.contains(hay, F.concat(F.lit(" "), n, F.lit(" "))))
    return t.rlike(rf"\b({FEAST})\b|{NIGHT}|\d{{1,2}}:\d{{2}}|20\d{{2}}") | t.rlike(calendar) | known


def is_poster(src: Column, valid: str) -> Column:
    """An image of this year's programme, by its address."""
    path = F.lower(F.substring_index(_text(src), "?", 1))
    return F.lower(_text(src)).rlike("^https?:") & path.rlike(r"\.(jpe?g|png|webp)$") & F.contains(_text(src), F.lit(valid)) & F.lower(_text(src)).rlike(POSTER)


def is_opened(title: Column, accepted: Column, places: list[str] = ()) -> Column:
    """Whether a listed item's page is worth reading: its title is accepted,
    stands for a programme, or names (as whole words) a place. places: folded."""
    named = T.fold(_text(title)).rlike(any_word(list(places))) if places else F.lit(False)
    return F.coalesce(accepted, F.lit(False)) | is_container(_text(title)) | named


def is_elsewhere(text: Column, places: list[str]) -> Column:
    """Names, as whole words, a place outside of the region. places: folded."""
    return T.fold(_text(text)).rlike(any_word(places)) if places else F.lit(False)


def is_entity(url: Column, name: Column, site: str, own: str = "", navigation: str = "settings|friends|help|login") -> Column:
    """A link to an account of the site: its address is one part, a number of
    profile.php or below /pages/; its name has two letters; neither a part of
    the site itself nor the reader's own."""
    path = F.regexp_extract(_text(url), "^https?://[^/]+(/[^#]*)$", 1)
    account = path.rlike(r"^/[^/?]+/?(\?|$)") | F.contains(path, F.lit("profile.php")) | path.startswith("/pages/")
    mine = (F.lit(own) != "") & (T.handle(_text(url)) == own)
    return (T.host(_text(url)) == site) & account & (F.char_length(F.trim(_text(name))) >= 2) & ~path.rlike(rf"^/({navigation})\b") & ~mine


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(T.words_and_digits(_text(c)), " "), lambda w: F.char_length(w) > 3))


def covered(texts: DataFrame, known: DataFrame, key: str = "municipio", text: str = "texto", share: float = 0.8) -> DataFrame:
    """Rows of texts that no known text of the same key covers: a share of the
    shorter one's words is in the other. Texts without words are never covered.
    An anti-join by key: known texts are a few for each key (one programme a
    place and year), and no pair leaves the join."""
    have = known.select(F.col(key).alias("_key"), word_set(F.col(text)).alias("_known")).where(F.size("_known") > 0)
    fresh = texts.withColumn("_words", word_set(F.col(text)))
    shared = F.size(F.array_intersect("_words", "_known"))
    enough = (F.size("_words") > 0) & (shared >= share * F.least(F.size("_words"), F.size("_known")))
    return fresh.join(have, (F.col(key) == F.col("_key")) & enough, "left_anti").select(*texts.columns)


def of_account(events: DataFrame, handle: str, today: str) -> DataFrame:
    """Stored events that an account told of, by its handle in their address,
    that are not called off and are to come."""
    url = F.lower(F.coalesce("url", F.lit("")))
    return events.where(F.contains(url, F.lit(handle.lower())) & (F.coalesce("estado", F.lit("activo")) == "activo") & D.is_future(F.col("day"), today))

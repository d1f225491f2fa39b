"""Main text of web pages: flat text blocks and a decision tree.

A page becomes a flat list of text blocks, one for each stretch of text between
block-level tags. Features of a block are its words and link density, those of
the blocks before and after it, and where it stands: inside an article or main
element; inside an element that never holds main text by its tag, role or as
comments (boiler); inside one whose class or id has a word of menus, headers,
sidebars, notices or adverts (named), and which share of the page's words the
least such element holds, as a wrapper of the whole page may be named so too.
Beside an article that stands outside of it, a named element's share counts as
0. An article or main element inside a wrapper that is only named starts anew;
headers in an article are part of it. A decision tree, trained on the small
labelled table below, says which blocks are main text. The text of a named
inline element is a block of its own, and what stands around it stays one.

Each page is read by itself where it is, whole; nothing is shuffled.

A page is read in one pass, in time and memory linear in its length, whatever it
holds.

Defined results: null or empty html gives empty text; markup that never ends
is dropped, as are unclosed scripts; other unclosed elements that hold no text end
with their parent, a head at the first element that cannot stand in it; a quote in
a tag that nothing closes is no quote; an unknown character reference stays as
it is; null ids and urls are kept; repeated rows give repeated results; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.learning import Trees, boost
from almanac.session import read

#: Elements without text, elements that do not break a block,
#: elements that never hold main text, and words that name such parts.
SILENT = "script style noscript template svg math iframe object head select option textarea button canvas audio video map datalist title".split()
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split()
VOID = "area base br col embed hr img input link meta source track wbr".split()
BOILER = "nav footer aside form menu dialog".split()
NAMED = "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent notice alert popup modal overlay newsletter subscribe signup menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social comment comments disqus respond reply replies discussion login search pagination pager copyright legal toolbar".split()
#: Names that an article's own parts have too, and first parts of names that
#: only tell how something else looks.
HEADS = "header banner masthead".split()
LOOKS = "has no with without is not hide show".split()
#: Names of parts that hold other articles.
OTHERS = "comment comments disqus respond reply replies discussion related recommended".split()
#: Elements that the next of their kind ends.
IMPLIED = "p li dt dd tr td th".split()
ROLES = "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split()

#: Of the silent ones, those whose content is text whatever it looks like; a
#: script or style without an end runs to the end of the page.
RAW = "script style textarea title iframe".split()
#: What may stand in a head; any other element ends it.
IN_HEAD = "base link meta title script style noscript template".split()

TAG = re.compile(r"<(?:(!--)|[!?]|(/?)([A-Za-z][^\s/>]*))")
MARK = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAME = re.compile(r"[a-z]+")
SPACE = re.compile(r"[\s\xa0]+")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "boiler", "named", "share", "heading")
Block = tuple[str, int, int, bool, bool, int, bool]

#: A small labelled table, by hand: features as named above without named and
#: share, then 1 for main text. Blocks of articles, with and without an article element, and blocks
#: of menus, headers, footers, sidebars, notices, adverts, forms and comments.
LABELLED = [
    # words links before     after      article boiler heading main
    (60, 0.00, 12, 0.00, 55, 0.00, 1, 0, 0, 1), (3, 0.00, 0, 0.00, 40, 0.00, 1, 0, 1, 1), (8, 0.00, 6, 1.00, 80, 0.02, 1, 0, 1, 1),
    (1, 0.00, 45, 0.00, 20, 0.00, 1, 0, 0, 1), (20, 0.10, 60, 0.00, 3, 0.00, 1, 0, 0, 1), (150, 0.05, 2, 0.00, 0, 0.00, 1, 0, 0, 1),
    (6, 0.00, 30, 0.00, 6, 0.00, 1, 0, 0, 1), (2, 0.00, 7, 0.00, 9, 0.50, 1, 0, 0, 1), (12, 0.40, 90, 0.00, 70, 0.00, 1, 0, 0, 1),
    (9, 0.00, 1, 1.00, 1, 0.00, 1, 0, 1, 1), (1, 0.00, 1, 0.00, 1, 0.00, 1, 0, 0, 1), (30, 0.00, 30, 0.00, 30, 0.00, 1, 0, 0, 1),
    (4, 1.00, 60, 0.00, 60, 0.00, 1, 0, 0, 1), (1, 1.00, 3, 0.00, 5, 0.00, 1, 0, 0, 1), (400, 0.00, 9, 0.00, 8, 1.00, 1, 0, 0, 1),
    (70, 0.00, 12, 0.00, 55, 0.00, 0, 0, 0, 1), (35, 0.05, 60, 0.00, 45, 0.00, 0, 0, 0, 1), (9, 0.00, 4, 1.00, 60, 0.00, 0, 0, 1, 1),
    (5, 0.00, 50, 0.00, 70, 0.00, 0, 0, 1, 1), (18, 0.00, 60, 0.00, 40, 0.10, 0, 0, 0, 1), (25, 0.10, 8, 0.00, 3, 1.00, 0, 0, 0, 1),
    (12, 0.00, 45, 0.00, 50, 0.00, 0, 0, 0, 1), (90, 0.02, 0, 0.00, 0, 0.00, 0, 0, 0, 1), (7, 0.00, 30, 0.00, 35, 0.00, 0, 0, 0, 1),
    (2, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 1), (5, 0.00, 4, 0.00, 6, 0.00, 0, 0, 0, 1), (3, 0.00, 5, 0.00, 0, 0.00, 0, 0, 0, 1),
    (10, 0.00, 0, 0.00, 5, 0.00, 0, 0, 0, 1), (6, 0.00, 20, 0.00, 4, 0.00, 0, 0, 0, 1), (2, 0.00, 0, 0.00, 9, 0.00, 0, 0, 1, 1),
    (2, 0.00, 1, 1.00, 15, 0.00, 0, 0, 1, 1), (4, 0.00, 2, 1.00, 50, 0.00, 0, 0, 1, 1), (7, 0.00, 1, 1.00, 12, 0.00, 0, 0, 1, 1),
    (14, 0.00, 2, 0.00, 15, 0.00, 0, 0, 0, 1), (15, 0.00, 14, 0.00, 14, 0.00, 0, 0, 0, 1), (13, 0.00, 15, 0.00, 3, 0.00, 0, 0, 0, 1),
    (1, 1.00, 0, 0.00, 1, 1.00, 0, 0, 0, 0), (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 0, 0), (2, 1.00, 1, 1.00, 60, 0.00, 0, 0, 0, 0),
    (4, 0.00, 2, 1.00, 2, 1.00, 0, 0, 0, 0), (3, 0.00, 1, 1.00, 0, 0.00, 0, 0, 0, 0), (6, 0.80, 80, 0.00, 5, 0.90, 0, 0, 0, 0),
    (5, 0.90, 6, 0.80, 4, 1.00, 0, 0, 0, 0), (3, 0.00, 0, 0.00, 2, 1.00, 0, 0, 1, 0), (8, 1.00, 40, 0.00, 9, 1.00, 0, 0, 0, 0),
    (2, 0.00, 5, 1.00, 3, 0.00, 0, 0, 0, 0), (15, 0.60, 9, 1.00, 3, 0.50, 0, 0, 0, 0), (4, 0.50, 3, 0.00, 0, 0.00, 0, 0, 0, 0),
    (1, 1.00, 1, 1.00, 8, 0.00, 0, 1, 0, 0), (8, 0.00, 1, 1.00, 12, 0.00, 0, 1, 0, 0), (10, 0.00, 60, 0.00, 0, 0.00, 0, 1, 0, 0),
    (40, 0.00, 60, 0.00, 30, 0.00, 0, 1, 0, 0), (3, 0.00, 0, 0.00, 9, 0.00, 0, 1, 1, 0), (80, 0.00, 20, 0.00, 90, 0.00, 0, 1, 0, 0),
    (25, 0.30, 8, 0.00, 50, 0.00, 0, 1, 0, 0), (12, 0.00, 70, 0.00, 60, 0.00, 1, 1, 0, 0), (50, 0.00, 60, 0.00, 40, 0.00, 1, 1, 0, 0),
    (2, 1.00, 30, 0.00, 2, 1.00, 1, 1, 0, 0), (5, 0.00, 80, 0.00, 70, 0.00, 1, 1, 1, 0), (200, 0.00, 5, 0.00, 7, 0.00, 0, 1, 0, 0),
    (1, 0.00, 400, 0.00, 2, 0.00, 1, 1, 0, 0), (30, 0.00, 1, 0.00, 30, 0.00, 1, 1, 0, 0), (6, 0.00, 3, 0.00, 200, 0.00, 0, 1, 0, 0),
]
#: The same for blocks of named elements, with their share in place of boiler:
#: menus, notices, adverts, and wrappers of whole pages.
LABELLED_NAMED = [
    # words links before     after      article share heading main
    (1, 1.00, 1, 1.00, 8, 0.00, 0, 0.02, 0, 0), (8, 0.00, 1, 1.00, 12, 0.00, 0, 0.05, 0, 0), (10, 0.00, 60, 0.00, 0, 0.00, 0, 0.10, 0, 0),
    (40, 0.00, 60, 0.00, 30, 0.00, 0, 0.25, 0, 0), (3, 0.00, 0, 0.00, 9, 0.00, 0, 0.00, 1, 0), (80, 0.00, 20, 0.00, 90, 0.00, 0, 0.40, 0, 0),
    (25, 0.30, 8, 0.00, 50, 0.00, 0, 0.15, 0, 0), (12, 0.00, 70, 0.00, 60, 0.00, 1, 0.00, 0, 0), (50, 0.00, 60, 0.00, 40, 0.00, 1, 0.00, 0, 0),
    (5, 0.00, 80, 0.00, 70, 0.00, 1, 0.01, 1, 0), (200, 0.00, 5, 0.00, 7, 0.00, 0, 0.00, 0, 0), (30, 0.00, 1, 0.00, 30, 0.00, 1, 0.30, 0, 0),
    (60, 0.00, 12, 0.00, 55, 0.00, 0, 0.90, 0, 1), (9, 0.00, 4, 1.00, 60, 0.00, 0, 0.85, 1, 1), (35, 0.05, 60, 0.00, 45, 0.00, 0, 0.70, 0, 1),
    (5, 0.00, 50, 0.00, 70, 0.00, 0, 1.00, 1, 1), (20, 0.10, 60, 0.00, 3, 0.00, 1, 0.95, 0, 1), (8, 0.00, 30, 0.00, 20, 0.00, 0, 0.75, 0, 1),
    (2, 0.00, 1, 1.00, 15, 0.00, 0, 0.90, 1, 1), (14, 0.00, 2, 0.00, 15, 0.00, 0, 0.80, 0, 1), (15, 0.00, 14, 0.00, 14, 0.00, 0, 0.85, 0, 1),
    (3, 0.00, 0, 0.00, 30, 0.00, 0, 0.90, 1, 1), (6, 0.00, 5, 0.00, 0, 0.00, 0, 1.00, 0, 1), (12, 0.00, 45, 0.00, 50, 0.00, 1, 0.80, 0, 1),
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 0.90, 0, 0), (2, 1.00, 1, 1.00, 60, 0.00, 0, 0.80, 0, 0), (5, 0.90, 6, 0.80, 4, 1.00, 0, 1.00, 0, 0),
]


#: Neighbours (words, links) before and after.
AROUND = [(0, 0.00), (1, 1.00), (3, 0.00), (60, 0.00), (9, 0.80)]


@cache
def tree(depth: int = 8) -> Trees:
    """Blocks of an article, of boilerplate and of named parts that are small
    count in any surroundings; the others as they stand in the table."""
    rows = [(*r[:8], 0, 0.0, *r[8:]) for r in LABELLED] + [(*r[:7], 0, 1, *r[7:]) for r in LABELLED_NAMED]
    anywhere = [r for r in rows if r[7] or (r[8] and r[9] <= 0.5) or (r[6] and not r[8])]
    rows += [(*r[:2], *b, *a, *r[6:]) for r in anywhere for b in AROUND for a in AROUND]
    table = np.asarray(rows, float)
    return boost(table[:, :-1], table[:, -1], rounds=1, rate=1.0, depth=depth, least=1.0, ridge=0.05)


def _boiler(tag: str, attributes: str, in_article: bool) -> int:
    """0: not such a part; 1: named so by class or id alone; 2: certainly one.
    header names a part of the page outside, of the article inside."""
    if tag in BOILER or (tag == "header" and not in_article):
        return 2
    if "=" not in attributes and "hidden" not in attributes.lower():
        return 0
    named = 0
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            return 2
        if key in ("class", "id") and tag not in ("body", "html", "article", "main"):
            for one in value.split():
                words = NAME.findall(one)
                found = [w for w in words if w in NAMED and not (in_article and w in HEADS)]
                if found and words[0] not in LOOKS:
                    named = max(named, 2 if any(w in OTHERS for w in found) else 1)
    return named


def pieces(html: str) -> Iterator[tuple[str, str, bool, str, int]]:
    """(text before it, tag, closing, attributes, end) of each tag of a page in one
    pass, and what is left as text with an empty tag. A ">" inside quotes ends no
    tag; a quote that nothing closes is no quote. What follows a raw element's
    start is skipped up to its end."""
    at, end = 0, len(html)
    unclosed: set[str] = set()
    while m := TAG.search(html, at):
        before, start = html[at : m.start()], m.end()
        if m[3] is None:
            close = html.find("-->" if m[1] else ">", start)
            at = end if close < 0 else close + (3 if m[1] else 1)
            if before:
                yield before, "", False, "", at
            continue
        stop, where = end, start
        while k := MARK.search(html, where):
            if k[0] == ">":
                stop = k.start()
                break
            where, pair = k.end(), -1
            if k[0] not in unclosed and (pair := html.find(k[0], where)) < 0:
                unclosed.add(k[0])
            where = max(where, pair + 1)
        tag, attributes, at = m[3].lower(), html[start:stop], min(end, stop + 1)
        yield before, tag, m[2] == "/", attributes, at
        if tag in RAW and not m[2] and not attributes.endswith("/") and f"</{tag}" not in unclosed:
            ended = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            if ended:
                at = ended.start()
            elif tag in ("script", "style"):
                return
            else:
                unclosed.add(f"</{tag}")
    if at < end:
        yield html[at:], "", False, "", end


def flat(html: str) -> tuple[list[Block], list[int]]:
    """(text, words, linked words, in article, in boilerplate, the innermost
    named element around it by number or 0, heading) of each block in page order;
    and for each such number, from 0, the number of the named element around it."""
    out: list[Block] = []
    parents = [0]
    text: list[str] = []
    linked = [0]
    # tag, then what holds again after it: in article, in boilerplate, named, in
    # a silent element, and the text and links before it of the block around a named
    # inline element
    open_: list[tuple[str, bool, bool, int, bool, tuple[list[str], int] | None]] = []
    places: dict[str, list[int]] = {}  # where each kind of element is open
    blocks: list[int] = []  # where elements are open that aren't inline
    state = {"link": 0, "heading": 0}
    article, boiler, named, silent = False, False, 0, False

    def close() -> None:
        if text:
            joined = SPACE.sub(" ", unescape("".join(text))).strip()
            if joined:
                n = joined.count(" ") + 1
                out.append((joined, n, min(n, linked[0]), article, boiler, named, state["heading"] > 0))
            text.clear()
        linked[0] = 0

    def begin(tag: str, around: tuple[list[str], int] | None = None) -> None:
        places.setdefault(tag, []).append(len(open_))
        if tag not in INLINE:
            blocks.append(len(open_))
        open_.append((tag, article, boiler, named, silent, around))

    def leave(k: int) -> None:
        """Close the k-th open element and all in it."""
        nonlocal article, boiler, named, silent
        while len(open_) > k:
            tag, was_article, was_boiler, was_named, was_silent, around = open_.pop()
            places[tag].pop()
            if tag not in INLINE:
                blocks.pop()
            if tag not in INLINE or around:
                close()
            article, boiler, named, silent = was_article, was_boiler, was_named, was_silent
            if around:
                text[:], linked[0] = around

    def enter(kind: int) -> None:
        """The state inside an element of that kind, as _boiler tells it."""
        nonlocal boiler, named
        boiler = boiler or kind == 2
        if kind == 1:
            parents.append(named)
            named = len(parents) - 1

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else -1

    for piece, tag, closing, attributes, _ in pieces(html):
        if piece:
            if silent and blocks and open_[blocks[-1]][0] == "head" and not piece.isspace():
                leave(blocks[-1])
            if not silent:
                text.append(piece)
                if state["link"]:
                    linked[0] += len(piece.split())
        if not tag:
            continue
        if silent and not closing and tag not in IN_HEAD and (head := last("head")) >= 0 and (blocks[-1] == head or tag == "body"):
            leave(head)
        if silent:
            if closing and (k := last(tag)) >= 0:
                leave(k)
            elif not closing and tag not in VOID and not attributes.endswith("/"):
                begin(tag)
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                state["link"] = 0 if closing else 1
            if tag in VOID:
                continue
            within = last(tag)  # only named ones, and those of their kind in them, are kept
            if within >= 0 and (closing or tag == "a"):
                leave(within)
                within = last(tag)
            if closing:
                continue
            kind = _boiler(tag, attributes, article) if attributes else 0
            if kind:
                begin(tag, (text[:], linked[0]))
                text.clear()
                linked[0] = 0
                enter(kind)
            elif within >= 0:
                begin(tag)
            continue
        if tag in SILENT and not closing:
            if not attributes.endswith("/"):
                close()
                begin(tag)
                silent = True
            continue
        # what ends here: this element, or a paragraph or one of its kind before it
        if closing:
            k = last(tag)
        else:
            k = blocks[-1] if blocks else -1
            if k >= 0 and open_[k][0] != "p" and not (tag in IMPLIED and open_[k][0] == tag):
                k = -1
        if k >= 0:
            leave(k)
        close()
        state["link"] = 0
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            state["heading"] = 0 if closing else 1
        if closing or tag in VOID or attributes.endswith("/"):
            continue
        begin(tag)
        if tag == "main" or (tag == "article" and not article):
            named = 0
        enter(_boiler(tag, attributes, article))
        article = article or tag in ("article", "main")
    leave(0)
    close()
    return out, parents


def shares(blocks: list[Block], parents: list[int]) -> list[float]:
    """For each block the share of the page's words that the least named
    element around it holds, which is the innermost; 0 if there is none, or beside
    an article."""
    held = [0] * len(parents)
    for b in blocks:
        held[b[5]] += b[1]
    for n in range(len(parents) - 1, 0, -1):
        held[parents[n]] += held[n] if parents[n] else 0
    total = sum(b[1] for b in blocks)
    beside = any(b[3] and not b[4] and not b[5] for b in blocks)
    return [0.0 if beside or not b[5] else held[b[5]] / total for b in blocks]


def features(blocks: list[Block], parents: list[int]) -> np.ndarray:
    raw = np.asarray([(b[1], b[2], b[3], b[4], b[5] > 0, b[6]) for b in blocks], float).reshape(-1, 6)
    words, links = raw[:, 0], raw[:, 1] / np.maximum(raw[:, 0], 1)
    near = [np.concatenate([[0], x])[:-1] for x in (words, links)] + [np.concatenate([x, [0]])[1:] for x in (words, links)]
    return np.stack([words, links, *near, raw[:, 2], raw[:, 3], raw[:, 4], np.asarray(shares(blocks, parents)), raw[:, 5]], 1)


def extracted(html: str | None, model: Trees) -> str:
    blocks, parents = flat(html or "")
    if not blocks:
        return ""
    main = model(features(blocks, parents)) > 0
    return "\n".join(b[0] for b, keep in zip(blocks, main, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tree()
        for b in batches:
            texts = [extracted(h.as_py(), model) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return picked.mapInArrow(rows, "page_id long, url string, text string, n_chars long")


def op3_flat_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))

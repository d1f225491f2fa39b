"""Text of PDF pages from placed items, with a second column put after the
first; and the repairs of text that was broken in layout.

Items are (url, page, width, s, x, y, w); a page is a group of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.session import ship

#: Fixed values, as shares of a page's width: where a gap may lie, how wide it
#: has to be, and how wide an item is that runs over both columns; items a side.
MIDDLE, LEAST_GAP, WIDE, LEAST_ITEMS = (0.15, 0.85), 0.015, 0.35, 3


def column_cut(items: pd.DataFrame, width: float) -> float | None:
    """Where a page is cut in two: the middle of the widest gap between the
    stretches that its items cover, those that run over both columns apart."""
    if not width:
        return None
    narrow = items[items["w"] <= WIDE * width].sort_values("x")
    left, right = narrow["x"].to_numpy(float), (narrow["x"] + narrow["w"]).to_numpy(float)
    centre = (left + right) / 2
    reach = np.maximum.accumulate(right) if len(right) else right
    low, high = (m * width for m in MIDDLE)
    found = [(min(b, high) - max(a, low), (max(a, low) + min(b, high)) / 2) for a, b in zip(reach[:-1], left[1:], strict=True)]
    for gap, cut in sorted(found, key=lambda g: (-g[0], g[1])):
        if gap >= LEAST_GAP * width and min((centre < cut).sum(), (centre >= cut).sum()) >= LEAST_ITEMS:
            return cut
    return None


def page_texts(items: DataFrame, columns: bool = True) -> DataFrame:
    """(url, page, texto): rows from top to bottom, items from left to right."""
    ship(items.sparkSession)

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        cut = column_cut(pdf, float(pdf["width"].iloc[0] or 0)) if columns else None
        pdf = pdf.assign(side=0 if cut is None else (pdf["x"] + pdf["w"].where(pdf["w"] <= WIDE * pdf["width"], 0) / 2 >= cut).astype(int), row=(pdf["y"] / 4).round() * -4).sort_values(["side", "row", "x"], kind="stable")
        lines = pdf.groupby(["side", "row"], sort=True)["s"].agg(" ".join)
        return pd.DataFrame({"url": [pdf["url"].iloc[0]], "page": [pdf["page"].iloc[0]], "texto": ["\n".join(lines)]})

    return items.groupBy("url", "page").applyInPandas(page, "url string, page int, texto string")


def repaired(text: Column) -> Column:
    """Words that were hyphenated at a line end are joined (a capital after a
    small letter is another word), control characters go, months are mended."""
    c = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    c = F.regexp_replace(c, r"(\p{L})\s*-\s+(?=\p{Ll})|(\p{Lu})\s+-\s*(?=\p{Lu})", "$1$2")
    for broken, month in (("septiembe", "septiembre"), ("setiembe", "setiembre"), ("octube", "octubre"), ("noviembe", "noviembre"), ("diciembe", "diciembre")):
        c = F.regexp_replace(c, rf"(?iu)\b{broken}\b", month)
    return c

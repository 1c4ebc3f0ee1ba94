"""A page's parts by regular expressions: script and style leave before any tag is stripped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMENT, SCRIPT, STYLE = "(?s)<!--(.*?)-->", "(?s)<script[^>]*>(.*?)</script>", "(?s)<style[^>]*>(.*?)</style>"
TITLE, HREF = "(?s)<title>(.*?)</title>", 'href="([^"]*)"'
PARTS = ("visible", "title", "comment", "script", "style", "href")
#: What a hit in a part counts: text that no reader sees weighs more.
WEIGHTS = {"visible": 1.0, "title": 1.0, "comment": 2.0, "script": 1.5, "style": 1.5, "href": 1.5}


def visible(html: Column) -> Column:
    for pattern in (SCRIPT, STYLE, COMMENT, TITLE):
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "[ \\t\\n\\r]+", " "))


def parts(html: Column) -> dict[str, Column]:
    every = lambda pattern: F.array_join(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), " ")
    return {"visible": visible(html), "title": every(TITLE), "comment": every(COMMENT), "script": every(SCRIPT), "style": every(STYLE), "href": every(HREF)}


def by_part(pages: DataFrame) -> DataFrame:
    """(page_id, part, text): a row for each part that a page has."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = F.array(*[F.struct(F.lit(k).alias("part"), v.alias("text")) for k, v in parts(html).items()])
    return pages.select("page_id", F.inline(rows)).where(F.col("text") != "")

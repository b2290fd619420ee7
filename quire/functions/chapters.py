"""Chapters of a book's Markdown as arrays of (level, title, body)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.bind import let
from quire.functions.text import rstrip, strip

PAGE_BREAK = "<!-- pagebreak -->"
# Fixed patterns of headings and page breaks.
H1 = r"(?mdU)^#\s+(.+?)\s*$"
H2 = r"(?mdU)^##\s+(.+?)\s*$"
BREAK = rf"(?md)^{PAGE_BREAK}$"
#: Headings that make a structure.
LEAST = 3


def _chapter(title: Column, body: Column) -> Column:
    return F.struct(F.lit(1).cast("long").alias("level"), title.alias("title"), body.alias("body"))


def _none() -> Column:
    return F.array().cast("array<struct<level:bigint,title:string,body:string>>")


def by_heading(md: Column, pattern: str) -> Column:
    """A chapter for each heading and one for what stands before; null below LEAST headings."""
    titles = F.regexp_extract_all(md, F.lit(pattern), F.lit(1))

    def split(both: Column) -> Column:
        parts = both["parts"]
        preface = F.when(F.get(parts, F.lit(0)) != "", F.array(_chapter(F.lit(""), rstrip(F.get(parts, F.lit(0)))))).otherwise(_none())
        rest = F.zip_with(both["titles"], F.slice(parts, F.lit(2), F.size(both["titles"])), lambda t, p: _chapter(strip(t), rstrip(p)))
        return F.when(F.size(both["titles"]) >= LEAST, F.concat(preface, rest))

    return let(F.struct(titles.alias("titles"), F.split(md, pattern, -1).alias("parts")), split)


def by_pages(md: Column, pages: int) -> Column:
    """A chapter for each `pages` pages that are not blank."""
    whole = F.filter(F.transform(F.split(md, BREAK, -1), strip), lambda p: p != "")

    def group(kept: Column) -> Column:
        n = F.size(kept)

        def one(s: Column) -> Column:
            title = F.concat(F.lit("Pagine "), (s + 1).cast("string"), F.lit("-"), F.least(s + pages, n).cast("string"))
            return _chapter(title, F.array_join(F.slice(kept, s + 1, F.lit(pages)), "\n\n"))

        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(pages))
        return F.when(n == 0, F.array(_chapter(F.lit(""), strip(md)))).otherwise(F.transform(starts, one))

    return let(whole, group)


def by_break(md: Column) -> Column:
    """A chapter for each page; blank ones go, but for one that stands before the first break and is only blanks."""
    def pages(parts: Column) -> Column:
        kept = F.filter(parts, lambda p, i: F.when(i == 0, p != "").otherwise(strip(p) != ""))
        each = F.transform(kept, lambda p: _chapter(F.lit(""), strip(p)))
        return F.when(F.size(parts) == 1, F.array(_chapter(F.lit(""), strip(md)))).otherwise(each)

    return let(F.split(md, BREAK, -1), pages)


def adaptive(md: Column, chapter_pages: int | None = None) -> Column:
    """First headings of level 1, then of level 2, then groups of pages, then pages; none for a blank text."""
    last = by_pages(md, chapter_pages) if chapter_pages and chapter_pages > 0 else by_break(md)
    return F.when(strip(md) == "", _none()).otherwise(F.coalesce(by_heading(md, H1), by_heading(md, H2), last))

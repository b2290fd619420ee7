"""Layout markup inside recognised text: parsing and rewriting, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.functions.bind import let
from quire.functions.text import strip

# Fixed patterns of the markup.
DET = r"<\|det\|>([^\[]+)\[\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\]<\|/det\|>"
BBOX = r"<\|bbox\|\s*(\d+)\s*\|\s*(\d+)\s*\|\s*(\d+)\s*\|\s*(\d+)\s*(?:\|\s*([^|>\s]+)\s*)?\|?>"
LAYOUT_TEXT = r"<\|det\|>(footer|page_number|header)\[[^\]]+\]<\|/det\|>([^\n<]+)"
LAYOUT_EMPTY = r"<\|det\|>(?:footer|page_number|header)\[[^\]]+\]<\|/det\|>"
ASSETS = ("image", "figure", "table")
PREFIXES = {"title": "\n\n# ", "heading": "\n\n## ", "subtitle": "\n\n### "}


def _number(tag: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(tag, pattern, group).try_cast("bigint")


def parse_det(tag: Column) -> Column:
    return F.struct(strip(F.regexp_extract(tag, DET, 1)).alias("label"), *[_number(tag, DET, i + 2).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def parse_bbox(tag: Column) -> Column:
    return F.struct(F.regexp_extract(tag, BBOX, 5).alias("label"), *[_number(tag, BBOX, i + 1).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def tags(c: Column) -> Column:
    """All boxes of a text: det tags in order, then bbox tags; what is malformed is skipped."""
    return F.concat(F.transform(F.regexp_extract_all(c, F.lit(DET), F.lit(0)), parse_det), F.transform(F.regexp_extract_all(c, F.lit(BBOX), F.lit(0)), parse_bbox))


def box_from_string(c: Column, strict: bool = False) -> Column:
    """The first det tag of a string, else its first bbox tag, else null, or an error if strict."""
    wrong = F.raise_error(F.concat(F.lit("no box in: "), c)) if strict else F.lit(None)
    det = F.regexp_extract(c, DET, 0)
    bbox = F.regexp_extract(c, BBOX, 0)
    return F.when(det != "", parse_det(det)).when(bbox != "", parse_bbox(bbox)).otherwise(wrong)


def wrap_layout(c: Column) -> Column:
    """Running heads, feet and page numbers become blocks of their own; empty ones go."""
    c = F.regexp_replace(c, LAYOUT_TEXT, "\n\n<div class=\"$1\">\x00$2\x00</div>\n\n")
    c = F.regexp_replace(c, r"(?U)\x00[\s\x1c-\x1f]*|[\s\x1c-\x1f]*\x00", "")
    return F.regexp_replace(c, LAYOUT_EMPTY, "")


def asset_name(page_num: Column, label: Column, number: Column, ext: str) -> Column:
    return F.concat(F.lit("page"), F.lpad(page_num.cast("string"), 4, "0"), F.lit("_"), label, number.cast("string"), F.lit(ext))


def assets(c: Column, page_num: Column, w: Column, h: Column, ext: str = ".webp") -> Column:
    """The asset tags of a page with their numbers (those too small to cut out take a number, too) and verdicts."""
    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(DET), F.lit(0)), parse_det), lambda t: t["label"].isin(*ASSETS))

    def one(t: Column, i: Column) -> Column:
        box = geometry.denormalize(t["x1"], t["y1"], t["x2"], t["y2"], w, h)
        return F.struct(i.cast("long").alias("number"), t["label"].alias("label"), asset_name(page_num, t["label"], i, ext).alias("name"), box.alias("box"), geometry.large_enough(box).alias("kept"))

    return F.transform(found, one)


def rewrite_tags(c: Column, page_num: Column, w: Column, h: Column, ext: str = ".webp") -> Column:
    """Each det tag becomes Markdown: an image for assets large enough, a heading mark for headings, else a paragraph end."""
    found = F.transform(F.regexp_extract_all(c, F.lit(DET), F.lit(0)), parse_det)

    def step(acc: Column, x: Column) -> Column:
        """The text so far and the number of assets in it, by one tag and the text after it."""
        t = x["tag"]
        asset = t["label"].isin(*ASSETS)
        box = geometry.denormalize(t["x1"], t["y1"], t["x2"], t["y2"], w, h)
        percent = F.format_string("%.1f", geometry.width_percent(t["x1"], t["x2"]))
        image = F.concat(
            F.lit('\n\n<img src="images/'), asset_name(page_num, t["label"], acc["n"], ext), F.lit('" style="width:'), percent,
            F.lit('%;max-width:100%;height:auto;display:block;margin:1em auto;" />\n\n'),
        )
        new = F.when(asset & geometry.large_enough(box), image)
        for label, mark in PREFIXES.items():
            new = new.when(t["label"] == label, F.lit(mark))
        return F.struct(F.concat(acc["text"], new.otherwise(F.lit("\n\n")), x["after"]).alias("text"), (acc["n"] + asset.cast("int")).alias("n"))

    def fold(both: Column) -> Column:
        tail = F.slice(both["parts"], F.lit(2), F.size(both["found"]))
        pairs = F.zip_with(both["found"], tail, lambda t, p: F.struct(t.alias("tag"), p.alias("after")))
        start = F.struct(F.get(both["parts"], F.lit(0)).alias("text"), F.lit(0).alias("n"))
        return F.aggregate(pairs, start, step, lambda acc: acc["text"])

    return let(F.struct(found.alias("found"), F.split(c, DET, -1).alias("parts")), fold)

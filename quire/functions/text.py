"""Scalar text operators as Catalyst expressions.

Blank means Unicode white space and U+001C to U+001F, a line ends at \\n alone, as in the patterns below."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x1c-\x1f]"
NON_BLANK = r"[^\s\x1c-\x1f]"

# Typographic quotes and what they become.
SINGLE_QUOTES = "‘’`´"
DOUBLE_QUOTES = "“”«»"
# Placeholders that a multimodal prompt leaves behind.
PLACEHOLDERS = ("<image>", "<|image|>", "<image_1>")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){BLANK}+\z", "")


def clean_text(c: Column, fix_hyphenation: bool = True, normalize_quotes: bool = True) -> Column:
    """Quotes, hyphens at line ends, single line ends, left-over tags, runs of line ends, blanks before them, ends."""
    if normalize_quotes:
        c = F.translate(c, SINGLE_QUOTES + DOUBLE_QUOTES, "'" * 4 + '"' * 4)
    if fix_hyphenation:
        c = F.regexp_replace(c, rf"(?U)-{BLANK}*\n{BLANK}*", "")
        c = F.regexp_replace(c, rf"(?U)(?<={NON_BLANK})\n(?={NON_BLANK})", " ")
    c = F.regexp_replace(c, r"(?d)<\|det\|>.*?\[.*?\]<\|/det\|>", "")
    c = F.regexp_replace(c, r"(?d)<\|bbox\|.*?\|>", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"[ \t]+\n", "\n")
    return strip(c)


def count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"(?U){NON_BLANK}+")).cast("long")


def strip_placeholders(c: Column) -> Column:
    """Placeholders go, lines lose blanks at their ends, runs of blank lines become one."""
    for p in PLACEHOLDERS:
        c = F.replace(c, F.lit(p), F.lit(""))
    c = F.regexp_replace(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", "\n")
    c = F.regexp_replace(c, r"(?U)[\s\x1c-\x1f&&[^\n]]+(?=\n|\z)", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: Style that keeps an image inside its page.
IMAGE_STYLE = "max-width:100%; height:auto; display:block; margin:1em auto;"


def responsive_images(c: Column) -> Column:
    """Adds IMAGE_STYLE to images that have no maximal width yet, and closes their tags."""
    return F.regexp_replace(c, r"<img(?![^>]*max-width:100%)([^>]*?)\s*(?:/\s*)?>", f'<img $1 style="{IMAGE_STYLE}" />')


def chapter_title(html: Column, title: Column) -> Column:
    """The first heading of level 1 replaced by the chapter's own; without a title the text stays."""
    literal = F.regexp_replace(xml_escape(title), r"([\\$])", r"\\$1")
    new = F.concat(F.lit('$1<h1 class="chapter-title">'), literal, F.lit("</h1>"))
    return F.when(F.coalesce(title, F.lit("")) == "", html).otherwise(F.regexp_replace(html, F.lit(r"(?s)\A(.*?)<h1[^>]*>.*?</h1>"), new))


def page_separators(c: Column) -> Column:
    return F.greatest(F.regexp_count(c, F.lit("<page>")), F.lit(1)).cast("long")


def tail(c: Column, n: int = 500) -> Column:
    return F.right(c, F.lit(n))

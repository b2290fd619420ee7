"""Books as zip packages, and the Markdown subset that fills their chapters."""

from __future__ import annotations

import html
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions import text

MIMETYPE = "application/epub+zip"
CONTAINER = (
    '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>'
    '<rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
)
STYLE = "body { margin: 1em; line-height: 1.4; font-family: serif; }\nh1, h2, h3 { page-break-after: avoid; }\nimg { max-width: 100%; }\n"


def render_markdown(md: str) -> str:
    """XHTML body of a Markdown subset: headings, paragraphs, lists, emphasis, raw HTML blocks."""
    out = []
    for block in re.split(r"\n{2,}", md.strip()):
        if not block.strip() or block.strip().startswith("<!--"):
            continue
        if re.match(r"\s*<(div|img|p|table|h\d)\b", block):
            out.append(block)
            continue
        head = re.match(r"(#{1,6})\s+(.*)", block, re.S)
        inline = lambda t: re.sub(r"\*(.+?)\*", r"<em>\1</em>", re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", html.escape(t, quote=False)))
        if head:
            n = len(head[1])
            out.append(f"<h{n}>{inline(head[2].strip())}</h{n}>")
        elif all(re.match(r"[-*] ", x) for x in block.split("\n")):
            out.append("<ul>" + "".join(f"<li>{inline(x[2:])}</li>" for x in block.split("\n")) + "</ul>")
        else:
            out.append(f"<p>{inline(block)}</p>")
    return "\n".join(out)


@F.pandas_udf(StringType())
def _rendered(md: pd.Series) -> pd.Series:
    return md.map(render_markdown)


HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml">\n<head><title/><link rel="stylesheet" href="style.css"/></head>\n<body>\n'


def chapter_documents(entries: DataFrame) -> DataFrame:
    """Entries whose chapters (path ends in .md) have become XHTML documents with images that keep inside their page."""
    md = F.col("entry_path").endswith(".md")
    page = F.concat(F.lit(HEAD), text.responsive_images(_rendered(F.when(md, F.col("text")).otherwise(""))), F.lit("\n</body>\n</html>"))
    return entries.withColumn("text", F.when(md, page).otherwise(F.col("text"))).withColumn("entry_path", F.regexp_replace("entry_path", r"\.md$", ".xhtml"))


def packages(entries: DataFrame) -> DataFrame:
    """(book_id, n_entries, content) from entries (see books.entries): a zip with the type entry first and stored, all others
    deflated in the order of their paths, with a fixed time, so that a book built again is the same. An entry is its text
    or, without one, its bytes, and empty without either. A task holds one book."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr(zipfile.ZipInfo("mimetype", (2000, 1, 1, 0, 0, 0)), MIMETYPE, zipfile.ZIP_STORED)
            own = {"META-INF/container.xml": CONTAINER, "OEBPS/style.css": STYLE}
            own |= {path: next((x for x in (t, c) if x is not None), b"") for path, t, c in zip(f.entry_path, f.text, f.content, strict=True)}
            for path in sorted(own):
                z.writestr(zipfile.ZipInfo(path, (2000, 1, 1, 0, 0, 0)), own[path], zipfile.ZIP_DEFLATED)
            n = len(z.namelist())
        return pd.DataFrame([(f.book_id.iloc[0], n, buf.getvalue())], columns=["book_id", "n_entries", "content"])

    done = chapter_documents(entries).select("book_id", "entry_path", "text", "content")
    return done.groupBy("book_id").applyInPandas(run, "book_id string, n_entries long, content binary")


def write(books: DataFrame, path: str) -> DataFrame:
    """Writes each package with Spark's own file commit, as rows of (book_id, content), and gives what was written."""
    books.write.mode("overwrite").parquet(path)
    return books.sparkSession.read.parquet(path)

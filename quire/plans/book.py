"""The whole way from recognised pages to books, as one logical plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import chapters, markup, text
from quire.operators import books


def markdown(pages: DataFrame, pages_per_batch: int = 20) -> DataFrame:
    """(book_id, n_pages, n_assets, markdown, cleaned) of pages (book_id, page_num, w, h, raw_text), by way of batches.
    Pages are read and shuffled once by batch and once by book; n_assets counts the cuts that are kept."""
    read = books.read_batches(books.batches(pages, pages_per_batch))
    wrapped = read.withColumn("wrapped", markup.wrap_layout(F.col("segment")))
    cut = F.size(F.filter(markup.assets(F.col("wrapped"), F.col("page_num"), F.col("w"), F.col("h")), lambda a: a["kept"])).alias("cut")
    md = text.strip_placeholders(markup.rewrite_tags(F.col("wrapped"), F.col("page_num"), F.col("w"), F.col("h"))).alias("md")
    return books.assemble(wrapped.select("book_id", "page_num", md, cut), extra=[F.sum("cut").alias("n_assets")]).withColumn("cleaned", text.clean_text(F.col("markdown")))


def summary(pages: DataFrame) -> DataFrame:
    """(book_id, pages_processed, images_extracted, images_used, markdown_chars): a run's totals; characters are counted in the
    cleaned text, and every kept cut goes into the package."""
    done = markdown(pages)
    cut = F.col("n_assets").cast("long")
    return done.select("book_id", F.col("n_pages").alias("pages_processed"), cut.alias("images_extracted"), cut.alias("images_used"), F.char_length("cleaned").cast("long").alias("markdown_chars"))


def table_of_contents(pages: DataFrame, chapter_pages: int | None = None) -> DataFrame:
    found = books.explode_chapters(markdown(pages), chapters.adaptive(F.col("cleaned"), chapter_pages))
    return found.select("book_id", "chapter_no", "filename", "title", F.char_length("body").cast("long").alias("n_chars"))

"""From recognised pages to books: batches, segments, page Markdown, assembled text, chapters, package entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import chapters, formats, geometry, markup, text
from quire.functions.bind import let
from quire.functions.chapters import PAGE_BREAK
from quire.operators.unions import union

SEPARATOR = f"\n\n{PAGE_BREAK}\n\n"
PAGE_TAG = "(?i)<page>"
C_PAGES = "chapter_pages"


def batch_size(pages_per_batch: int, most: int = 30) -> int:
    return min(most, max(1, pages_per_batch))


def batches(pages: DataFrame, pages_per_batch: int = 20) -> DataFrame:
    """Adds batch_id, the batch's first and last page and the percentage reported when it starts."""
    size = batch_size(pages_per_batch)
    total = F.count("*").over(Window.partitionBy("book_id"))
    start = F.floor((F.col("page_num") - 1) / size)
    out = pages.withColumn("batch_id", start).withColumn("total", total)
    out = out.withColumn("batch_start", F.col("batch_id") * size + 1).withColumn("batch_end", F.least(F.col("batch_id") * size + size, "total"))
    return out.withColumn("percent", F.col("batch_end") * 100.0 / F.col("total"))


def _parts(raw: Column) -> Column:
    """The segments of a raw batch text, without a blank first one."""
    blank = lambda p: text.strip(F.get(p, F.lit(0))) == ""
    return let(F.split(text.strip(raw), PAGE_TAG, -1), lambda p: F.when(blank(p), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p))


def segments(texts: DataFrame) -> DataFrame:
    """(keys.., idx, segment) of raw batch texts (column raw_text), without a blank first segment."""
    return texts.select(*[c for c in texts.columns if c != "raw_text"], F.posexplode(_parts(F.col("raw_text"))).alias("idx", "segment"))


def read_batches(placed: DataFrame) -> DataFrame:
    """Pages in batches (book_id, batch_id, page_num, w, h, raw_text) as one reading of each batch sees them: (book_id, page_num,
    w, h, segment). The texts of a batch are joined and split again; pages stay beside them, so nothing is joined back."""
    rows = F.array_sort(F.collect_list(F.struct("page_num", "w", "h", "raw_text")))
    whole = placed.groupBy("book_id", "batch_id").agg(rows.alias("rows"))
    whole = whole.select("book_id", "rows", _parts(F.concat(F.lit("<page>"), F.array_join(F.transform("rows", lambda r: r["raw_text"]), "<page>"))).alias("parts"))
    each = whole.select("book_id", F.posexplode("rows").alias("i", "r"), "parts")
    return each.select("book_id", "r.page_num", "r.w", "r.h", F.coalesce(F.get("parts", F.col("i")), F.lit("")).alias("segment"))


def join_segments(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with the segment of their place in the batch: surplus segments go, missing ones are empty."""
    placed = pages.withColumn("idx", (F.col("page_num") - F.col("batch_start")).cast("int"))
    joined = placed.join(found.select("book_id", "batch_id", "idx", "segment"), ["book_id", "batch_id", "idx"], "left")
    return joined.withColumn("segment", F.coalesce("segment", F.lit("")))


def page_markdown(c: Column, page_num: Column, w: Column, h: Column, ext: str = ".webp") -> Column:
    return text.strip_placeholders(markup.rewrite_tags(markup.wrap_layout(c), page_num, w, h, ext))


def assemble(pages: DataFrame, md: str = "md", extra: Sequence[Column] = ()) -> DataFrame:
    """(book_id, n_pages, extra.., markdown): pages in order, joined by page breaks. One shuffle, on the book."""
    rows = F.array_sort(F.collect_list(F.struct("page_num", F.col(md).alias("md"))))
    return pages.groupBy("book_id").agg(F.count("*").alias("n_pages"), *extra, F.array_join(F.transform(rows, lambda r: r["md"]), SEPARATOR).alias("markdown"))


def explode_chapters(books: DataFrame, split: Column) -> DataFrame:
    """(book_id, chapter_no, level, title, filename, body); chapters without a title are called by their number."""
    rows = books.select("book_id", F.posexplode(split).alias("pos", "c"))
    title = F.when(F.col("c.title") == "", F.concat(F.lit("Pagina "), (F.col("pos") + 1).cast("string"))).otherwise(F.col("c.title"))
    name = F.concat(F.lit("chap_"), F.lpad(F.col("pos").cast("string"), 4, "0"), F.lit(".xhtml"))
    return rows.select("book_id", F.col("pos").cast("long").alias("chapter_no"), F.col("c.level").alias("level"), title.alias("title"), name.alias("filename"), F.col("c.body").alias("body"))


def with_cover(found: DataFrame, covers: DataFrame) -> DataFrame:
    """Chapters (book_id, chapter_no, title, filename) and, first, the cover of each book that has one (book_id)."""
    first = covers.select("book_id", F.lit(-1).cast("long").alias("chapter_no"), F.lit("Cover").alias("title"), F.lit("cover.xhtml").alias("filename"))
    return union(first, found.select("book_id", "chapter_no", "title", "filename"))


def _listing(df: DataFrame, item: Column, order: str, sep: str, name: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x"))))
    return df.groupBy("book_id").agg(F.array_join(F.transform(rows, lambda r: r["x"]), sep).alias(name))


def _toc_item(filename: Column, title: Column) -> Column:
    return F.concat(F.lit('<li><a href="'), filename, F.lit('">'), text.xml_escape(title), F.lit("</a></li>"))


def toc(found: DataFrame) -> DataFrame:
    """(book_id, toc): the navigation list; the cover is not in it."""
    return _listing(found.where(F.col("filename") != "cover.xhtml"), _toc_item(F.col("filename"), F.col("title")), "chapter_no", "\n", "toc")


def _stem(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^.]*$", "")


def _chapter_item(filename: Column) -> Column:
    return F.concat(F.lit('<item id="'), _stem(filename), F.lit('" href="'), filename, F.lit('" media-type="application/xhtml+xml"/>'))


def _image_item(name: Column) -> Column:
    return F.concat(F.lit('<item id="img_'), _stem(name), F.lit('" href="images/'), name, F.lit('" media-type="'), formats.media_type(name), F.lit('"/>'))


def manifest(found: DataFrame, images: DataFrame) -> DataFrame:
    """(book_id, kind, item) for chapters and images (book_id, name); image ids have a prefix, so ids are unique."""
    pages = found.select("book_id", F.lit("chapter").alias("kind"), _chapter_item(F.col("filename")).alias("item"))
    return union(pages, images.select("book_id", F.lit("image").alias("kind"), _image_item(F.col("name")).alias("item")))


def _spine_item(filename: Column) -> Column:
    return F.concat(F.lit('<itemref idref="'), _stem(filename), F.lit('"/>'))


def spine(found: DataFrame) -> DataFrame:
    return _listing(found, _spine_item(F.col("filename")), "chapter_no", "\n    ", "spine")


def _said(c: Column) -> Column:
    """A value that may be unknown, as text of a document."""
    return text.xml_escape(F.coalesce(c, F.lit("")))


def _nav(toc: Column, title: Column, heading: str) -> Column:
    page = (
        '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">\n<head><title>', _said(title),
        '</title><link rel="stylesheet" href="style.css"/></head>\n<body><nav epub:type="toc">\n', f"<h2>{heading}</h2>\n<ol>\n", toc, "\n</ol>\n</nav></body>\n</html>",
    )
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in page])


def nav_document(lists: DataFrame, heading: str = "Contents") -> DataFrame:
    """(book_id, content) of the navigation document from (book_id, toc) and, if there, the title of each book."""
    return lists.select("book_id", _nav(F.col("toc"), F.col("title" if "title" in lists.columns else "book_id"), heading).alias("content"))


def cover_document() -> str:
    """The page that shows images/cover.webp."""
    return (
        '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml">\n<head><title>Cover</title><link rel="stylesheet" href="style.css"/></head>\n'
        f'<body class="cover"><img src="images/cover.webp" alt="Cover" style="{text.IMAGE_STYLE}" /></body>\n</html>'
    )


def _of_book(df: DataFrame, name: str, *cols: str) -> DataFrame:
    return df.groupBy("book_id").agg(F.collect_list(F.struct(*cols)).alias(name))


def entries(meta: DataFrame, found: DataFrame, images: DataFrame, covers: DataFrame) -> DataFrame:
    """(book_id, entry_path, text, content) of all that a package holds beside its fixed entries: chapters as Markdown, the
    navigation and package documents, images and, for books that have one, the cover's page and image.

    meta (book_id, title, author, language); found chapters (see explode_chapters); images and covers (book_id, name,
    content), a cover's name being any. Each table is read once and becomes one row a book; chapters are joined last, so that
    those dealt by book are not dealt again."""
    whole = _of_book(meta, "meta", "title", "author", "language")
    for df, name, cols in ((images, "images", ("name", "content")), (covers, "covers", ("content",)), (found, "chapters", ("chapter_no", "title", "filename", "body"))):
        whole = whole.join(_of_book(df, name, *cols), "book_id", "full")
    have = lambda c: F.coalesce(F.col(c), F.array())
    whole = whole.select("book_id", *[have(c).alias(c) for c in ("meta", "images", "covers", "chapters")])

    cover = lambda f: F.transform("covers", lambda _: f)
    joined = lambda rows, sep: F.array_join(F.transform(F.array_sort(rows), lambda r: r["x"]), sep)
    placed = lambda no, x: F.struct(no.alias("o"), x.alias("x"))
    first, page = F.lit(-1).cast("long"), F.lit("cover.xhtml")
    shown = F.filter("chapters", lambda c: c["filename"] != "cover.xhtml")
    toc_ = joined(F.transform(shown, lambda c: placed(c["chapter_no"], _toc_item(c["filename"], c["title"]))), "\n")
    spine_ = joined(F.concat(cover(placed(first, _spine_item(page))), F.transform("chapters", lambda c: placed(c["chapter_no"], _spine_item(c["filename"])))), "\n    ")
    chapter, image = F.lit("chapter"), F.lit("image")
    manifest_ = joined(F.concat(
        cover(placed(chapter, _chapter_item(page))), F.transform("chapters", lambda c: placed(chapter, _chapter_item(c["filename"]))),
        cover(placed(image, _image_item(F.lit("cover.webp")))), F.transform("images", lambda i: placed(image, _image_item(i["name"])))), "\n")
    whole = whole.select("*", toc_.alias("toc"), spine_.alias("spine"), manifest_.alias("manifest"))

    def entry(path: Column, text: Column | None = None, content: Column | None = None) -> Column:
        text, content = F.lit(None).cast("string") if text is None else text, F.lit(None).cast("binary") if content is None else content
        return F.struct(F.concat(F.lit("OEBPS/"), path).alias("entry_path"), text.alias("text"), content.alias("content"))

    every = F.concat(
        F.transform("chapters", lambda c: entry(F.regexp_replace(c["filename"], r"\.xhtml$", ".md"), c["body"])),
        F.transform("meta", lambda m: entry(F.lit("nav.xhtml"), _nav(F.col("toc"), m["title"], "Contents"))),
        F.transform("meta", lambda m: entry(F.lit("content.opf"), _package(F.col("book_id"), m["title"], m["author"], m["language"], F.col("manifest"), F.col("spine")))),
        cover(entry(page, F.lit(cover_document()))), F.transform("covers", lambda c: entry(F.lit("images/cover.webp"), content=c["content"])),
        F.transform("images", lambda i: entry(F.concat(F.lit("images/"), i["name"]), content=i["content"])))
    return whole.select("book_id", F.explode(every).alias("e")).select("book_id", "e.*")


MODIFIED = "2026-07-06T00:00:00Z"


def _package(book_id: Column, title: Column, author: Column, language: Column, manifest: Column, spine: Column, modified: str = MODIFIED) -> Column:
    e = _said
    md5 = F.md5(F.coalesce(book_id, F.lit("")).cast("binary"))
    urn = F.concat_ws("-", *[F.substring(md5, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="bookid">\n<metadata xmlns:dc="http://purl.org/dc/elements/1.1/">\n<dc:identifier id="bookid">urn:uuid:'),
        urn, F.lit("</dc:identifier>\n<dc:title>"), e(title), F.lit("</dc:title>\n<dc:creator>"), e(author), F.lit("</dc:creator>\n<dc:language>"), e(language),
        F.lit(f'</dc:language>\n<meta property="dcterms:modified">{modified}</meta>\n</metadata>\n<manifest>\n<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>\n<item id="css" href="style.css" media-type="text/css"/>\n'),
        manifest, F.lit("\n</manifest>\n<spine>\n"), spine, F.lit("\n</spine>\n</package>"))


def package_document(meta: DataFrame, modified: str = MODIFIED) -> DataFrame:
    """(book_id, content) of the package document from (book_id, title, author, language, manifest, spine). The identifier
    is a hash of the book's id, so that a book built again is the same."""
    parts = [F.col(c) for c in ("book_id", "title", "author", "language", "manifest", "spine")]
    return meta.select("book_id", _package(*parts, modified).alias("content"))


def zip_boxes(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pages (book_id, page_num, stem) and lists of boxes (book_id, page_num, boxes) of one place: a row for each box with the
    name of its cut; boxes without a label are numbered."""
    rows = pages.join(boxes, ["book_id", "page_num"]).select("book_id", "page_num", "stem", F.posexplode("boxes").alias("pos", "b"))
    label = F.when(F.col("b.label") == "", F.concat(F.lit("asset"), F.lpad(F.col("pos").cast("string"), 2, "0"))).otherwise(F.col("b.label"))
    return rows.select("book_id", "page_num", F.col("pos").cast("long").alias("pos"), F.concat("stem", F.lit("_"), label, F.lit(".png")).alias("name"))


def top_by_name(df: DataFrame, n: int = 3) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("book_id").orderBy("name"))
    return df.withColumn("rank", nth).where(F.col("rank") <= n)


def cuts(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """(book_id, page_num, pos, name, box): the pixel boxes of pages (book_id, page_num, name, w, h) that are large enough to cut
    out, by lists of boxes (book_id, page_num, boxes) in the model's square; a cut is named after its page and label."""
    rows = pages.join(boxes, ["book_id", "page_num"]).select("book_id", "page_num", "name", "w", "h", F.posexplode("boxes").alias("pos", "b"))
    box = geometry.denormalize(F.col("b.x1"), F.col("b.y1"), F.col("b.x2"), F.col("b.y2"), F.col("w"), F.col("h"))
    label = F.when(F.col("b.label") == "", "_bbox").otherwise(F.concat(F.lit("_bbox_"), "b.label"))
    name = F.concat(_stem(F.col("name")), label, F.regexp_extract("name", r"\.[^.]*$", 0))
    return rows.select("book_id", "page_num", F.col("pos").cast("long").alias("pos"), name.alias("name"), box.alias("box")).where(geometry.large_enough(F.col("box")))


def existing(images: DataFrame, files: DataFrame) -> DataFrame:
    return images.join(files, ["book_id", "name"], "left_semi")


def missing_shards(index: DataFrame, cached: DataFrame) -> DataFrame:
    """(model, n_shards, n_missing) from index rows (model, shard), repeated or not, and cached (model, shard)."""
    need = index.select("model", "shard").distinct()
    lost = need.join(cached, ["model", "shard"], "left_anti").groupBy("model").agg(F.count("*").alias("n_missing"))
    return need.groupBy("model").agg(F.count("*").alias("n_shards")).join(lost, "model", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)).cast("long"))


def model_status(models: DataFrame, index: DataFrame, cached: DataFrame, config: str = "config.json", single: str = "model.safetensors") -> DataFrame:
    """(model, ok, message) of models (model) by what is cached (model, shard): without its settings a model is absent; one
    with an index (model, shard) needs every file of that, any other its single file."""
    own = cached.groupBy("model").agg(F.bool_or(F.col("shard") == config).alias("has_config"), F.bool_or(F.col("shard") == single).alias("has_single"))
    known = models.select("model").distinct().join(own, "model", "left").join(missing_shards(index, cached), "model", "left")
    ready = (F.col("n_missing") == 0) | F.col("has_single")
    message = F.when(~F.coalesce("has_config", F.lit(False)), "absent").when(F.col("n_missing") > 0, "incomplete").when(ready, "ready").otherwise("absent")
    return known.select("model", message.alias("message")).select("model", (F.col("message") == "ready").alias("ok"), "message")


def with_metadata(found: DataFrame, given: DataFrame, chapter_pages: int | None = None) -> DataFrame:
    """Books (book_id, stem) with what is given for them (book_id, title, author, language, chapter_pages); a book without a
    title takes its stem, chapter_pages given here goes before a book's own."""
    own = given.select("book_id", "title", "author", "language", C_PAGES)
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    return found.join(own, "book_id", "left").select(
        "book_id", F.coalesce(blank("title"), "stem").alias("title"), F.coalesce(blank("author"), F.lit("Unknown")).alias("author"),
        F.coalesce(blank("language"), F.lit("it")).alias("language"), F.coalesce(F.lit(chapter_pages).cast("int"), C_PAGES).alias(C_PAGES),
    )

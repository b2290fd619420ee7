"""Queries over the document-to-book operators, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import chapters, formats, geometry, markup, text
from quire.oracles import ORACLES  # noqa: F401
from quire.operators import books, progress, wheels
from quire.plans import book, fixtures
from quire.sources import package, state
from quire.streaming import tokens

QUERIES = {}
C = F.col


def query(f):
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.table_of_contents(fixtures.pages(spark, sf_dir))


@query
def clean_text(spark, d):
    c = text.clean_text(C("raw_text"))
    return fixtures.pages(spark, d).select("doc_id", c.alias("cleaned"), F.char_length(c).cast("long").alias("n_chars"))


@query
def clean_text_flags(spark, d):
    plain = text.clean_text(C("raw_text"), fix_hyphenation=False, normalize_quotes=False)
    return fixtures.pages(spark, d).select("doc_id", plain.alias("plain"), text.clean_text(C("raw_text"), fix_hyphenation=False).alias("quotes_only"))


@query
def count_words(spark, d):
    return _read(spark, d, "documents").select("doc_id", text.count_words(C("text")).alias("n_words"))


@query
def strip_placeholders(spark, d):
    return fixtures.pages(spark, d).select("doc_id", text.strip_placeholders(C("raw_text")).alias("stripped"))


@query
def parse_tags(spark, d):
    rows = fixtures.pages(spark, d).select("doc_id", F.posexplode(markup.tags(C("raw_text"))).alias("pos", "t"))
    return rows.select("doc_id", C("pos").cast("long").alias("pos"), "t.*")


@query
def box_from_string(spark, d):
    return fixtures.pages(spark, d).select("doc_id", markup.box_from_string(C("raw_text")).alias("b")).select("doc_id", "b.*")


@query
def parse_bbox_legacy(spark, d):
    only = F.regexp_extract(C("raw_text"), markup.BBOX, 0)
    return fixtures.pages(spark, d).where(only != "").select("doc_id", markup.box_from_string(only).alias("b")).select("doc_id", "b.*")


@query
def bbox_metrics(spark, d):
    x1, y1, x2, y2 = C("x1"), C("y1"), C("x2"), C("y2")
    return fixtures.boxes(spark, d).select("k", "n", geometry.width(x1, x2).alias("width"), geometry.width(y1, y2).alias("height"), geometry.area(x1, y1, x2, y2).alias("area"))


def _pixel_boxes(spark, d):
    return fixtures.boxes(spark, d).withColumn("b", geometry.denormalize(C("x1"), C("y1"), C("x2"), C("y2"), C("w"), C("h")))


@query
def denormalize_bbox(spark, d):
    return _pixel_boxes(spark, d).select("k", "n", "b.*")


@query
def crop_filter(spark, d):
    return _pixel_boxes(spark, d).where(geometry.large_enough(C("b"))).select("k", "n", geometry.width_percent(C("x1"), C("x2")).alias("percent"))


@query
def square_normalize(spark, d):
    return fixtures.boxes(spark, d).select("k", "n", geometry.square(C("w"), C("h")).alias("s")).select("k", "n", "s.*")


@query
def batch_pages(spark, d):
    return books.batches(fixtures.pages(spark, d)).select("book_id", "page_num", "batch_id", "batch_start", "batch_end", "percent")


def _raw_batches(spark, d):
    """Batches with a segment too many or some missing."""
    placed = books.batches(fixtures.pages(spark, d))
    rows = F.array_sort(F.collect_list(F.when(C("doc_id") % 37 != 5, F.struct("page_num", C("raw_text").alias("t")))))
    joined = F.array_join(F.transform(rows, lambda r: r["t"]), "<PAGE>")
    extra = F.when(C("batch_id") % 3 == 1, F.lit("<page>surplus")).otherwise("")
    return placed, placed.groupBy("book_id", "batch_id").agg(F.concat(F.lit(" <page>"), joined, extra).alias("raw_text"))


@query
def split_pages(spark, d):
    return books.segments(_raw_batches(spark, d)[1]).select("book_id", "batch_id", C("idx").cast("long").alias("idx"), "segment")


@query
def page_segment_join(spark, d):
    placed, raw = _raw_batches(spark, d)
    return books.join_segments(placed.drop("raw_text"), books.segments(raw)).select("doc_id", "segment")


@query
def layout_wrap(spark, d):
    return fixtures.pages(spark, d).select("doc_id", markup.wrap_layout(C("raw_text")).alias("wrapped"))


@query
def tag_rewrite(spark, d):
    return fixtures.pages(spark, d).select("doc_id", markup.rewrite_tags(C("raw_text"), C("page_num"), C("w"), C("h")).alias("md"))


@query
def asset_names(spark, d):
    rows = fixtures.pages(spark, d).select("doc_id", F.explode(markup.assets(C("raw_text"), C("page_num"), C("w"), C("h"))).alias("a"))
    return rows.select("doc_id", "a.number", "a.label", "a.name", "a.kept")


@query
def page_markdown(spark, d):
    return fixtures.pages(spark, d).select("doc_id", books.page_markdown(C("raw_text"), C("page_num"), C("w"), C("h")).alias("md"))


def _books(spark, d):
    """Books of pages with headings before their whole texts."""
    head = F.when(C("page_num") % 4 == 1, F.concat(F.lit("# Chapter "), C("page_num").cast("string"), F.lit(" \n\n"))).when(C("page_num") % 4 == 3, F.concat(F.lit("## Part "), C("page_num").cast("string"), F.lit("\n\n"))).otherwise("")
    body = F.when(C("doc_id") % 29 == 3, F.lit("  ")).otherwise(F.concat(head, C("raw_text")))
    return books.assemble(fixtures.pages(spark, d).withColumn("md", body))


@query
def assemble_book(spark, d):
    return _books(spark, d)


def _chapters(spark, d, split):
    return books.explode_chapters(_books(spark, d), split)


@query
def chapters_h1(spark, d):
    return _chapters(spark, d, chapters.by_heading(C("markdown"), chapters.H1))


@query
def chapters_h2(spark, d):
    return _chapters(spark, d, chapters.by_heading(C("markdown"), chapters.H2))


@query
def chapters_grouped(spark, d):
    return _chapters(spark, d, chapters.by_pages(C("markdown"), 7))


@query
def chapters_legacy(spark, d):
    return _chapters(spark, d, chapters.by_break(C("markdown")))


@query
def chapters_adaptive(spark, d):
    return _chapters(spark, d, chapters.adaptive(C("markdown")))


def _listed(spark, d):
    covers = fixtures.pages(spark, d).where("page_num = 1 and w % 2 = 0").select("book_id")
    return books.with_cover(chapters_adaptive(spark, d), covers)


@query
def toc(spark, d):
    return books.toc(_listed(spark, d))


@query
def spine(spark, d):
    return books.spine(_listed(spark, d))


def _images(spark, d):
    name = F.concat(F.lit("page"), F.lpad(C("page_num").cast("string"), 4, "0"), F.lit("_figure0."), F.when(C("doc_id") % 2 == 0, "webp").otherwise("png"))
    return fixtures.pages(spark, d).where("doc_id % 3 = 0").select("book_id", "doc_id", name.alias("name"))


@query
def manifest(spark, d):
    return books.manifest(_listed(spark, d), _images(spark, d))


@query
def xml_escape(spark, d):
    return _read(spark, d, "pages").select("page_id", text.xml_escape(C("html")).alias("escaped"))


@query
def responsive_images(spark, d):
    img = F.concat(F.lit("<body><img src=\"a.png\"/><img src='b.png' ><img style=\"max-width:100%\" src=\"c.png\">"))
    return _read(spark, d, "pages").select("page_id", text.responsive_images(F.replace(C("html"), F.lit("<body>"), img)).alias("html"))


@query
def result_summary(spark, d):
    return book.summary(fixtures.pages(spark, d))


@query
def page_separators(spark, d):
    return _raw_batches(spark, d)[1].select("book_id", "batch_id", text.page_separators(C("raw_text")).alias("separators"))


def _chunks(spark, d):
    return _read(spark, d, "conversations").select(C("conv_id").alias("stream_id"), C("turn").alias("seq"), F.when(C("turn") % 5 == 4, "").otherwise(C("text")).alias("chunk"))


@query
def token_stream_prefix(spark, d):
    return progress.prefixes(_chunks(spark, d)).select("stream_id", "seq", "text", text.tail(C("text")).alias("tail"))


@query
def token_stream_final(spark, d):
    return progress.final(_chunks(spark, d))


def _statuses(spark, d):
    """All streams, and as many again that say nothing."""
    said = _chunks(spark, d)
    return progress.statuses(said.select("stream_id").union(said.select(C("stream_id") + 1_000_000)), said)


@query
def token_status(spark, d):
    return _statuses(spark, d)


@query
def token_result(spark, d):
    return progress.readings(_statuses(spark, d))


@query
def token_stream(spark, d):
    src = spark.readStream.schema(_read(spark, d, "conversations").schema).parquet(f"{d}/conversations.parquet*")
    chunks = src.select(C("conv_id").alias("stream_id"), C("turn").alias("seq"), F.when(C("turn") % 5 == 4, "").otherwise(C("text")).alias("chunk"))
    return tokens.drain(tokens.accumulate(chunks), "tokens")


@query
def latest_state(spark, d):
    return progress.latest(fixtures.log(spark, d))


@query
def phase_coverage(spark, d):
    return progress.phase_coverage(fixtures.log(spark, d))


@query
def job_elapsed(spark, d):
    return progress.elapsed(fixtures.log(spark, d))


@query
def stall_watchdog(spark, d):
    return progress.stalls(fixtures.log(spark, d)).select("job_id", "seq")


@query
def stall_stream(spark, d):
    src = spark.readStream.schema(_read(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    log = src.select(C("user_id").alias("job_id"), C("event_id").alias("seq"), C("ts").cast("timestamp").alias("ts"), C("event_type").alias("phase"))
    return tokens.drain(tokens.stalls(log), "stalls")


@query
def transient_filter(spark, d):
    return progress.persistent(fixtures.log(spark, d)).select("job_id", "seq", "phase")


@query
def format_event(spark, d):
    return fixtures.log(spark, d).select("seq", formats.format_event(C("phase"), C("message"), C("total"), C("percent")).alias("line"))


@query
def state_json_defaults(spark, d):
    doc = F.when(C("seq") % 4 == 0, F.lit("not json")).when(C("seq") % 4 == 1, C("props")).otherwise(F.concat(F.lit('{"phase": "'), C("phase"), F.lit('", "downloaded_bytes": '), C("seq").cast("string"), F.lit(', "speed_bps": 1.5}')))
    return fixtures.log(spark, d).select("seq", state.parse(doc).alias("s")).select("seq", "s.*")


@query
def progress_percent(spark, d):
    phase = F.when(C("seq") % 5 == 0, "done").when(C("seq") % 5 == 1, "error").when(C("seq") % 5 == 2, "verify").when(C("seq") % 5 == 3, "extract").otherwise("download_wheel")
    return fixtures.log(spark, d).select("seq", formats.progress_percent(phase, C("percent"), C("total")).alias("shown"))


@query
def wheel_asof(spark, d):
    dev = _read(spark, d, "lineitem").select((C("l_partkey") % 14).cast("int").alias("major"), (C("l_suppkey") % 10).cast("int").alias("minor"), (C("l_linenumber") + 8).cast("int").alias("driver_major")).distinct()
    dev = dev.withColumn("device", F.concat_ws("/", "major", "minor", "driver_major"))
    return wheels.select(dev, wheels.table(spark))


@query
def parse_devices(spark, d):
    line = F.concat_ws(", ", F.concat(F.lit("GPU "), C("l_suppkey").cast("string")), F.concat(F.lit("5"), (C("l_partkey") % 50).cast("string")), F.when(C("l_linenumber") == 1, "n/a").otherwise(F.concat_ws(".", (C("l_partkey") % 14).cast("string"), (C("l_suppkey") % 10).cast("string"))))
    return wheels.parse_devices(_read(spark, d, "lineitem").select(line.alias("line"))).distinct()


@query
def first_cached(spark, d):
    return wheels.first_cached(_images(spark, d).select(C("book_id").alias("folder"), "name"), "page%.webp")


def _events(spark, d):
    pages = fixtures.pages(spark, d)
    kept = F.size(F.filter(markup.assets(C("raw_text"), C("page_num"), C("w"), C("h")), lambda x: x["kept"]))
    crops = pages.where("book_id not like '%-0'").groupBy("book_id").agg(F.sum(kept).alias("crops"))  # some books have none
    partial = _raw_batches(spark, d)[1].select("book_id", "batch_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("part"), "raw_text")
    partial = partial.select("book_id", "batch_id", "part", F.substring(C("raw_text"), F.lit(1), (C("part") + 1) * 450).alias("text"))
    return progress.run_events(books.batches(pages.drop("raw_text")), crops, partial=partial)


@query
def run_events(spark, d):
    return _events(spark, d)


@query
def run_result(spark, d):
    return progress.results(_events(spark, d).where("phase <> 'done' or total % 3 > 0"), strict=False)


@query
def format_event_line(spark, d):
    line = formats.format_event_line(C("phase"), C("message"), C("total"), C("percent"), (C("seq") % 4000).cast("double"))
    return fixtures.log(spark, d).select("seq", line.alias("line"))


@query
def model_status(spark, d):
    files = fixtures.pages(spark, d).select(C("book_id").alias("model"), F.concat(F.lit("shard"), (C("doc_id") % 9).cast("string")).alias("shard"), "doc_id", "page_num")
    index = files.where("doc_id % 1000 < 500 and model like 'src1%'").select("model", "shard")
    config = files.where("page_num = 1 and doc_id % 5 > 0").select("model", F.lit("config.json"))
    single = files.where("page_num = 1 and doc_id % 3 > 0").select("model", F.lit("model.safetensors"))
    return books.model_status(files, index, files.where("doc_id % 7 > 0 or doc_id % 2 = 0").select("model", "shard").union(config).union(single))


@query
def cut_boxes(spark, d):
    pages = fixtures.pages(spark, d).withColumn("name", F.concat(F.lit("page"), F.lpad(C("page_num").cast("string"), 4, "0"), F.lit(".png")))
    found = books.cuts(pages.select("book_id", "page_num", "name", "w", "h"), pages.select("book_id", "page_num", markup.tags(C("raw_text")).alias("boxes")))
    return found.select("book_id", "page_num", "pos", "name", "box.*")


@query
def book_metadata(spark, d):
    found = fixtures.pages(spark, d).select("book_id").distinct().select("book_id", F.concat(F.lit("file "), "book_id").alias("stem"))
    given = fixtures.pages(spark, d).where("page_num = 1 and doc_id % 3 > 0").select("book_id", F.when(C("doc_id") % 3 == 1, " ").otherwise(F.concat(F.lit("Title "), C("doc_id").cast("string"))).alias("title"), F.lit("A. Author").alias("author"), F.lit("").alias("language"), (C("doc_id") % 9).cast("int").alias("chapter_pages"))
    return books.with_metadata(found, given)


@query
def carried_state(spark, d):
    log = fixtures.log(spark, d).withColumn("shown", F.when(C("phase") == "view", C("percent"))).withColumn("bought", F.when(C("phase") == "purchase", C("seq")))
    return progress.carried(log, ["shown", "bought"])


@query
def chapter_title(spark, d):
    title = F.when(C("page_id") % 4 == 0, "").otherwise(F.concat(F.lit("Page $1 & "), C("page_id").cast("string")))
    return _read(spark, d, "pages").select("page_id", text.chapter_title(C("html"), title).alias("html"))


@query
def thumbnails_top3(spark, d):
    return books.top_by_name(_images(spark, d)).select("book_id", "name", C("rank").cast("long").alias("rank"))


@query
def image_semi_join(spark, d):
    found = _images(spark, d)
    return books.existing(found, found.where("doc_id % 2 = 0").select("book_id", "name")).select("book_id", "name")


@query
def shard_anti_join(spark, d):
    index = fixtures.pages(spark, d).select(C("book_id").alias("model"), F.concat(F.lit("shard"), (C("doc_id") % 9).cast("string")).alias("shard"), "doc_id")
    return books.missing_shards(index, index.where("doc_id % 9 < 7").select("model", "shard"))


@query
def page_box_zip(spark, d):
    pages = fixtures.pages(spark, d).select("book_id", "page_num", F.concat(F.lit("page"), C("page_num").cast("string")).alias("stem"), "raw_text")
    return books.zip_boxes(pages.drop("raw_text"), pages.select("book_id", "page_num", markup.tags(C("raw_text")).alias("boxes")))


def _amounts(spark, d):
    return _read(spark, d, "lineitem").select(C("l_orderkey").alias("k"), C("l_linenumber").alias("n"), (C("l_orderkey") * C("l_partkey") * C("l_suppkey") * 8).cast("double").alias("v"))


@query
def human_bytes(spark, d):
    return _amounts(spark, d).select("k", "n", formats.human_bytes(F.floor(C("v") / 1024) * 1024).alias("shown"))


@query
def human_speed(spark, d):
    return _amounts(spark, d).select("k", "n", formats.human_speed(C("v") / 7).alias("shown"))


@query
def download_eta(spark, d):
    done, total, elapsed = C("n").cast("double") * 64, (C("k") % 9).cast("double") * 1024, (C("k") % 5).cast("double")
    return _amounts(spark, d).select("k", "n", formats.speed(done, elapsed).alias("speed"), formats.eta(done, total, elapsed).alias("eta"))


@query
def format_eta(spark, d):
    return _amounts(spark, d).select("k", "n", formats.format_eta((C("v") % 200000) - 100).alias("shown"))


@query
def device_and_window(spark, d):
    free = (C("k") % 17).cast("double")
    asked = F.when(C("k") % 3 == 0, "cpu").otherwise("auto")
    return _amounts(spark, d).select("k", "n", formats.resolve_device(asked, free).alias("device"), formats.ngram_window(C("n")).cast("long").alias("ngrams"), formats.ratio(C("n").cast("double"), (C("k") % 4).cast("double")).alias("ratio"))


@query
def book_toc(spark, d):
    return flagship(spark, d)


def _entries(spark, d):
    """Package entries; the bytes of an image are made of its name, as the test tables hold no images."""
    pages = fixtures.pages(spark, d)
    found = books.explode_chapters(book.markdown(pages), chapters.adaptive(C("cleaned")))
    pics = pages.select("book_id", F.explode(markup.assets(markup.wrap_layout(C("raw_text")), C("page_num"), C("w"), C("h"))).alias("a")).where("a.kept")
    covers = pages.where("page_num = 1 and w % 2 = 0").select("book_id", F.encode("book_id", "UTF-8").alias("content"))
    meta = pages.select("book_id").distinct().select("book_id", C("book_id").alias("title"), F.lit("Unknown").alias("author"), F.lit("it").alias("language"))
    return books.entries(meta, found, pics.select("book_id", "a.name", F.encode("a.name", "UTF-8").alias("content")), covers)


@query
def epub_entries(spark, d):
    return _entries(spark, d).select("book_id", "entry_path", F.length("content").cast("long").alias("n_bytes"))


@query
def epub_package(spark, d):
    done = package.packages(_entries(spark, d))
    return done.select("book_id", "n_entries", F.length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))

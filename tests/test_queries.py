"""Every query against its DuckDB counterpart, and the plans that matter."""

import glob
import io
import os
import zipfile
from xml.etree import ElementTree

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire import queries as core
from quire.functions import chapters, markup
from quire.operators import books, progress
from quire.plans import book, fixtures
from quire.sources import adapters, package, state
from quire.streaming import tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(x):
    return "-" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(cols, data):
    return sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in data)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_oracle(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    want = duck.sql(core.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(core.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_stays_in_the_engine(spark):
    for name in ("clean_text", "tag_rewrite", "page_markdown", "denormalize_bbox", "book_toc"):
        assert "Python" not in _plan(core.QUERIES[name](spark, SF)), name


def test_assembly_shuffles_once(spark):
    pages = spark.createDataFrame([("b", 1, "x")], "book_id string, page_num int, md string")
    found = books.explode_chapters(books.assemble(pages), chapters.adaptive(F.col("markdown")))
    assert _plan(found).count("Exchange") == 1


def test_packages(spark):
    rows = [("b", "OEBPS/chap_0000.md", "# T\n\nx & y\n\n<img src='a.webp'/ >", None), ("b", "OEBPS/content.opf", "<package/>", None), ("b", "OEBPS/images/a.webp", None, b"\x00pic")]
    entries = spark.createDataFrame(rows, "book_id string, entry_path string, text string, content binary")
    a, b = (package.packages(entries).first().content for _ in range(2))
    assert a == b
    z = zipfile.ZipFile(io.BytesIO(a))
    assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert {"META-INF/container.xml", "OEBPS/content.opf", "OEBPS/chap_0000.xhtml"} <= set(z.namelist())
    page = z.read("OEBPS/chap_0000.xhtml")
    assert b"<h1>T</h1>" in page and b"x &amp; y" in page and b"<img  src='a.webp' style=\"max-width:100%; height:auto; display:block; margin:1em auto;\" />" in page
    assert z.read("OEBPS/images/a.webp") == b"\x00pic"


def test_package_holds_what_its_manifest_lists(spark):
    for r in package.packages(core._entries(spark, SF)).limit(3).collect():
        z = zipfile.ZipFile(io.BytesIO(r.content))
        assert z.testzip() is None and len(set(z.namelist())) == r.n_entries
        opf = ElementTree.fromstring(z.read("OEBPS/content.opf"))
        space = "{http://www.idpf.org/2007/opf}"
        listed = {x.get("href"): x.get("id") for x in opf.iter(f"{space}item")}
        assert {f"OEBPS/{x}" for x in listed} | {"mimetype", "META-INF/container.xml", "OEBPS/content.opf"} == set(z.namelist())
        assert len(set(listed.values())) == len(listed) and {x.get("idref") for x in opf.iter(f"{space}itemref")} <= set(listed.values())
        if "cover.xhtml" in listed:
            assert "images/cover.webp" in listed and next(opf.iter(f"{space}itemref")).get("idref") == "cover"
            ElementTree.fromstring(z.read("OEBPS/cover.xhtml"))
        nav = z.read("OEBPS/nav.xhtml").decode()
        ElementTree.fromstring(nav)
        assert "cover.xhtml" not in nav and all(f'href="{x}"' in nav for x in listed if x.startswith("chap_"))


def test_packages_without_broadcasts(spark):
    """Tables too large to be broadcast meet by sort-merge joins, which rest on how the unions below them are dealt."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        listed = {(r.book_id, r.n) for r in core.epub_entries(spark, SF).groupBy("book_id").agg(F.count("*").alias("n")).collect()}
        got = core.epub_package(spark, SF).collect()
    finally:
        spark.conf.set(key, before)
    # the type, container and style entries come on top
    assert {(r.book_id, r.n_entries - 3) for r in got} == listed and len(got) == len(listed)


def test_packages_make_their_chapters_once(spark):
    plan = _plan(core.epub_package(spark, SF))
    assert plan.count("FileScan") <= 4  # meta, chapters, images, covers


def test_entries_of_odd_books(spark):
    """Books that only some tables know, and one that is described twice, lose nothing."""
    meta = spark.createDataFrame([("a", "A & B", "x", "it"), ("b", "B", "x", "it"), ("b", "B2", "x", "it")], "book_id string, title string, author string, language string")
    found = spark.createDataFrame([("a", 1, "T2", "chap_0001.xhtml", "y"), ("a", 0, "T1", "chap_0000.xhtml", "x"), ("c", 0, "T", "chap_0000.xhtml", "z")], "book_id string, chapter_no long, title string, filename string, body string")
    images = spark.createDataFrame([("a", "p.png", b"1"), ("d", "q.webp", b"2")], "book_id string, name string, content binary")
    covers = spark.createDataFrame([("a", b"3"), ("e", b"4")], "book_id string, content binary")
    got = books.entries(meta, found, images, covers).collect()
    names = sorted((r.book_id, r.entry_path.removeprefix("OEBPS/")) for r in got)
    assert names == [("a", x) for x in ("chap_0000.md", "chap_0001.md", "content.opf", "cover.xhtml", "images/cover.webp", "images/p.png", "nav.xhtml")] + [
        ("b", "content.opf"), ("b", "content.opf"), ("b", "nav.xhtml"), ("b", "nav.xhtml"), ("c", "chap_0000.md"), ("d", "images/q.webp"), ("e", "cover.xhtml"), ("e", "images/cover.webp")]
    text = {r.entry_path: r.text for r in got if r.book_id == "a"}
    assert "<title>A &amp; B</title>" in text["OEBPS/nav.xhtml"] and text["OEBPS/nav.xhtml"].index("T1") < text["OEBPS/nav.xhtml"].index("T2") and "cover" not in text["OEBPS/nav.xhtml"]
    opf = text["OEBPS/content.opf"]
    assert opf.count("<item ") == 7 and opf.index('idref="cover"') < opf.index('idref="chap_0000"') < opf.index('idref="chap_0001"')


def test_package_of_pages_without_a_source(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.col("source")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.book_id: r.n_entries for r in core.epub_package(spark, str(tmp_path)).collect()}
    listed = core.epub_entries(spark, str(tmp_path)).groupBy("book_id").agg(F.count_distinct("entry_path").alias("n")).collect()
    assert None in got and got == {r.book_id: r.n + 3 for r in listed}
    whole = [r.content for r in package.packages(core._entries(spark, str(tmp_path))).collect() if r.book_id is None]
    for name in ("OEBPS/nav.xhtml", "OEBPS/content.opf"):
        ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(whole[0])).read(name))


def test_surplus_and_missing_segments(spark):
    pages = spark.createDataFrame([("b", i, i) for i in (1, 2, 3)], "book_id string, page_num int, doc_id int")
    placed = books.batches(pages, 2)
    raw = spark.createDataFrame([("b", 0, " <PAGE>one<page>two<Page>surplus"), ("b", 1, "")], "book_id string, batch_id long, raw_text string")
    got = {r.page_num: r.segment for r in books.join_segments(placed, books.segments(raw)).collect()}
    assert got == {1: "one", 2: "two", 3: ""}


def test_end_to_end_with_one_segment(spark):
    text = "# Capitolo Fake\n\nParagraph <|det|>figure[100, 100, 500, 500]<|/det|>"
    pages = spark.createDataFrame([("b", 1, 600, 800, text)], "book_id string, page_num int, w int, h int, raw_text string")
    md = book.markdown(pages).first().cleaned
    assert md.startswith("# Capitolo Fake") and "page0001_figure0.webp" in md


def test_adapters(spark, tmp_path):
    with pytest.raises(adapters.AdapterMissing):
        adapters.render(spark, str(tmp_path), None)

    class Two:
        def pages(self, pdf, dpi, target):
            yield 595.0, 842.0, pdf[:1], pdf[1:2]
            yield 595.0, 842.0, pdf[2:3], pdf[3:4]

    loads = spark.sparkContext.accumulator(0)

    class Join:
        def __init__(self):
            loads.add(1)

        def read_page(self, image, ngram_window):
            return f"{bytes(image).decode()} {ngram_window}"

        def read_pages(self, images, ngram_window):
            return "<page>" + "<page>".join(bytes(x).decode() for x in images) + f" {ngram_window}"

    (tmp_path / "a.pdf").write_bytes(b"abcd")
    pages = adapters.render(spark, str(tmp_path), lambda: Two())
    assert [(r.page_num, bytes(r.original)) for r in pages.orderBy("page_num").collect()] == [(1, b"a"), (2, b"c")]
    assert adapters.recognize(books.batches(pages), lambda: Join()).first().raw_text == "<page>b<page>d 1024"
    loads.value = 0
    many = spark.createDataFrame([("b", i, i, b"x") for i in range(40)], "book_id string, batch_id long, page_num int, normalized binary").coalesce(1)
    assert {r.raw_text for r in adapters.recognize(many, lambda: Join()).collect()} == {"x 128"}
    assert loads.value <= 4  # once in each task of the shuffle, not once a batch


class Pixels:
    """A codec of images that are text."""

    def cut(self, image, box):
        return f"{bytes(image).decode()}{tuple(box)}".encode()

    def encode(self, image, steps):
        return f"{bytes(image).decode()}|{','.join(f'{k}={v:g}' for k, v in steps)}".encode()


def test_cuts_and_images(spark):
    pages = spark.createDataFrame([("b", 1, "p1.png", 600, 800, b"one"), ("b", 2, "p2.png", 600, 800, b"two")], "book_id string, page_num int, name string, w int, h int, original binary")
    tags = "<|bbox|125|0|875|1000|fig|><|bbox|500|500|501|501|tiny|><|bbox|200|200|600|600|>"
    boxes = pages.where("page_num = 1").select("book_id", "page_num", markup.tags(F.lit(tags)).alias("boxes"))
    found = books.cuts(pages, boxes)
    got = {r.name: bytes(r.content).decode() for r in adapters.crop(pages, found, Pixels).collect()}
    assert got["p1_bbox_fig.png"] == "one(0, 0, 600, 800)" and set(got) == {"p1_bbox_fig.png", "p1_bbox.png"}
    with pytest.raises(adapters.AdapterMissing):
        adapters.crop(pages, found, None)
    pics = pages.select("book_id", "name", F.col("original").alias("content"))
    done = {r.name: r for r in adapters.optimize_images(pics, Pixels).collect()}
    assert bytes(done["p1.webp"].content) == b"one|grayscale=1,autocontrast=1,contrast=1.25,quality=80,method=6"
    assert done["p1.webp"].ratio == len(done["p1.webp"].content) / 3
    plain = adapters.PaperDisplay(grayscale=False, auto_contrast=False, contrast=1.0, lossless=True)
    assert {bytes(r.content) for r in adapters.optimize_images(pics, Pixels, plain).collect()} == {b"one|lossless=1", b"two|lossless=1"}


def test_silent_jobs_are_told(spark, tmp_path):
    log = [(1, 0, 0, "a"), (1, 1, 5, "a"), (1, 2, 30, "a"), (2, 3, 1, "a"), (3, 4, 2, "done"), (4, 5, 100, "a"), (5, 6, 2, "a"), (5, 7, 3, "error")]
    df = spark.createDataFrame(log, "job_id long, seq long, s long, phase string").select("job_id", "seq", F.timestamp_seconds("s").alias("ts"), "phase")
    assert {r.seq for r in progress.stalls(df).collect()} == {1, 2, 3}
    assert {r.seq for r in progress.stalls(df, now=F.timestamp_seconds(F.lit(111))).collect()} == {1, 2, 3, 5}
    df.write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/log")
    assert {r.seq for r in tokens.drain(tokens.stalls(stream), "silent").collect()} == {1, 2, 3}


def test_streams_end(spark):
    chunks = spark.createDataFrame([(1, 0, " <image>a"), (1, 1, ""), (1, 2, "b ")], "stream_id long, seq long, chunk string")
    got = progress.statuses(spark.createDataFrame([(1,), (2,)], "stream_id long"), chunks)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, " <image>a", "running"), (1, 2, " <image>ab ", "running"), (1, 3, " <image>ab ", "done"), (2, 0, "", "done")]
    assert sorted(tuple(r) for r in progress.readings(got).collect()) == [(1, "ab"), (2, "")]


def test_runs_report(spark):
    pages = spark.createDataFrame([("b", i) for i in range(1, 4)] + [("c", 1)], "book_id string, page_num int")
    crops = spark.createDataFrame([("b", 2)], "book_id string, crops long")
    events = progress.run_events(books.batches(pages, 2), crops)
    got = {}
    for r in events.orderBy("book_id", "seq").collect():
        got.setdefault(r.book_id, []).append((r.phase, r.current, r.total, r.percent))
    assert got["b"] == [
        ("rendering", 0, 0, 0.0), ("rendering", 3, 3, 100.0), ("ocr", 1, 3, pytest.approx(200 / 3)), ("ocr", 3, 3, 100.0), ("cleaning", 0, 0, 0.0), ("cropping", 2, 2, 100.0),
        ("optimizing", 0, 0, 0.0), ("compiling", 0, 0, 0.0), ("done", 3, 3, 100.0),
    ]
    assert "optimizing" not in [e[0] for e in got["c"]]  # nothing was cut
    assert sorted((r.book_id, r.pages) for r in progress.results(events).collect()) == [("b", 3), ("c", 1)]
    with pytest.raises(Exception, match="no result of c"):
        progress.results(events.where("book_id = 'b' or phase <> 'done'")).collect()


def test_latest_states(spark, tmp_path):
    schema = "job_id long, phase string, updated_at double"
    put = state.latest_sink(str(tmp_path / "s"))
    assert state.read_latest(spark, str(tmp_path / "s"), schema).count() == 0
    put(spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 1.0)], schema), 0)
    for _ in range(2):  # written again, it replaces itself
        put(spark.createDataFrame([(1, "late", 1.5), (2, "c", 3.0), (3, "a", 1.0)], schema), 1)
    assert sorted(tuple(r) for r in state.read_latest(spark, str(tmp_path / "s"), schema).select("job_id", "phase", "updated_at").collect()) == [(1, "b", 2.0), (2, "c", 3.0), (3, "a", 1.0)]


def test_state_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("j", '{"phase": "download", "total_bytes": 5}'), ("k", "broken"), ("l", None)], "job string, doc string")
    got = {r.job: r.s for r in df.select("job", state.parse(F.col("doc")).alias("s")).collect()}
    assert got["j"].phase == "download" and got["j"].total_bytes == 5 and got["k"].phase == got["l"].phase == "init"
    state.sink(str(tmp_path / "s"))(df.select("job"), 3)
    state.sink(str(tmp_path / "s"))(df.select("job"), 3)
    assert spark.read.json(str(tmp_path / "s")).count() == 3


def test_fixture_views_agree(spark, duck):
    got = {r.doc_id: r.raw_text for r in fixtures.pages(spark, SF).collect()}
    assert got == dict(duck.sql(f"select doc_id, raw_text from ({fixtures.for_oracle(fixtures.PAGES)})").fetchall())

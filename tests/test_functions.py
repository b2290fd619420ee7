import random

import pytest
from pyspark.sql import functions as F

from quire.functions import chapters, formats, geometry, markup, register, text
from quire.sources import config
from tests import specs

C = F.col


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first().x


def test_clean_vectors(spark):
    go = lambda t: one(spark, t, text.clean_text(C("t")))
    assert "paragraphia finale" in go("para-\ngraphia finale")
    assert go("a\n\n\n\n\nb") == "a\n\nb"
    assert go("‘a’ “b” «c»") == "'a' \"b\" \"c\""
    assert go("") == ""
    assert go(None) is None


def test_words(spark):
    assert one(spark, "uno due  tre ", text.count_words(C("t"))) == 3
    assert one(spark, "", text.count_words(C("t"))) == 0


def test_random_texts(spark):
    rng = random.Random(1)
    parts = ["-", " ", "\n", "\n", "\r", "\x1c", "“", "’", " ", "a", "b.", "\t", "<|det|>figure[1, 2, 3, 4]<|/det|>", "<|bbox|1|2|3|4|x|>", "<image>", "<|image|>", " "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1500)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.clean_text(C("t")).alias("c"), text.strip_placeholders(C("t")).alias("p")).collect()
    for r in rows:
        assert r.c == specs.clean(texts[r.i]), repr(texts[r.i])
        assert r.p == specs.placeholders(texts[r.i]), repr(texts[r.i])


def test_random_boxes(spark):
    rng = random.Random(2)
    rows = [(i, *(rng.randint(-100, 1100) for _ in range(4)), rng.randint(1, 3000), rng.randint(1, 3000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, x1 long, y1 long, x2 long, y2 long, w long, h long")
    for r in df.select("*", geometry.denormalize(C("x1"), C("y1"), C("x2"), C("y2"), C("w"), C("h")).alias("b")).collect():
        assert tuple(r.b) == specs.pixels((r.x1, r.y1, r.x2, r.y2), (r.w, r.h)), r


def test_box_vectors(spark):
    df = spark.createDataFrame([(125, 0, 875, 1000, 600, 800), (-500, -500, 1500, 1500, 1000, 800)], "x1 long, y1 long, x2 long, y2 long, w long, h long")
    got = [tuple(r.b) for r in df.select(geometry.denormalize(C("x1"), C("y1"), C("x2"), C("y2"), C("w"), C("h")).alias("b")).collect()]
    assert got == [(0, 0, 600, 800), (0, 0, 1000, 800)]


def test_tags(spark):
    box = markup.box_from_string(C("t"))
    assert tuple(one(spark, "<|bbox|100|200|300|400|image|>", box)) == ("image", 100, 200, 300, 400)
    assert one(spark, "<|bbox|1|2|3|4|>", box).label == ""
    assert one(spark, "nothing", box) is None
    with pytest.raises(Exception, match="no box in"):
        one(spark, "nothing", markup.box_from_string(C("t"), strict=True))
    got = one(spark, "<|bbox|1|2|3|4|a|> <|det|> fig [1, 2, 3, 4]<|/det|> <|bbox|1|2|x|> <|bbox|5|6|7|8|>", markup.tags(C("t")))
    assert [x.label for x in got] == ["fig", "a", ""]  # det tags come first
    assert one(spark, "<|det|>a[99999999999999999999, 1, 2, 3]<|/det|>", markup.tags(C("t")))[0].x1 is None


def test_layout_and_rewrite(spark):
    wrapped = one(spark, "<|det|>header[1, 2, 3, 4]<|/det|>  Head \nBody<|det|>footer[1]<|/det|>", markup.wrap_layout(C("t")))
    assert wrapped == '\n\n<div class="header">Head</div>\n\n\nBody'
    t = "a<|det|>figure[0, 0, 5, 5]<|/det|>b<|det|>table[0, 0, 900, 900]<|/det|>c<|det|>title[1, 2, 3, 4]<|/det|>T"
    got = one(spark, t, markup.rewrite_tags(C("t"), F.lit(7), F.lit(1000), F.lit(1000)))
    assert got.startswith('a\n\nb\n\n<img src="images/page0007_table1.webp" style="width:90.0%;') and got.endswith("c\n\n# T")


def _md(h1=0, h2=0, pages=0):
    return "\n\n".join([f"# T{i}\n\nbody {i}" for i in range(h1)] + [f"## S{i}\n\nbody {i}" for i in range(h2)] + [f"page {i}\n\n{chapters.PAGE_BREAK}" for i in range(pages)])


@pytest.mark.parametrize(
    ("md", "group", "titles"),
    [
        (_md(h1=4), None, ["T0", "T1", "T2", "T3"]), (_md(h2=8), None, [f"S{i}" for i in range(8)]), ("plain", None, [""]), (_md(pages=9), 3, ["Pagine 1-3", "Pagine 4-6", "Pagine 7-9"]),
        (_md(h1=3, pages=6), 2, ["T0", "T1", "T2"]), (_md(pages=5), None, [""] * 5), ("  \n", None, []), ("#\n\nC\n\n# D\n\n# E", None, ["C", "D", "E"]), ("pre\n\n" + _md(h1=3), None, ["", "T0", "T1", "T2"]),
    ],
)
def test_chapters(spark, md, group, titles):
    got = one(spark, md, chapters.adaptive(C("t"), group))
    assert [c.title for c in got] == titles
    assert {c.level for c in got} <= {1}


def test_formats(spark):
    df = spark.createDataFrame([(0.0,), (1536.0,), (3 * 1024.0**5 * 1024,)], "n double")
    assert [r.x for r in df.select(formats.human_bytes(C("n")).alias("x")).collect()] == ["0.0 B", "1.5 KB", "3,072.0 PB"]
    df = spark.createDataFrame([(0.0,), (float("nan"),), (float("inf"),), (59.0,), (61.0,), (3661.0,), (None,)], "n double")
    assert [r.x for r in df.select(formats.format_eta(C("n")).alias("x")).collect()] == ["—", "—", "—", "59s", "1m 01s", "1h 01m", "—"]
    assert one(spark, "a & <b>", text.xml_escape(C("t"))) == "a &amp; &lt;b&gt;"
    html = one(spark, '<img src="a"/><img style="max-width:100%">', text.responsive_images(C("t")))
    assert html.count("max-width:100%") == 2
    assert one(spark, html, text.responsive_images(C("t"))) == html


def test_sql_functions(spark):
    assert "clean_text" in register.register(spark)
    r = spark.sql(r"select clean_text('a-\n b “q”\n\n\n\nz') a, count_words(' a b  c') b, human_bytes(2048D) c, format_eta(61D) d, xml_escape('<&>') e, strip_placeholders('a<image>b') f").first()
    assert tuple(r) == ('ab "q"\n\nz', 3, "2.0 KB", "1m 01s", "&lt;&amp;&gt;", "ab")


def test_settings(tmp_path):
    c = config.Recognition(pages_per_batch=99, quantization=config.Quantization.INT4, cache=tmp_path)
    assert c.batch_size() == 30 and c.options()["quantization"] == "int4" and c.options()["cache"] == str(tmp_path)
    assert not config.model_available(str(tmp_path / "none")) and not config.model_available(str(tmp_path))
    (tmp_path / "config.json").write_text("{}")
    (tmp_path / "m.index.json").write_text('{"weight_map": {"a": "s1", "b": "s2", "c": "s1"}}')
    (tmp_path / "s1").write_text("")
    assert not config.model_available(str(tmp_path))
    (tmp_path / "s2").write_text("")
    assert config.model_available(str(tmp_path))


def test_progress_of_phases(spark):
    """The share of a download, 100 when done, 50 while verifying, else 0."""
    rows = [("download_wheel", 30, 120), ("download_wheel", 500, 100), ("download_wheel", 5, 0), ("done", 0, 0), ("verify", 9, 10), ("extract", 9, 10), ("error", 1, 2), ("starting", 0, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, phase string, d double, t long".replace("d double", "d long"))
    got = [r.x for r in df.orderBy("i").select(formats.progress_percent(C("phase"), C("d"), C("t")).alias("x")).collect()]
    assert got == [25.0, 100.0, None, 100.0, 50.0, 0.0, 0.0, 0.0]


def test_speed_and_rest(spark):
    df = spark.createDataFrame([(1024.0, 4096.0, 2.0), (10.0, 0.0, 1.0), (0.0, 10.0, 5.0), (10.0, 20.0, 0.0)], "d double, t double, e double")
    got = [tuple(r) for r in df.select(formats.speed(C("d"), C("e")), formats.eta(C("d"), C("t"), C("e"))).collect()]
    assert got == [(512.0, 6.0), (10.0, 0.0), (0.0, 0.0), (10000.0, 0.001)]


def test_event_lines(spark):
    df = spark.createDataFrame([("ocr", "m", 10, 50.0, 3.0), ("ocr", "m", 10, 0.0, 3.0), ("done", "m", 0, 50.0, 1234.0)], "p string, m string, t long, x double, e double")
    got = [r.x for r in df.select(formats.format_event_line(C("p"), C("m"), C("t"), C("x"), C("e")).alias("x")).collect()]
    assert got == [f"[OCR       ] t=   3.0s [{'█' * 10}{' ' * 10}]  50.0% m", "[OCR       ] t=   3.0s m", "[DONE      ] t=1234.0s m"]

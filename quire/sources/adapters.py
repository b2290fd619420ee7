"""Boundaries to what Spark does not do itself: page rendering, recognition, image encoding, full Markdown.

Each is a Python protocol; without an implementation the boundary raises AdapterMissing instead of inventing output."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol, TypeVar

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import formats


T = TypeVar("T")


class AdapterMissing(RuntimeError):
    pass


class Renderer(Protocol):
    def pages(self, pdf: bytes, dpi: int, target: int) -> Iterator[tuple[float, float, bytes, bytes]]:
        """(width in points, height in points, full image, square image) of each page."""


class Recognizer(Protocol):
    def read_page(self, image: bytes, ngram_window: int) -> str:
        """Raw text of one square image."""

    def read_pages(self, images: list[bytes], ngram_window: int) -> str:
        """Raw text of a batch of several square images."""


@dataclass(frozen=True)
class PaperDisplay:
    """How images are made ready for paper-like displays: the steps in their order, each of which may be left out."""

    grayscale: bool = True
    auto_contrast: bool = True
    contrast: float = 1.25
    quality: int = 80
    lossless: bool = False

    def steps(self) -> list[tuple[str, float]]:
        # One per cent is cut off by the automatic contrast, and the slowest of six methods encodes.
        out = [("grayscale", 1)] * self.grayscale + [("autocontrast", 1)] * self.auto_contrast + [("contrast", self.contrast)] * (self.contrast != 1.0)
        return [*out, ("lossless", 1)] if self.lossless else [*out, ("quality", self.quality), ("method", 6)]


class ImageCodec(Protocol):
    def cut(self, image: bytes, box: tuple[int, int, int, int]) -> bytes:
        """The part (left, upper, right, lower) of an image."""

    def encode(self, image: bytes, steps: list[tuple[str, float]]) -> bytes:
        """The image as WebP after the steps of a PaperDisplay."""


def _once(factory: Callable[[], T]) -> Callable[[], T]:
    """The factory's product, made when first asked for and then kept: once in each task, however many groups that has."""
    made: list[T] = []

    def get() -> T:
        if not made:
            made.append(factory())
        return made[0]

    return get


PAGES = "book_id string, page_num int, width_pt double, height_pt double, original binary, normalized binary"


def render(spark: SparkSession, path: str, renderer: Callable[[], Renderer] | None, dpi: int = 300, target: int = 1024) -> DataFrame:
    """A row for each page of the PDF files below path. The factory is called once in each task."""
    if renderer is None:
        raise AdapterMissing("no renderer is configured")

    def run(frames):
        own = renderer()
        for f in frames:
            for name, content in zip(f.path, f.content, strict=True):
                for i, (w, h, full, square) in enumerate(own.pages(content, dpi, target)):
                    yield pd.DataFrame([(name, i + 1, w, h, full, square)], columns=["book_id", "page_num", "width_pt", "height_pt", "original", "normalized"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PAGES)


def recognize(batches: DataFrame, recognizer: Callable[[], Recognizer] | None) -> DataFrame:
    """(book_id, batch_id, raw_text) of pages (book_id, batch_id, page_num, normalized); a batch is one call, of one page or of
    several. The factory, which may load a model, is called once in each task."""
    if recognizer is None:
        raise AdapterMissing("no recognizer is configured")
    model = _once(recognizer)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        images = list(f.sort_values("page_num").normalized)
        raw = model().read_pages(images, 1024) if len(images) > 1 else model().read_page(images[0], 128)
        return pd.DataFrame([(f.book_id.iloc[0], f.batch_id.iloc[0], raw)], columns=["book_id", "batch_id", "raw_text"])

    return batches.select("book_id", "batch_id", "page_num", "normalized").groupBy("book_id", "batch_id").applyInPandas(run, "book_id string, batch_id bigint, raw_text string")


def crop(pages: DataFrame, cuts: DataFrame, codec: Callable[[], ImageCodec] | None) -> DataFrame:
    """(book_id, page_num, name, content): the cuts (see books.cuts) of pages (book_id, page_num, original). Only pages with
    cuts that are large enough send their image to Python."""
    if codec is None:
        raise AdapterMissing("no image codec is configured")
    own = _once(codec)

    def run(frames):
        for f in frames:
            box = zip(f.left, f.upper, f.right, f.lower, strict=True)
            f["content"] = [own().cut(x, b) for x, b in zip(f.original, box, strict=True)]
            yield f[["book_id", "page_num", "name", "content"]]

    rows = cuts.select("book_id", "page_num", "name", "box.*").join(pages.select("book_id", "page_num", "original"), ["book_id", "page_num"])
    return rows.mapInPandas(run, "book_id string, page_num int, name string, content binary")


def optimize_images(images: DataFrame, codec: Callable[[], ImageCodec] | None, display: PaperDisplay = PaperDisplay()) -> DataFrame:
    """(book_id, name, content, ratio) re-encoded; names get the new suffix, ratio is the new size by the old one (0 for none)."""
    if codec is None:
        raise AdapterMissing("no image codec is configured")
    own, steps = _once(codec), display.steps()

    def run(frames):
        for f in frames:
            yield f.assign(old=f.content.map(len), content=[own().encode(x, steps) for x in f.content])

    done = images.select("book_id", "name", "content").mapInPandas(run, "book_id string, name string, content binary, old long")
    share = formats.ratio(F.length("content").cast("double"), F.col("old").cast("double"))
    return done.select("book_id", F.regexp_replace("name", r"\.[^.]*$", ".webp").alias("name"), "content", share.alias("ratio"))

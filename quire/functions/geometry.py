"""Boxes between the normalised square that a model sees and the pixels of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1000
TARGET = 1024
MIN_SIDE = 32


def width(x1: Column, x2: Column) -> Column:
    return F.greatest(x2 - x1, F.lit(0))


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return width(x1, x2) * width(y1, y2)


def _fit(w: Column, h: Column, target: int) -> tuple[Column, Column, Column]:
    scale = F.lit(float(target)) / F.greatest(w, h)
    return scale, F.greatest(F.lit(1.0), F.rint(w * scale)), F.greatest(F.lit(1.0), F.rint(h * scale))


def denormalize(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column, target: int = TARGET, span: int = RANGE) -> Column:
    """Pixel box (left, upper, right, lower), clipped to the page; halves round to even."""
    scale, new_w, new_h = _fit(w, h, target)

    def back(v: Column, new: Column) -> Column:
        pad = (F.lit(float(target)) - new) / 2.0
        return F.rint((v * F.lit(float(target)) / F.lit(float(span)) - pad) / scale).cast("long")

    left = F.greatest(F.lit(0), F.least(w - 1, back(x1, new_w)))
    upper = F.greatest(F.lit(0), F.least(h - 1, back(y1, new_h)))
    right = F.greatest(left + 1, F.least(w, back(x2, new_w)))
    lower = F.greatest(upper + 1, F.least(h, back(y2, new_h)))
    return F.struct(left.cast("long").alias("left"), upper.cast("long").alias("upper"), right.cast("long").alias("right"), lower.cast("long").alias("lower"))


def large_enough(box: Column) -> Column:
    """Whether a pixel box is worth cutting out."""
    return (box["right"] - box["left"] >= MIN_SIDE) & (box["lower"] - box["upper"] >= MIN_SIDE)


def width_percent(x1: Column, x2: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(30.0), (x2 - x1) / F.lit(10.0)))


def square(w: Column, h: Column, target: int = TARGET) -> Column:
    """How a page is fitted into the square: new size and whole-pixel place."""
    _, new_w, new_h = _fit(w, h, target)
    at = lambda new: F.floor((F.lit(target) - new) / 2).cast("long")
    return F.struct(new_w.cast("long").alias("new_w"), new_h.cast("long").alias("new_h"), at(new_w).alias("paste_x"), at(new_h).alias("paste_y"))

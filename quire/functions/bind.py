"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row. What a lambda takes from outside is evaluated again for each element, so
    an array that one looks into is bound by this first."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

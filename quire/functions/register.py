"""Scalar operators as temporary SQL functions: each is the same expression, not a Python function."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quire.functions import formats, text

FUNCTIONS = {
    "clean_text": (text.clean_text, "string", "string"),
    "count_words": (text.count_words, "string", "bigint"),
    "strip_placeholders": (text.strip_placeholders, "string", "string"),
    "xml_escape": (text.xml_escape, "string", "string"),
    "responsive_images": (text.responsive_images, "string", "string"),
    "human_bytes": (formats.human_bytes, "double", "string"),
    "format_eta": (formats.format_eta, "double", "string"),
}


def _sql(spark: SparkSession, column: Column, kind: str) -> str:
    plan = spark.createDataFrame([], f"x {kind}").select(column.alias("y"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql()


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session; gives their names."""
    for name, (make, given, gives) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}(x {given}) returns {gives} return {_sql(spark, make(F.col('x')), given)}")
    return list(FUNCTIONS)

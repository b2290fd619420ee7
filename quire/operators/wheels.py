"""Choice of a runtime build for a device: exact match, else the next larger generation, then driver rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Compute capability (major, minor), build, least driver.
WHEELS = [
    (6, 0, "cu118", "11.8"), (6, 1, "cu118", "11.8"), (6, 2, "cu118", "11.8"), (7, 0, "cu118", "11.8"), (7, 5, "cu118", "11.8"), (8, 0, "cu124", "11.8"),
    (8, 6, "cu124", "11.8"), (8, 9, "cu124", "11.8"), (9, 0, "cu124", "11.8"), (10, 0, "cu126", "12.6"), (12, 0, "cu126", "12.6"),
]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WHEELS, "major int, minor int, build string, least_driver string")


def select(devices: DataFrame, wheels: DataFrame) -> DataFrame:
    """devices (device, major, minor, driver_major) with build and least_driver. The table of builds has a fixed, small size
    and is broadcast; a device without an exact match takes the first (major, minor) whose major is not smaller."""
    w = F.broadcast(wheels.select(F.col("major").alias("wm"), F.col("minor").alias("wn"), "build", "least_driver"))
    fit = (F.col("wm") >= F.col("major"))
    order = F.struct((~((F.col("wm") == F.col("major")) & (F.col("wn") == F.col("minor")))).cast("int"), "wm", "wn")
    rows = devices.join(w, fit, "left").groupBy("device", "major", "minor", "driver_major").agg(F.min_by(F.struct("build", "least_driver"), order).alias("b"))
    build, least = F.coalesce("b.build", F.lit("cpu")), F.coalesce("b.least_driver", F.lit(""))
    d = F.col("driver_major")
    # Fixed rules: what an old driver falls back to.
    chosen = (
        F.when((build == "cu118") & (d < 11), F.struct(F.lit("cpu").alias("build"), F.lit("0").alias("least_driver")))
        .when((build == "cu124") & (d < 12), F.struct(F.lit("cu118").alias("build"), F.lit("11.8").alias("least_driver")))
        .when((build == "cu126") & (d < 12), F.struct(F.lit("cu124").alias("build"), F.lit("12.4").alias("least_driver")))
        .otherwise(F.struct(build.alias("build"), least.alias("least_driver")))
    )
    return rows.withColumn("c", chosen).select("device", "major", "minor", "driver_major", "c.*")


def parse_devices(lines: DataFrame, col: str = "line") -> DataFrame:
    """(name, driver, major, minor) of lines `name, driver, capability`; a part that is no number is null."""
    part = F.transform(F.split(col, ","), lambda x: F.trim(x))
    cap = F.split(F.get(part, F.lit(2)), r"\.")
    number = lambda i: F.get(cap, F.lit(i)).try_cast("int")
    return lines.select(F.get(part, F.lit(0)).alias("name"), F.get(part, F.lit(1)).alias("driver"), number(0).alias("major"), number(1).alias("minor"))


def first_cached(files: DataFrame, pattern: str) -> DataFrame:
    """(folder, name): the first file of each folder (folder, name) whose name is LIKE the pattern."""
    return files.where(F.col("name").like(pattern)).groupBy("folder").agg(F.min("name").alias("name"))

"""State documents of jobs: reading with defaults, writing by job without partial files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "phase string, message string, downloaded_bytes bigint, total_bytes bigint, speed_bps double, eta_seconds double, updated_at double"
DEFAULTS = {"phase": "init", "message": "", "downloaded_bytes": 0, "total_bytes": 0, "speed_bps": 0.0, "eta_seconds": 0.0, "updated_at": 0.0}


def parse(c: Column) -> Column:
    """Fields of a JSON state; what is missing, corrupt or no object takes its default."""
    s = F.from_json(c, SCHEMA, {"mode": "PERMISSIVE"})
    return F.struct(*[F.coalesce(s[k], F.lit(v)).alias(k) for k, v in DEFAULTS.items()])


def write(states: DataFrame, path: str) -> None:
    """One row for each job, written whole or not at all by Spark's commit protocol."""
    states.write.mode("overwrite").json(path)


def sink(path: str):
    """A foreachBatch function that keeps the states of each batch under its own number, so that a batch written again
    replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        write(batch, f"{path}/batch={number}")

    return put


def latest_sink(path: str):
    """A foreachBatch function that keeps the latest state of each job (job_id, updated_at, ..): batch n is merged with what
    batch n - 1 left and written as version n, whole or not at all, so that a batch written again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        before = _versions(batch.sparkSession, path, number)
        old = batch.sparkSession.read.schema(batch.schema).json(f"{path}/version={before[-1]}") if before else None
        every = batch if old is None else old.unionByName(batch)
        one = every.groupBy("job_id").agg(F.max_by(F.struct(*batch.columns), "updated_at").alias("s")).select("s.*")
        write(one, f"{path}/version={number}")

    return put


def read_latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What latest_sink has kept."""
    known = _versions(spark, path)
    return spark.read.schema(schema).json(f"{path}/version={known[-1]}") if known else spark.createDataFrame([], schema)


def _versions(spark: SparkSession, path: str, below: float = float("inf")) -> list[int]:
    """Numbers of the versions that were written whole."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [x.getPath() for x in fs.listStatus(where)]
    whole = [x for x in names if x.getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(n for n in (int(x.getName()[8:]) for x in whole) if n < below)

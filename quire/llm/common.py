"""What the operators share: narrow projections, Arrow passes over texts and written intermediate tables."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; documents may be long, so batches stay small and worker memory bounded.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, m: int):
    """crc32 of an id's text, modulo m; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % m


def give_back() -> None:
    """Returns what was freed to the system: workers are reused, and it would count against the next operator's tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def arrow_pass(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in batches that are bounded by rows and bytes. The session's settings are read when the plan is made, so
    they are lowered here and stay so."""

    def run(batches):
        yield from fn(batches)
        give_back()

    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def bloom_filters(spark: SparkSession) -> None:
    """Lets Spark push a Bloom filter of a join's smaller side into the scan of the other. The filter has a bounded size
    whatever that side's; beyond the threshold the join is a plain one."""
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "256m")


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, y) of the documents that a 0/1 label is known of.

    A Bloom filter of the labelled ids (Spark's own, of bounded size) is pushed into the scan of the documents, so that
    texts without a label are not shuffled; where the labels outgrow it, the join is a plain one."""
    bloom_filters(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y"))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(known, F.col("id") == F.col("k")).select("id", "text", "y")


def label_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(id, text, y) of at most `rows` labelled ids, those with the smallest hash; only those ids are broadcast, so the texts
    are read without a shuffle. Documents that repeat an id all count."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y"))
    few = known.orderBy(F.xxhash64("k"), "k", "y").limit(rows)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.join(F.broadcast(few), F.col("id") == F.col("k")).select("id", "text", "y")


class Workspace:
    """Written tables that cut lineage. They lie below spark.checkpoint.dir, which every executor reaches. Where it is unset,
    a local session, as in tests, uses a folder of its warehouse; on a cluster that would not be shared, so it is an error."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"{spark.conf.get('spark.sql.warehouse.dir')}/quire-work"
        self.path = f"{base.rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count:03d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quire_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step and no result reads."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._quire_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

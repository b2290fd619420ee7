"""Token streams and job logs as structured streams with keyed state."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below spark.checkpoint.dir; in a local session without one, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/quire-work"
    return f"{base.rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"


class Accumulate(StatefulProcessor):
    """Keeps what each stream has said; gives, for each chunk, how long that is and its last characters. A stream's state is
    its length and its tail, not its text."""

    TAIL = 500

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("said", "n long, tail string")

    def handleInputRows(self, key, rows, timerValues):
        n, tail = self.state.get() if self.state.exists() else (0, "")
        frame = pd.concat(list(rows)).sort_values("seq")
        out = []
        for seq, chunk in zip(frame.seq, frame.chunk, strict=True):
            if chunk:
                n, tail = n + len(chunk), (tail + chunk)[-self.TAIL :]
                out.append((key[0], seq, n, tail))
        self.state.update((int(n), tail))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "n_chars", "tail"]).astype({"stream_id": "int64", "seq": "int64", "n_chars": "int64"})

    def close(self) -> None:
        pass


class Stalls(StatefulProcessor):
    """Gives events that too long a silence follows in a job that they do not end: at once where the next event is there, by a
    timer where none comes."""

    def __init__(self, seconds: int = 10, done: tuple[str, ...] = ("done", "error")):
        self.wait, self.done = seconds * 1_000_000, done

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "us long, seq long, phase string")

    def _rows(self, key, found: list[int]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], seq) for seq in found], columns=["job_id", "seq"]).astype("int64")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(["us", "seq"])
        last, found = (self.state.get() if self.state.exists() else None), []
        for us, seq, phase in zip(frame.us, frame.seq, frame.phase, strict=True):
            if last and us > last[0] + self.wait and last[2] not in self.done:
                found.append(last[1])
            last = (us, seq, phase)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.state.update((int(last[0]), int(last[1]), last[2]))
        if last[2] not in self.done:  # the first millisecond that is more than the wait after the event
            self.handle.registerTimer(int((last[0] + self.wait) // 1000 + 1))
        yield self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = self.state.get() if self.state.exists() else None
        if last:
            self.state.clear()  # told; an event that comes later starts anew
        yield self._rows(key, [last[1]] if last else [])

    def close(self) -> None:
        pass


def accumulate(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("stream_id").transformWithStateInPandas(Accumulate(), "stream_id long, seq long, n_chars long, tail string", "Append", "None")


def stalls(log: DataFrame, seconds: int = 10) -> DataFrame:
    """log: (job_id, seq, ts, phase). Time passes with the latest event of all jobs."""
    timed = log.withColumn("us", F.unix_micros("ts")).withWatermark("ts", "0 seconds")
    return timed.groupBy("job_id").transformWithStateInPandas(Stalls(seconds), "job_id long, seq long", "Append", "EventTime")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there now, into files, and reads them."""
    spark = stream.sparkSession
    path, setting = folder(spark, name), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, PROVIDER)
    try:
        run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    finally:  # a query keeps the settings that it has started with
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")

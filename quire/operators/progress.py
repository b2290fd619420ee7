"""Logs of jobs and token streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators.unions import union


def latest(log: DataFrame) -> DataFrame:
    """The last event of each job; the later id wins among equal times."""
    return log.groupBy("job_id").agg(F.max_by(F.struct("phase", "message", "percent"), F.struct("ts", "seq")).alias("e"), F.count("*").alias("n_events")).select("job_id", "e.*", "n_events")


def carried(log: DataFrame, fields: list[str]) -> DataFrame:
    """Each job's last known value of each field; events that do not know it leave it as it was."""
    known = [F.max_by(f, F.when(F.col(f).isNotNull(), F.struct("ts", "seq"))).alias(f) for f in fields]
    return log.groupBy("job_id").agg(*known)


def phase_coverage(log: DataFrame) -> DataFrame:
    return log.groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_set("phase")), ",").alias("phases"))


def elapsed(log: DataFrame) -> DataFrame:
    return log.groupBy("job_id").agg((F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))).alias("seconds"))


def stalls(log: DataFrame, seconds: int = 10, done: tuple[str, ...] = ("done", "error"), now: Column | None = None) -> DataFrame:
    """Events that more than so many seconds of silence follow, up to the next event of the job or, after its last one, up to
    `now` (by default the time of the last event of all jobs); not those that end a job."""
    nxt = F.lead("ts").over(Window.partitionBy("job_id").orderBy("ts", "seq"))
    rows = log.withColumn("until", F.coalesce(nxt, log.agg(F.max("ts")).scalar() if now is None else now))
    return rows.where((F.col("until") > F.col("ts") + F.expr(f"interval {seconds} seconds")) & ~F.col("phase").isin(*done))


def persistent(log: DataFrame) -> DataFrame:
    return log.where(~F.coalesce("transient", F.lit(False)))


def prefixes(chunks: DataFrame) -> DataFrame:
    """All that a stream has said up to each chunk (stream_id, seq, chunk); empty chunks say nothing and are left out."""
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chunks.where("chunk <> ''").withColumn("text", F.array_join(F.collect_list("chunk").over(w), ""))


def final(chunks: DataFrame) -> DataFrame:
    """(stream_id, text) of each stream, chunks in order; a stream of empty chunks has an empty text."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    return chunks.groupBy("stream_id").agg(F.array_join(F.transform(rows, lambda r: r["chunk"]), "").alias("text"))


def statuses(streams: DataFrame, chunks: DataFrame) -> DataFrame:
    """(stream_id, seq, text, status) of each of streams (stream_id): what it has said up to each chunk while it runs, then all
    of it when done. A stream that says nothing gives one row, an empty text that is done."""
    said = prefixes(chunks).select("stream_id", "seq", "text", F.lit("running").alias("status"))
    whole = streams.select("stream_id").distinct().join(final(chunks), "stream_id", "left")
    last = chunks.groupBy("stream_id").agg(F.max("seq").alias("last"))
    done = whole.join(last, "stream_id", "left").select("stream_id", (F.coalesce("last", F.lit(-1)) + 1).alias("seq"), F.coalesce("text", F.lit("")).alias("text"), F.lit("done").alias("status"))
    return union(said, done)


def readings(stated: DataFrame) -> DataFrame:
    """(stream_id, text) of streams that are done: the text stripped, without the placeholders of its prompt."""
    return stated.where("status = 'done'").select("stream_id", text.strip_placeholders(text.strip(F.col("text"))).alias("text"))


def run_events(batched: DataFrame, crops: DataFrame, optimize: bool = True, partial: DataFrame | None = None) -> DataFrame:
    """(book_id, seq, phase, message, current, total, percent, transient): the events of runs over batched pages (see
    books.batches), where crops (book_id, crops) are the cuts kept. Recognition reports a batch when it starts and, for
    partial texts (book_id, batch_id, part, text), how far it has got; those are transient. Phases that report no numbers
    have zeros. Images are optimized only if that is asked for and there are some."""
    zero, long = F.lit(0).cast("long"), lambda c: c.cast("long")
    books = batched.groupBy("book_id").agg(F.max("total").alias("n"), F.max("batch_id").alias("last")).join(crops, "book_id", "left").withColumn("crops", long(F.coalesce("crops", F.lit(0))))

    def event(src: DataFrame, order: list, phase: str, message: Column, current: Column = zero, total: Column = zero, percent: Column = F.lit(0.0), transient: bool = False) -> DataFrame:
        at = F.struct(*[long(x).alias(f"o{i}") for i, x in enumerate([*order, *[zero] * (3 - len(order))])])
        return src.select("book_id", at.alias("at"), F.lit(phase).alias("phase"), message.alias("message"), long(current).alias("current"), long(total).alias("total"), percent.alias("percent"), F.lit(transient).alias("transient"))

    n, crops_, say = F.col("n"), F.col("crops"), lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    each = batched.select("book_id", "batch_id", "batch_start", "batch_end", "total", "percent").distinct()
    batch = say("reading pages ", F.col("batch_start"), "-", F.col("batch_end"), "/", F.col("total"))
    numbers = {"current": F.col("batch_start"), "total": F.col("total"), "percent": F.col("percent")}
    out = event(books, [F.lit(0)], "rendering", F.lit("rendering"))
    out = union(out, event(books, [F.lit(1)], "rendering", say("rendered pages: ", n), n, n, F.lit(100.0)))
    out = union(out, event(each, [F.lit(2), F.col("batch_id")], "ocr", batch, **numbers))
    if partial is not None:
        told = each.join(partial, ["book_id", "batch_id"])
        out = union(out, event(told, [F.lit(2), F.col("batch_id"), F.col("part") + 1], "ocr", F.concat(batch, F.lit("\n"), text.tail(F.col("text"))), **numbers, transient=True))
    out = union(out, event(books, [F.lit(3)], "cleaning", F.lit("cleaning text")))
    out = union(out, event(books, [F.lit(4)], "cropping", say("cut images: ", crops_), crops_, crops_, F.lit(100.0)))
    if optimize:
        out = union(out, event(books.where("crops > 0"), [F.lit(5)], "optimizing", F.lit("optimizing images")))
    out = union(out, event(books, [F.lit(6)], "compiling", F.lit("compiling the book")))
    out = union(out, event(books, [F.lit(7)], "done", say("pages done: ", n), n, n, F.lit(100.0)))
    nth = F.row_number().over(Window.partitionBy("book_id").orderBy("at")) - 1
    return out.withColumn("seq", long(nth)).drop("at")


def results(events: DataFrame, strict: bool = True) -> DataFrame:
    """(book_id, pages, message) by the event that says a run is done. A run without one is an error if strict, else its
    pages and message are null."""
    last = F.max_by(F.struct("phase", F.col("total").alias("pages"), "message"), F.when(F.col("phase") == "done", F.col("seq")))
    found = events.groupBy("book_id").agg(last.alias("d"))
    if strict:
        wrong = F.raise_error(F.concat(F.lit("no result of "), "book_id")).cast(found.schema["d"].dataType)
        found = found.withColumn("d", F.when(F.col("d").isNull(), wrong).otherwise(F.col("d")))
    return found.select("book_id", "d.pages", "d.message")

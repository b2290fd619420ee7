"""Numbers and events as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def human_bytes(n: Column) -> Column:
    out = None
    for i, unit in enumerate(UNITS):
        v = n.cast("double") / float(1024**i)
        text = F.concat(F.format_number(v, 1), F.lit(f" {unit}"))
        if i == len(UNITS) - 1:
            return out.otherwise(text)
        out = F.when(v < 1024, text) if out is None else out.when(v < 1024, text)


def human_speed(n: Column) -> Column:
    return F.concat(human_bytes(n), F.lit("/s"))


def format_eta(secs: Column) -> Column:
    s = F.rint(secs).cast("long")
    m, h = F.floor(s / 60), F.floor(s / 3600)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    finite = ~F.isnan(secs) & (secs > 0) & (secs < float("inf"))
    return (
        F.when(~F.coalesce(finite, F.lit(False)), F.lit("—"))
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(m < 60, F.concat(m.cast("string"), F.lit("m "), two(s % 60), F.lit("s")))
        .otherwise(F.concat(h.cast("string"), F.lit("h "), two(m % 60), F.lit("m")))
    )


def format_event(phase: Column, message: Column, total: Column, percent: Column) -> Column:
    """Phase, a bar of twenty blocks if a total is known, message."""
    blocks = F.rpad(F.repeat(F.lit("█"), F.rint(percent / 5).cast("int")), 20, " ")
    bar = F.when(F.coalesce(total, F.lit(0)) != 0, F.concat(F.lit(" ["), blocks, F.lit("] "), F.lpad(F.format_string("%.1f", percent), 5, " "), F.lit("%"))).otherwise("")
    return F.concat(F.lit("["), F.rpad(F.upper(phase), 10, " "), F.lit("]"), bar, F.lit(" "), message)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def media_type(name: Column) -> Column:
    ext = F.regexp_extract(name, r"\.([^.]*)$", 1)
    return F.concat(F.lit("image/"), F.when(ext == "webp", F.lit("webp")).otherwise(ext))


def format_event_line(phase: Column, message: Column, total: Column, percent: Column, elapsed: Column) -> Column:
    """The variant for terminals: seconds since the start, and no bar as long as nothing is done."""
    blocks = F.rpad(F.repeat(F.lit("█"), F.rint(percent / 5).cast("int")), 20, " ")
    known = (F.coalesce(total, F.lit(0)) != 0) & (F.coalesce(percent, F.lit(0.0)) != 0)
    bar = F.when(known, F.concat(F.lit(" ["), blocks, F.lit("] "), F.lpad(F.format_string("%.1f", percent), 5, " "), F.lit("%"))).otherwise("")
    return F.concat(F.lit("["), F.rpad(F.upper(phase), 10, " "), F.lit("] t="), F.lpad(F.format_string("%.1f", elapsed), 6, " "), F.lit("s"), bar, F.lit(" "), message)


def speed(done: Column, elapsed: Column) -> Column:
    return done / F.greatest(elapsed, F.lit(0.001))


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds that the rest takes at the speed so far; 0 without a total or a speed."""
    own = speed(done, elapsed)
    return F.when((total > 0) & (own > 0), (total - done) / own).otherwise(0.0)


# The phases of a download that show progress of their own.
DOWNLOAD, VERIFY = "download_wheel", "verify"


def progress_percent(phase: Column, done: Column, total: Column) -> Column:
    """0 to 100: the share of a download (null while its total is unknown), 100 when done, 50 while verifying, else 0."""
    own = F.when(total > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), done * 100.0 / total)))
    return F.when(phase == DOWNLOAD, own).when(phase == "done", 100.0).when(phase == VERIFY, 50.0).otherwise(0.0)


def resolve_device(asked: Column, free_gb: Column, least_gb: float = 8.0) -> Column:
    return F.when(asked != "auto", asked).when(F.coalesce(free_gb, F.lit(0.0)) >= least_gb, "cuda").otherwise("cpu")


def ngram_window(pages: Column) -> Column:
    return F.when(pages > 1, 1024).otherwise(128)

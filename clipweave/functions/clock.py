"""Times in text: subtitle stamps, probe logs and silence logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.plans.scan import number_rows

STAMP = r"(\d{1,3}):(\d{2}):(\d{2})[,.](\d{1,3})"


def stamp_ms(c: Column, scale: int = 1000, strict: bool = False) -> Column:
    """``H:MM:SS,frac`` in milliseconds.

    The fraction is a whole number over ``scale`` (1000 for SubRip, 100 for ASS), so
    ``1.5`` is five thousandths. ``strict`` reads it as a decimal fraction instead.
    """
    part = lambda i: F.regexp_extract(c, STAMP, i)
    frac = F.rpad(part(4), 3, "0").try_cast("long") if strict else part(4).try_cast("long") * (1000 // scale)
    whole = part(1).try_cast("long") * 3600 + part(2).try_cast("long") * 60 + part(3).try_cast("long")
    return whole * 1000 + frac


def srt_stamp(ms: Column) -> Column:
    """Milliseconds as ``HH:MM:SS,mmm``; negative times become zero."""
    t = F.greatest(F.lit(0), ms).cast("long")
    return F.format_string(
        "%02d:%02d:%02d,%03d", F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60, t % 1000)


def srt_stamp_seconds(seconds: Column) -> Column:
    """Seconds as a stamp: rounded to the millisecond, which may carry into the seconds."""
    return srt_stamp(F.bround(F.greatest(F.lit(0.0), seconds) * 1000, 0))


def probe_logs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Probe log lines (item_id, line_no, line) to durations and streams."""
    pattern = r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)"
    hit = lines.filter(F.col("line").rlike(pattern))
    part = lambda i: F.regexp_extract("line", pattern, i).cast("double")
    seconds = part(1) * 3600 + part(2) * 60 + part(3)
    durations = hit.groupBy("item_id").agg(F.min_by(seconds, "line_no").alias("duration"))
    stream = r"Stream #\S+: (Video|Audio): (\S+)"
    streams = lines.filter(F.col("line").rlike(stream)).select(
        "item_id", "line_no", F.lower(F.regexp_extract("line", stream, 1)).alias("kind"),
        F.regexp_extract("line", stream, 2).alias("codec"))
    return durations, streams


def silence_logs(lines: DataFrame) -> DataFrame:
    """Pair the n-th silence start with the n-th end; a start without end stays open (null)."""

    def marks(word: str, name: str) -> DataFrame:
        raw = F.regexp_extract("line", rf"silence_{word}:\s*([0-9.]+)", 1)
        found = lines.withColumn("_v", raw).filter("_v <> ''")
        return number_rows(found, ["item_id"], ["line_no"], "_n").select("item_id", "_n", F.col("_v").cast("double").alias(name))

    both = marks("start", "start").join(marks("end", "end"), ["item_id", "_n"], "left")
    ms = lambda c: F.round(F.col(c) * 1000).cast("long").alias(f"{c}_ms")
    return both.filter("end IS NULL OR end > start").select("item_id", ms("start"), ms("end"))


def referer(url: Column, default: str = "") -> Column:
    """``https://host/`` of a URL."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.when(F.coalesce(host, F.lit("")) == "", default).otherwise(F.concat(F.lit("https://"), host, F.lit("/")))

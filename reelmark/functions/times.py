"""Times: formats, slots, calendars of running hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_SECONDS, SLOTS_PER_REQUEST = 300, 8


def parsed(text: Column) -> Column:
    """Seconds since 1970 of 14 digits (year to second, UTC) or of a plain number."""
    full = F.unix_timestamp(F.when(F.length(text) == 14, text), "yyyyMMddHHmmss")
    return F.when(F.length(text) == 14, full).otherwise(text.try_cast("long"))


def slot_requests(start: Column, end: Column) -> Column:
    """Requests that cover [start, end) in whole slots: an array of (first slot, number of slots)."""
    first, last = F.floor(start / SLOT_SECONDS), F.floor((end + SLOT_SECONDS - 1) / SLOT_SECONDS)
    starts = F.when(last > first, F.sequence(first, last - 1, F.lit(SLOTS_PER_REQUEST).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("slot"), F.least(last - s, F.lit(SLOTS_PER_REQUEST)).cast("long").alias("n")))


def next_hour(time: Column) -> Column:
    return F.date_trunc("hour", time + F.expr("INTERVAL 60 MINUTES")).cast("timestamp_ntz")


def paused(run_hours: Column, time: Column) -> Column:
    """The mask of 24 hours doesn't allow this one."""
    return ~F.element_at(run_hours, F.hour(time) + 1)


# How a time is written in a list, as a number, in the name of a log, and as a day.
FORMATS = {"list": "yyyy/MM/dd HH:mm:ss", "number": "yyyyMMddHHmm", "log": "yyyy-MM-dd_HHmmss.SSS", "day": "yyyy年MM月dd日"}


def written(time: Column, kind: str) -> Column:
    return F.date_format(time, FORMATS[kind])


def duration_text(seconds: Column) -> Column:
    """Hours, minutes and seconds; hours go beyond 24."""
    whole = F.floor(seconds)
    return F.format_string("%d時間%02d分%02d秒", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)

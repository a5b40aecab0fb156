"""Queries on a catalogue of jobs: view filters, look-ups, duplicates, outcomes of siblings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmark.operators import ranks
from reelmark.functions.names import directory

ACTIVE_STATES = ("Encoding", "LogoPending", "Queue")
# The message of recordings that are too small, and what states and modes are called.
TOO_SMALL = "映像が小さすぎます"
STATE_TEXTS = {"Queue": "待ち", "Failed": "失敗", "PreFailed": "失敗", "LogoPending": "ペンディング", "Canceled": "キャンセル", "Complete": "完了"}
MODE_TEXTS = {"AutoBatch": "自動追加", "Batch": "通常", "Test": "テスト", "DrcsCheck": "DRCSチェック", "CMCheck": "CM解析"}


@dataclass
class View:
    """What a list of jobs shows; empty fields don't filter. start and end bound the time in which a job ran."""

    hide_small: bool = False
    priorities: list[int] = field(default_factory=list)
    buckets: list[int] = field(default_factory=list)
    start: str | None = None
    end: str | None = None
    word: str = ""
    fields: list[str] = field(default_factory=list)


def priority_index(priority: Column) -> Column:
    """0 to 4; failed jobs of priority 0 count as the lowest."""
    return F.greatest(F.lit(0), F.least(F.lit(4), priority - 1))


def state_bucket(state: Column) -> Column:
    """Queued 0, pending 1, running 2, cancelled 3, done 4, failed of either kind 5; unknown states count as queued."""
    return F.when(state == "LogoPending", 1).when(state == "Encoding", 2).when(state == "Canceled", 3).when(state == "Complete", 4).when(state.isin("Failed", "PreFailed"), 5).otherwise(0)


def is_active(state: Column) -> Column:
    return state.isin(*ACTIVE_STATES)


def is_small(width: Column, height: Column) -> Column:
    return (width <= 320) | (height <= 260)


def was_refused_as_small(state: Column, fail_reason: Column) -> Column:
    return (state == "PreFailed") & F.contains(F.coalesce(fail_reason, F.lit("")), F.lit(TOO_SMALL))


def is_batch(mode: Column) -> Column:
    return mode.isin("Batch", "AutoBatch")


def is_check(mode: Column) -> Column:
    return mode.isin("DrcsCheck", "CMCheck")


def is_test(mode: Column) -> Column:
    return mode == "Test"


def needs_separate_hash(mode: Column, hash_disabled: Column, path: Column) -> Column:
    """A batch job of a file on another machine, unless its profile leaves hashes out."""
    return (mode == "Batch") & ~hash_disabled & F.startswith(path, F.lit("\\\\"))


def encode_finish(start: Column, seconds: Column) -> Column:
    """Null if the job has no start or took no time yet."""
    return F.when(seconds != 0, start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))


def state_text(state: Column, mode: Column, console: Column) -> Column:
    doing = F.when(mode == "CMCheck", "CM解析中→").when(mode == "DrcsCheck", "DRCSチェック中→").otherwise("エンコード中→")
    text = F.when(state == "Encoding", F.concat(doing, (console + 1).cast("string")))
    for name, shown in STATE_TEXTS.items():
        text = text.when(state == name, shown)
    return text.otherwise("不明")


def mode_text(mode: Column) -> Column:
    text = F.when(F.lit(False), "")
    for name, shown in MODE_TEXTS.items():
        text = text.when(mode == name, shown)
    return text.otherwise("不明モード")


def displayed(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs: state, mode, console, fail_reason, width, height, start, seconds, service_name, service_id, ts_time, genres, path, dst_path. Adds what a queue shows of each."""
    c = F.col
    return jobs.select(
        "*",
        c("state").isin("Failed", "PreFailed").alias("is_error"),
        was_refused_as_small(c("state"), c("fail_reason")).alias("is_too_small"),
        F.coalesce(F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(c("start").cast("timestamp")), F.lit(0)).alias("elapsed_s"),
        encode_finish(c("start"), c("seconds")).alias("finish"),
        F.coalesce(F.array_join("genres", ", "), F.lit("")).alias("genre_text"),
        F.concat(c("width").cast("string"), F.lit("x"), c("height").cast("string")).alias("size_text"),
        state_text(c("state"), c("mode"), c("console")).alias("state_text"),
        mode_text(c("mode")).alias("mode_text"),
        F.concat("service_name", F.lit("("), c("service_id").cast("string"), F.lit(")")).alias("service_text"),
        F.date_format("ts_time", "yyyy年MM月dd日").alias("time_text"),
        directory(c("dst_path")).alias("out_dir"),
    )


def view(jobs: DataFrame, shown: View) -> DataFrame:
    """jobs: state, priority, fail_reason, start, finish and the text fields. Every set part of the view must hold; the word must be in one of the fields, case and all.

    A job without a finish ended before any start of the view, one without a start began before any end.
    """
    out = jobs
    if shown.hide_small:
        out = out.filter(~was_refused_as_small(F.col("state"), F.col("fail_reason")))
    if shown.priorities:
        out = out.filter(priority_index(F.col("priority")).isin(*shown.priorities))
    if shown.buckets:
        out = out.filter(state_bucket(F.col("state")).isin(*shown.buckets))
    if shown.start:
        out = out.filter(F.col("finish") >= F.lit(shown.start).cast("timestamp_ntz"))
    if shown.end:
        out = out.filter(F.coalesce(F.col("start") <= F.lit(shown.end).cast("timestamp_ntz"), F.lit(True)))
    if shown.word and shown.fields:
        found = F.lit(False)
        for name in shown.fields:
            found = found | F.contains(F.coalesce(name, F.lit("")), F.lit(shown.word))
        out = out.filter(found)
    return out


def progress(jobs: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, remaining, progress): done over all but jobs that can't start yet or ever, both raised by 0.1 so that no job at all counts as done."""
    counts = jobs.groupBy(*by).agg(F.count_if(~F.col("state").isin("LogoPending", "PreFailed")).alias("total"), F.count_if(F.col("state").isin("Queue", "Encoding")).alias("remaining"))
    return counts.withColumn("progress", (F.col("total") - F.col("remaining") + 0.1) / (F.col("total") + 0.1))


def not_active(files: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Files whose key is the source of no active job."""
    return files.join(jobs.filter(is_active(F.col("state"))).select(key).distinct(), key, "left_anti")


def usable(exists: Column, enabled: Column, start: Column, end: Column, time: Column) -> Column:
    """An entry holds at a time within its bounds, both included, and at an unknown time."""
    return exists & enabled & F.coalesce(time.between(start, end), F.lit(True))


def with_usable(items: DataFrame, settings: DataFrame, key: str, time: str) -> DataFrame:
    """Items with any usable setting of their key. The join is on the key, the interval a condition beside it."""
    on = (items[key] == settings[key]) & usable(settings["exists"], settings["enabled"], settings["from"], settings["to"], items[time])
    return items.join(settings, on, "left_semi")


def usable_lists(items: DataFrame, settings: DataFrame, item: str, key: str, time: str, none_name: str) -> DataFrame:
    """(item, files, allows_none): the names of all usable settings, sorted, and whether one of them means that no mark is all right."""
    on = (items[key] == settings[key]) & usable(settings["exists"], settings["enabled"], settings["from"], settings["to"], items[time])
    pairs = items.join(settings, on, "left").select(items[item], settings["file_name"])
    real = F.when(F.col("file_name") != none_name, F.col("file_name"))
    return pairs.groupBy(item).agg(F.array_sort(F.collect_list(real)).alias("files"), F.coalesce(F.bool_or(F.col("file_name") == none_name), F.lit(False)).alias("allows_none"))


def sibling_outcome(jobs: DataFrame, key: str) -> DataFrame:
    """Adds what holds among the jobs of one source: any active, complete or failed, and none cancelled. One window, no join."""
    by = Window.partitionBy(key)
    return (
        jobs.withColumn("any_active", F.bool_or(is_active(F.col("state"))).over(by))
        .withColumn("any_complete", F.bool_or(F.col("state") == "Complete").over(by))
        .withColumn("any_failed", F.bool_or(F.col("state").isin("Failed", "PreFailed")).over(by))
        .withColumn("none_canceled", F.bool_and(F.col("state") != "Canceled").over(by))
    )


def most_recent(uses: DataFrame, keys: list[str], value: str, time: str, keep: int) -> DataFrame:
    """The last `keep` distinct values of each key by their latest use, the latest first; ties by value."""
    latest = uses.groupBy(*keys, value).agg(F.max(time).alias("last_use"))
    order = Window.partitionBy(*keys).orderBy(F.col("last_use").desc(), value)
    return latest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def channel_numbers(rows: DataFrame, parent: str, channel: str, order: list[str]) -> DataFrame:
    """Numbers from 0 for the different channels of a parent, in order of their first row; further rows of a channel are dropped."""
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy(parent, channel).orderBy(*order))).filter("k = 1").drop("k")
    return first.withColumn("number", F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1)


def reloaded(jobs: DataFrame, queue: str, order: str) -> DataFrame:
    """A saved queue as it is taken up again: waiting and running jobs start over, and jobs are numbered anew from 1 within their queue. jobs: queue, order, state, start, seconds."""
    numbers = F.row_number().over(Window.partitionBy(queue).orderBy(order))
    return jobs.withColumns(_started_over() | {"number": numbers})


def _started_over() -> dict[str, Column]:
    again = F.col("state").isin("Encoding", "Queue")
    return {"state": F.when(again, "LogoPending").otherwise(F.col("state")), "start": F.when(~again, F.col("start")), "seconds": F.when(~again, F.col("seconds"))}


def taken_up(jobs: DataFrame, order: list[Column]) -> DataFrame:
    """A saved queue of any length as it is taken up again, as reloaded() does for many: all its jobs are numbered from 1 in one order."""
    return ranks.numbered(jobs, order, "before").withColumns(_started_over() | {"number": F.col("before") + 1}).drop("before")


def is_cleared(state: Column) -> Column:
    """Jobs that clearing a queue takes out; the others are retained."""
    return state.isin("Complete", "PreFailed")


def add_if_absent(values: Column, added: Column) -> Column:
    """An array with a value at its end unless it holds it already."""
    return F.when(F.array_contains(values, added), values).otherwise(F.array_append(values, added))


def checked_last(listed: DataFrame, services: DataFrame, key: str) -> DataFrame:
    """(key, known): ids of a condition that no service has, then the services that are checked. listed: key, checked (boolean); services: key."""
    gone = listed.join(services.select(key), key, "left_anti").select(key, F.lit(False).alias("known"))
    return gone.union(listed.filter("checked").join(services.select(key), key, "left_semi").select(key, F.lit(True)))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("k = 1").drop("k")

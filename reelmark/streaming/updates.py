"""Streams of updates kept as tables.

Order is the order of arrival: the sources have no event time, so a stream names its own sequence column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelmark.operators.changes import snapshot_changes
from reelmark.operators.ranks import numbered
from reelmark.sources.storage import folder_files, removed, shared_folder
from reelmark.streaming import jobs


def files(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def latest_rows(feed: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order, as a running aggregate: write it in update or complete mode."""
    rest = [c for c in feed.columns if c != key]
    return feed.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(key, "last.*")


#: From each of the states a job can be in, and '' before it was added, the steps that lead on. Steps that aren't listed are refused.
STEPS = {
    "": {"add": "LogoPending", "reject": "PreFailed"},
    "LogoPending": {"ready": "Queue", "cancel": "Canceled"},
    "Queue": {"start": "Encoding", "unready": "LogoPending", "cancel": "Canceled", "retry": "LogoPending"},
    "Encoding": {"done": "Complete", "fail": "Failed", "cancel": "Canceled"},
    "Complete": {"retry": "LogoPending"},
    "Failed": {"retry": "LogoPending"},
    "Canceled": {"retry": "LogoPending"},
    "PreFailed": {},
}


def item_states(feed: DataFrame, shards: int = jobs.SHARDS) -> DataFrame:
    """feed: item long, seq long, op string. (item, state, changes) whenever an item's state changes.

    A job is added pending, or refused for good; it waits once its profile and mark are known and pends again when they no longer are; waiting
    jobs may start, active ones be cancelled, and what isn't running or refused may be retried, which starts over. Other steps are ignored.
    Items lie in shards, whose steps of a batch are walked side by side (see jobs.walked).
    """
    ops = sorted({op for steps in STEPS.values() for op in steps})
    names = list(STEPS)
    table = np.array([[names.index(steps[op]) if op in steps else -1 for op in ops] for steps in STEPS.values()])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [np.frombuffer(x, np.int64).copy() for x in state.get] if state.exists else [np.zeros(0, np.int64)] * 3
        batch = pd.concat(list(batches), ignore_index=True).sort_values("seq", kind="stable")
        items, states, changes = jobs.walked(*held, batch, table)
        state.update(tuple(x.tobytes() for x in (items, states, changes)))
        touched = np.searchsorted(items, batch["item"].unique())
        yield pd.DataFrame({"item": items[touched], "state": [names[x] for x in states[touched]], "changes": changes[touched]})

    known = F.array_position(F.array(*map(F.lit, ops)), F.col("op")).cast("int") - 1
    dealt = feed.select(F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int").alias("shard"), "item", "seq", known.alias("op")).filter("op >= 0")
    return dealt.groupBy("shard").applyInPandasWithState(step, "item long, state string, changes long", "items binary, states binary, changes binary", "update", GroupStateTimeout.NoTimeout)


def live_view(feed: DataFrame, key: str, order: str, gone: Column, sort: list[Column], name: str) -> DataFrame:
    """The last row of each key but those that are gone, sorted, as a list that shows them keeps them: whenever rows arrive the whole view is numbered anew (`position` from 0 on) and replaces the one before.

    Returns the view after all there is. The number of keys bounds what is written each time.
    """
    latest = latest_rows(feed, key, order)
    return run_to_end(latest, "complete", name, lambda batch: numbered(batch.filter(~gone), sort, "position"))


def new_files(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """(path, length, modified) of files as they appear in a folder; contents aren't read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def watched(spark: SparkSession, folder: str, suffixes: list[str], snapshot: str, previous: str | None = None) -> DataFrame:
    """(path, change) of a folder's files since the previous snapshot: added, removed, or changed by their time. What is there now is written as a snapshot."""
    folder_files(spark, folder, suffixes, recursive=True).select("path", "modified").write.parquet(snapshot)
    now = spark.read.parquet(snapshot)
    before = spark.read.schema(now.schema).parquet(previous) if previous else now.limit(0)
    return snapshot_changes(before, now, "path", ["modified"])


def look(spark: SparkSession, folder: str, suffixes: list[str], state: str, number: int) -> DataFrame:
    """The step of a watcher with a number: (path, change, number) since the step before, written below `state` beside what was seen.

    A step that is repeated, as after a failure, replaces itself and compares with the same step before; the folder may have changed in
    between, so it is looked at anew. Only the last two listings are kept.
    """
    seen = f"{state}/seen"
    listing = folder_files(spark, folder, suffixes, recursive=True).select("path", "modified", "length")
    listing.write.mode("overwrite").parquet(f"{seen}/{number}")
    now = spark.read.parquet(f"{seen}/{number}")
    before = spark.read.schema(now.schema).parquet(f"{seen}/{number - 1}") if number > 0 else now.limit(0)
    out = f"{state}/changes/number={number}"
    snapshot_changes(before, now, "path", ["modified", "length"]).select("path", "change").write.mode("overwrite").parquet(out)
    removed(spark, f"{seen}/{number - 2}")
    return spark.read.parquet(out).withColumn("number", F.lit(number))


def watch(spark: SparkSession, folder: str, suffixes: list[str], state: str, seconds: int, handle: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Looks at a folder every so many seconds until it is stopped, and hands on what changed. Batches of a clock are the steps, so a restart goes on with the step that failed."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return run_every(clock, seconds, lambda _, number: handle(look(spark, folder, suffixes, state, number)), checkpoint)


def run_every(result: DataFrame, seconds: int, save: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a stream that hands its batches on every so many seconds, until it is stopped."""
    return result.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def run_to_end(result: DataFrame, mode: str, name: str, shaped: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all there is and returns what it wrote last, as a table read back from the shared folder.

    Each batch is written whole to a folder of its own (complete mode) or added (update and append mode), so a repeated batch replaces itself.
    shaped: what becomes of a batch before it is written.
    """
    spark = result.sparkSession
    out, checkpoint = f"{shared_folder(spark)}/{name}", f"{shared_folder(spark)}/{name}-checkpoint"

    def save(batch: DataFrame, number: int) -> None:
        target = f"{out}/batch={0 if mode == 'complete' else number}"
        (shaped(batch) if shaped else batch).write.mode("overwrite").parquet(target)

    query = result.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)

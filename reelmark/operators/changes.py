"""Changes of catalogues: what differs between two snapshots, and feeds of updates applied to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, values: list[str], ignore_case: bool = False) -> DataFrame:
    """(key, change) for keys that were added, removed or whose values differ; one full outer join on the key, nulls compared as values."""
    match = F.lower if ignore_case else F.col
    own = lambda df, side: df.select(match(key).alias("k"), F.col(key).alias(f"{side}_key"), F.struct(*values).alias(f"{side}_value"))
    both = own(old, "old").join(own(new, "new"), "k", "full_outer")
    change = F.when(F.col("old_key").isNull(), "add").when(F.col("new_key").isNull(), "remove").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "change")
    return both.select(F.coalesce("new_key", "old_key").alias(key), change.alias("change")).filter("change is not null")


def apply_updates(feed: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """The rows a feed (op: add, update, remove) leaves: the values of each key's last update, unless the key was removed after it. An update of an unknown key adds it."""
    latest = feed.groupBy(key).agg(F.max_by(F.struct("op", *values), order).alias("last"))
    return latest.filter("last.op <> 'remove'").select(key, *[F.col(f"last.{v}").alias(v) for v in values])


def merge(table: DataFrame, feed: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """A table with a feed applied: keys the feed names take its outcome, others stay."""
    untouched = table.join(feed.select(key).distinct(), key, "left_anti").select(key, *values)
    return untouched.unionByName(apply_updates(feed, key, order, values))

"""Numbers, running sums and running maxima over a whole table in one order, without one task that sees all rows.

Rows are dealt to ranges of the order and written once; a range's rows are numbered where they are read, and what the ranges before it add
comes from one row a range. Ranges are as many as shuffle partitions, whatever the number of rows, so those rows may go through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmark.sources.storage import stored

#: Rows that one range can hold: the place within a range is the low part of Spark's increasing row number.
_PLACE_BITS = 33


def ranged(rows: DataFrame, order: list[Column], spread: Column | None = None) -> DataFrame:
    """The rows, written in order, with (_range, _place): ranges follow the order, places count from 0 in each.

    Rows that are alike in `order` share a range; `spread` is a further key that tells them apart where they may be many.
    """
    spark = rows.sparkSession
    keys = [*order, spread] if spread is not None else order
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    numbered = dealt.withColumn("_place", F.monotonically_increasing_id())
    ranges = numbered.withColumn("_range", F.shiftright("_place", _PLACE_BITS).cast("int")).withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
    return stored(ranges)


def carried(ranges: DataFrame, column: str, own: Column, combine: Callable[[int, int], int], start: int) -> DataFrame:
    """Adds `column`: what the aggregate `own` gives for all ranges before a row's own, combined in their order. One row a range goes through the driver."""
    found = {r["_range"]: r["own"] for r in ranges.groupBy("_range").agg(own.alias("own")).filter("own is not null").collect()}
    before = accumulate((found.get(k, start) for k in range(max(found, default=-1) + 1)), combine, initial=start)
    values = F.array(*[F.lit(int(v)).cast("long") for v in before])
    return ranges.withColumn(column, F.coalesce(F.get(values, F.col("_range")), F.lit(start).cast("long")))


def numbered(rows: DataFrame, order: list[Column], name: str, spread: Column | None = None) -> DataFrame:
    """Adds `name`, the row's number from 0 on in the order of the whole table."""
    before = carried(ranged(rows, order, spread), "_before", F.count("*"), lambda a, b: a + b, 0)
    return before.withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def numbered_within(rows: DataFrame, keys: list[str], order: list[Column], name: str, spread: Column | None = None) -> DataFrame:
    """Adds `name`, the row's number from 0 on among the rows of its keys, nulls being a key; a key may hold most rows."""
    whole = numbered(rows, [*[F.col(k) for k in keys], *order], "_whole", spread)
    starts = whole.groupBy(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]).agg(F.min("_whole").alias("_start"))
    same = [whole[k].eqNullSafe(starts[f"_key_{i}"]) for i, k in enumerate(keys)]
    return whole.join(starts, same).withColumn(name, F.col("_whole") - F.col("_start")).drop("_whole", "_start", *starts.columns)


def probed(keys: DataFrame, home: str, order: list[Column], name: str) -> DataFrame:
    """Adds `name`: the slot that each key gets by linear probing, its home slot or the first free one after it.

    keys: home (long) and whatever tells them apart, one row a key. The slots that are taken don't depend on the order of insertion; sorted
    by home, a key's slot is its number plus the running maximum of home less number, as no key stands before its home or shares a slot.
    Keys of one home take their slots in the given order.
    """
    placed = carried(ranged(keys, [F.col(home), *order]), "_before", F.count("*"), lambda a, b: a + b, 0)
    placed = placed.withColumn("_number", F.col("_before") + F.col("_place")).withColumn("_lead", F.col(home) - F.col("_number"))
    least = -(1 << 62)
    from_others = carried(placed, "_lead_before", F.max("_lead"), max, least)
    own = F.max("_lead").over(Window.partitionBy("_range").orderBy("_place"))
    return from_others.withColumn(name, F.col("_number") + F.greatest(own, F.col("_lead_before"))).drop("_range", "_place", "_before", "_number", "_lead", "_lead_before")


def counted_before(rows: DataFrame, order: list[Column], counts: Column, name: str) -> DataFrame:
    """Adds `name`: how many rows before this one, in the order of the whole table, satisfy `counts`."""
    ranges = ranged(rows, order)
    whole = carried(ranges, "_before", F.count_if(counts), lambda a, b: a + b, 0)
    own = F.count_if(counts).over(Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    return whole.withColumn(name, F.col("_before") + own).drop("_range", "_place", "_before")


def probed_beside(keys: DataFrame, home: str, order: list[Column], name: str, taken: DataFrame, slot: str) -> DataFrame:
    """probed() where some slots are taken already. taken: slot, each once.

    Without the taken ones the free slots are numbered through; there keys are probed as in an empty table, and what they get is turned
    back into slots. Both ways are counts of taken slots in one order of keys and slots together.
    """
    used = taken.select(F.col(slot).cast("long").alias("_at"), F.lit(None).cast("struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in keys.schema) + ">").alias("_key"))
    both = keys.select(F.col(home).cast("long").alias("_at"), F.struct(*keys.columns).alias("_key")).union(used)
    is_taken = F.col("_key").isNull()
    # Keys of a slot stand before it: a key's count is that of the taken slots below its home.
    free = counted_before(both, [F.col("_at"), is_taken], is_taken, "_below").withColumn("_free", F.col("_at") - F.col("_below"))
    placed = probed(free.filter(~is_taken).select("_key.*", F.col("_free")), "_free", [F.col(home), *order], "_index")
    again = placed.select(F.col("_index").alias("_at"), F.struct(*keys.columns).alias("_key")).union(free.filter(is_taken).select(F.col("_free").alias("_at"), "_key"))
    back = counted_before(again, [F.col("_at"), ~is_taken], is_taken, "_below").filter(~is_taken)
    return back.select("_key.*", (F.col("_at") + F.col("_below")).alias(name))


def zipped(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Two tables side by side by position: the k-th row of one beside the k-th of the other, as far as the shorter goes, with `position` from 0 on."""
    return numbered(left, left_order, "position").join(numbered(right, right_order, "position"), "position")

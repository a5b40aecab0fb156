"""Which job goes next: priority tiers, resource costs, packed resource keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of CPU and of disk there are; every job asks for a share of each.
MOST = 100


def packed(cpu: Column, hdd: Column, gpu: Column) -> Column:
    """Three numbers of 8 bits in one; larger ones run into each other."""
    return F.shiftleft(cpu, 16).bitwiseOR(F.shiftleft(hdd, 8)).bitwiseOR(gpu)


def unpacked(key: Column) -> list[Column]:
    return [F.shiftright(key, bits).bitwiseAND(255) for bits in (16, 8, 0)]


def freest(most: Column, used: Column) -> Column:
    """Index from 0 of the GPU with most room, the first on ties."""
    room = F.zip_with(most, used, lambda m, u: m - u)
    return (F.array_position(room, F.array_max(room)) - 1).cast("int")


def cost(requests: list[Column], used: list[Column], gpu_most: Column, gpu_used: Column) -> Column:
    """By how much a request would overrun its scarcest resource; 0 or less fits. requests: cpu, hdd, gpu; used: cpu, hdd."""
    gpu = freest(gpu_most, gpu_used)
    at = lambda a: F.element_at(a, gpu + 1)
    return F.greatest(used[0] + requests[0] - MOST, used[1] + requests[1] - MOST, at(gpu_used) + requests[2] - at(gpu_most))


def tier(priority: Column) -> Column:
    """Only the highest and the lowest priority are tiers of their own."""
    return F.when(priority >= 5, 0).when(priority >= 2, 1).otherwise(2)


def clamped(priority: Column) -> Column:
    """The priority that a job is queued with."""
    return F.greatest(F.lit(1), F.least(F.lit(5), priority))


def is_misplaced(priority: Column, key: Column, own_priority: Column, own_key: Column) -> Column:
    """A job stands under a priority or resource key that is no longer its own."""
    return (priority != own_priority) | (key != own_key)


def next_in_order(jobs: DataFrame, groups: list[str]) -> DataFrame:
    """The job that goes next where resources don't count: of the highest priority the head of the resource key that was queued first, which is the job queued first."""
    rest = [c for c in jobs.columns if c not in groups]
    return jobs.groupBy(*groups).agg(F.min_by(F.struct(*rest), F.struct(-F.col("priority"), F.col("position"))).alias("next")).select(*groups, "next.*")


def heads(jobs: DataFrame, groups: list[str]) -> DataFrame:
    """jobs: groups, resource_key, priority, position, cost and item. The first job of each resource key: highest priority, then position."""
    order = F.struct(-F.col("priority"), F.col("position"))
    rest = [c for c in jobs.columns if c not in (*groups, "resource_key")]
    best = jobs.groupBy(*groups, "resource_key").agg(F.min_by(F.struct(*rest), order).alias("head"))
    return best.select(*groups, "resource_key", "head.*")


def next_jobs(jobs: DataFrame, groups: list[str]) -> DataFrame:
    """The job that goes next in each group: of the best tier there, the head of the resource key that costs least; ties by priority and position."""
    by_tier = heads(jobs.withColumn("tier", tier(F.col("priority"))), [*groups, "tier"])
    order = F.struct("tier", "cost", -F.col("priority"), F.col("position"))
    rest = [c for c in by_tier.columns if c not in groups]
    return by_tier.groupBy(*groups).agg(F.min_by(F.struct(*rest), order).alias("next")).select(*groups, "next.*")


def admitted(waiting: DataFrame, groups: list[str]) -> DataFrame:
    """Adds `admitted`: a request fits, and no waiting one of its group costs less. Groups may be few and large, so their least costs are an aggregate, joined back."""
    least = waiting.groupBy(*groups).agg(F.min("cost").alias("least_cost"))
    return waiting.join(least, groups).withColumn("admitted", (F.col("cost") <= 0) & (F.col("cost") <= F.col("least_cost"))).drop("least_cost")


def moved(jobs: DataFrame, groups: list[str], moves: DataFrame) -> DataFrame:
    """jobs: groups, item, position from 0; moves: groups, item, to, one a group at most. Positions after the item was taken out and put in at `to`; a place that the list doesn't have is refused."""
    sizes = jobs.groupBy(*groups).agg(F.count("*").alias("size"))
    allowed = moves.join(sizes, groups).filter((F.col("to") >= 0) & (F.col("to") < F.col("size")))
    target = allowed.select(*groups, F.col("item").alias("moved_item"), "to").join(jobs.select(*groups, F.col("item").alias("moved_item"), F.col("position").alias("from")), [*groups, "moved_item"])
    both = jobs.join(target, groups, "left")
    return both.select(*groups, "item", F.when(F.col("from").isNull(), F.col("position")).otherwise(shifted(F.col("position"), F.col("from"), F.col("to"))).alias("position"))


def shifted(position: Column, start: Column, to: Column, size: Column | None = None) -> Column:
    """A position after the item at `start` was taken out and put in at `to`; where the list's size is given, a place that it doesn't have is refused."""
    moved_on = F.when(position == start, to).when((position > start) & (position <= to), position - 1).when((position < start) & (position >= to), position + 1).otherwise(position)
    return moved_on if size is None else F.when((to >= 0) & (to < size), moved_on).otherwise(position)


def moved_whole(queue: DataFrame, item: str, which: object, to: int) -> DataFrame:
    """queue: item, position from 0. One item of a queue of any length goes to place `to`; a place that the queue doesn't have is refused."""
    found = queue.agg(F.max(F.when(F.col(item) == which, F.col("position"))), F.count("*")).first()
    if found[0] is None or not 0 <= to < found[1]:
        return queue
    start, position = found[0], F.col("position")
    between = position.between(start + 1, to) if to > start else position.between(to, start - 1)
    return queue.withColumn("position", F.when(position == start, F.lit(to).cast("long")).when(between, position - (1 if to > start else -1)).otherwise(position))


def shown_workers(workers: DataFrame, running: str, place: str, parallel: int) -> DataFrame:
    """Of workers with places from 0 on the first `parallel`, and all up to the last one that runs."""
    last = workers.agg(F.max(F.when(F.col(running), F.col(place)))).first()[0]
    return workers.filter(F.col(place) < max(parallel, -1 if last is None else last + 1))


def lowest_free(used: DataFrame, groups: list[str], index: str) -> DataFrame:
    """The least number from 0 on that a group doesn't use: the first place where the sorted numbers skip their rank."""
    ranked = used.select(*groups, index).distinct().withColumn("k", F.row_number().over(Window.partitionBy(*groups).orderBy(index)) - 1)
    return ranked.groupBy(*groups).agg(F.coalesce(F.min(F.when(F.col(index) != F.col("k"), F.col("k"))), F.count("*")).cast("long").alias("free"))

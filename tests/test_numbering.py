"""Numbers, probing and positions over whole tables, and snapshots that a failing write leaves alone."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reelmark.operators import ranks, scheduling
from reelmark.sources import storage


def test_numbers_follow_the_order_of_the_whole_table(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), rng.choice([None, "a", "b", "é"]), i, 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "x int, k string, i int, number int").repartition(9)
    got = [r.i for r in sorted(ranks.numbered(df, [F.col("x"), F.col("i")], "at").collect(), key=lambda r: r["at"])]
    assert got == [r[2] for r in sorted(rows, key=lambda r: (r[0], r[2]))]
    within = ranks.numbered_within(df, ["k"], [F.col("x"), F.col("i")], "at").collect()
    for k in (None, "a", "b", "é"):
        own = sorted((r for r in within if r.k == k), key=lambda r: r["at"])
        assert [r["at"] for r in own] == list(range(len(own))) and [(r.x, r.i) for r in own] == sorted((r.x, r.i) for r in own)


def test_no_task_sees_all_rows(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    for found in (ranks.numbered(df, [F.col("x"), F.col("id")], "n"), ranks.probed(df.withColumn("home", F.col("id") % 13), "home", [F.col("id")], "slot")):
        assert "SinglePartition" not in found._jdf.queryExecution().toString()


def test_many_equal_keys_are_spread(spark):
    df = spark.range(4000).withColumn("x", F.lit(1))
    ranges = ranks.ranged(df, [F.col("x")], F.xxhash64("id")).groupBy("_range").count().collect()
    assert len(ranges) == 4 and max(r["count"] for r in ranges) < 2000
    assert sorted(r.n for r in ranks.numbered(df, [F.col("x")], "n", F.xxhash64("id")).select("n").collect()) == list(range(4000))


@pytest.mark.parametrize("slots", [1, 40, 300, 100000])
def test_probing_equals_insertion_one_by_one(spark, slots):
    rng = random.Random(slots)
    keys = [(f"k{i}", rng.randrange(slots)) for i in range(600)]
    df = spark.createDataFrame(keys, "key string, home long").repartition(5)
    taken = {}
    for key, home in sorted(keys, key=lambda x: (x[1], x[0])):
        while home in taken:
            home += 1
        taken[home] = key
    assert {r.slot: r.key for r in ranks.probed(df, "home", [F.col("key")], "slot").collect()} == taken
    rng.shuffle(keys)
    other = set()
    for _, home in keys:
        while home in other:
            home += 1
        other.add(home)
    assert other == set(taken)  # whatever the order of insertion


@pytest.mark.parametrize(("slots", "n_taken"), [(1, 5), (40, 30), (300, 250), (100000, 200)])
def test_probing_goes_round_taken_slots(spark, slots, n_taken):
    rng = random.Random(slots + 1)
    taken = set(rng.sample(range(slots + n_taken), n_taken))
    keys = [(f"k{i}", rng.randrange(slots)) for i in range(400)]
    used = dict.fromkeys(taken)
    for key, home in sorted(keys, key=lambda x: (x[1], x[0])):
        while home in used:
            home += 1
        used[home] = key
    got = ranks.probed_beside(spark.createDataFrame(keys, "key string, home long").repartition(5), "home", [F.col("key")], "slot", spark.createDataFrame([(x,) for x in taken], "slot int"), "slot").collect()
    assert {r.slot: r.key for r in got} == {s: k for s, k in used.items() if s not in taken}
    assert all((r.key, r.home) in keys for r in got)


def test_nothing_to_number(spark):
    none = spark.createDataFrame([], "x int, home long")
    assert ranks.numbered(none, [F.col("x")], "n").collect() == [] and ranks.probed(none, "home", [F.col("x")], "n").collect() == []
    assert ranks.zipped(none, spark.range(3), [F.col("x")], [F.col("id")]).collect() == []


def test_lists_are_zipped_as_far_as_the_shorter_goes(spark):
    a = spark.createDataFrame([(x,) for x in "dbca"], "x string")
    got = ranks.zipped(a, spark.range(10, 40), [F.col("x")], [F.col("id").desc()]).collect()
    assert sorted((r.position, r.x, r.id) for r in got) == [(0, "a", 39), (1, "b", 38), (2, "c", 37), (3, "d", 36)]


@pytest.mark.parametrize(("which", "to"), [(0, 5), (5, 0), (3, 3), (9, 9), (2, 10), (2, -1), (77, 1)])
def test_moves_in_one_list(spark, which, to):
    queue = spark.range(10).select("id", F.col("id").alias("position"))
    items = list(range(10))
    if which in items and 0 <= to < 10:
        items.insert(to, items.pop(which))
    got = scheduling.moved_whole(queue, "id", which, to).orderBy("position").collect()
    assert [r.id for r in got] == items


def test_snapshots_are_replaced_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "queue")
    storage.write_snapshot(spark.range(10), path)
    broken = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error("stop")).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        storage.write_snapshot(broken, path)
    assert storage.read_snapshot(spark, path).count() == 10
    reader = storage.read_snapshot(spark, path)
    for n in (3, 4):
        storage.write_snapshot(spark.range(n), path)
        assert storage.read_snapshot(spark, path).count() == n
        if n == 3:
            assert reader.count() == 10  # a reader of the version before isn't disturbed
    assert len([x for x in (tmp_path / "queue").iterdir() if x.name.startswith("v-")]) == 2


def test_stored_tables_can_be_forgotten(spark, tmp_path):
    assert storage.stored(spark.range(3)).count() == 3
    assert storage.forget_stored(spark) and not storage.forget_stored(spark)

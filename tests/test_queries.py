"""Every query of the library beside its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reelmark import plans
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(name, spark, small):
    assert differences(plans.QUERIES[name], plans.ORACLE_SQL[name], spark, small) == ""


def test_events_without_a_slot(spark, tmp_path):
    """Of no length at the very start of a slot, and ordinary ones."""
    rows = [(k, "2024-01-01 00:05:00" if k < 6 else "2024-01-01 00:07:03.5", v) for k, v in enumerate((0.0, 0.01, 300.0, 0.0, 0.02, 560.21, 0.0, 0.01, 3.0, None))]
    events = spark.createDataFrame(rows, "event_id long, ts string, value double").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert differences(plans.QUERIES["time_slots"], plans.ORACLE_SQL["time_slots"], spark, str(tmp_path)) == ""


def test_codes_of_large_keys(spark, tmp_path):
    """Codes beyond an int, and beyond 32 bits."""
    keys = (0, 1, 9, 17, 271186, 271187, 542362, 542363, 7199999, 1 << 40)
    spark.createDataFrame([(k, f"small {k}", "Brand#1", "ECONOMY", 1, 900.0) for k in keys], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    assert differences(plans.QUERIES["name_codes"], plans.ORACLE_SQL["name_codes"], spark, str(tmp_path)) == ""


def test_every_sql_has_its_query():
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_frames_are_dealt_by_their_number_and_never_broadcast(spark, small, monkeypatch):
    """Stored frames take little room on disk, so Spark would broadcast them whole."""
    from reelmark.operators import series

    monkeypatch.setattr(series, "TASK_FRAMES", 60)
    query = plans.QUERIES["section_to_frames"]
    assert "Broadcast" not in query(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plans.QUERIES["logo_sections"](spark, small)._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 0
    frames = spark.range(1000)
    assert series.tasks_of(frames) == 17 and series.tasks_of(frames.limit(10)) == 4
    assert differences(query, plans.ORACLE_SQL["section_to_frames"], spark, small) == ""


def test_planes_of_few_recordings_are_worked_on_by_many_tasks(spark, small, monkeypatch):
    """Recordings are five, so tasks by recording would be five at most."""
    from reelmark.plans import scan

    monkeypatch.setattr(scan, "TASK_PLANES", 20)
    frames = scan.recordings(spark, small)
    assert frames.rdd.getNumPartitions() == -(-frames.count() // 20)

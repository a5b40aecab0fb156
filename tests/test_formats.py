"""Line files as data sources: split at any byte, written whole or not at all."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reelmark.sources import formats


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_ranges_of_any_size_read_every_line_once(spark, tmp_path, size):
    rng = random.Random(size)
    formats.register(spark)
    lines = {}
    for name in ("a.txt", "b.txt"):
        text = b"".join(rng.choice([b"x", b"", b"f" * 128 + b"  n", b"long " * 20]) + rng.choice([b"\n", b"\r\n"]) for _ in range(12)) + rng.choice([b"", b"open end"])
        (tmp_path / name).write_bytes(text)
        at, own = 0, text.split(b"\n")
        for k, line in enumerate(own):
            if k < len(own) - 1 or line:
                lines[name, at] = line.rstrip(b"\r").decode()
            at += len(line) + 1
    (tmp_path / "_skipped").write_bytes(b"no\n")
    got = spark.read.format("hash_manifest").option("rangeBytes", size).load(str(tmp_path)).collect()
    assert len(got) == len(lines)
    assert {(r.file, r.place): r.name if r.digest is None else f"{r.digest}  {r.name}" for r in got} == lines


def test_manifests_and_sections_come_back(spark, tmp_path):
    formats.register(spark)
    rows = spark.range(40).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.repeat(F.lpad(F.hex("id"), 2, "0"), 64).alias("digest"))
    for part in (rows.filter("id < 10"), rows.filter("id >= 10")):
        part.repartition(3).write.format("hash_manifest").mode("append").save(str(tmp_path / "m"))
    read = spark.read.format("hash_manifest").load(str(tmp_path / "m"))
    assert sorted((r.name, r.digest) for r in read.collect()) == sorted((r["name"], r.digest.lower()) for r in rows.collect())
    rows.limit(2).write.format("hash_manifest").mode("overwrite").save(str(tmp_path / "m"))
    assert spark.read.format("hash_manifest").load(str(tmp_path / "m")).count() == 2
    found = spark.createDataFrame([(5, True, 3, 9), (100, False, 90, 120)], "best long, is_start boolean, start long, end long")
    found.write.format("section_list").mode("append").save(str(tmp_path / "s"))
    assert sorted(map(tuple, spark.read.format("section_list").load(str(tmp_path / "s")).drop("file", "place").collect())) == sorted(map(tuple, found.collect()))


def test_a_failing_write_leaves_nothing(spark, tmp_path):
    formats.register(spark)
    good = spark.createDataFrame([("a", "0" * 128)], "name string, digest string")
    good.write.format("hash_manifest").mode("append").save(str(tmp_path / "m"))
    bad = spark.range(0, 8, 1, 4).select(F.when(F.col("id") == 7, F.raise_error("stop").cast("string")).otherwise("x").alias("name"), F.lit("1" * 128).alias("digest"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("hash_manifest").mode("append").save(str(tmp_path / "m"))
    assert [(r.name, r.digest) for r in spark.read.format("hash_manifest").load(str(tmp_path / "m")).collect()] == [("a", "0" * 128)]
    assert len(list((tmp_path / "m").iterdir())) == 1

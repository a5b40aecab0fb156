"""Scans and erasing against plain loops, and against what the recordings were made with."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reelmark.operators import erasing, marks, pixels, scan
from reelmark.plans import scan as plans


def test_backgrounds_equal_plain_loops(spark):
    rng = random.Random(6)
    shape = scan.Shape(7, 6)
    rows = [(k, *[[float(rng.randrange(100, 104 + k % 5)) for _ in range(w * h)] for w, h in shape.planes().values()]) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, py array<double>, pu array<double>, pv array<double>")
    got = {r.k: (r.bg_y, r.bg_u, r.bg_v) for r in scan.measured(df, shape, 5).collect()}
    expected = {}
    for k, *planes in rows:
        backs = []
        for values, (w, h) in zip(planes, shape.planes().values(), strict=True):
            edge = sorted(v for i, v in enumerate(values) if i % w in (0, w - 1) or i // w in (0, h - 1))
            middle = edge[len(edge) // 4 : len(edge) - len(edge) // 4]
            backs.append(float(int((sum(middle) + len(middle) // 2) / len(middle))) if edge[-1] - edge[0] <= 5 else None)
        if None not in backs:
            expected[k] = tuple(backs)
    assert 0 < len(expected) < 40 and got == expected


def test_faint_lines_go_over_planes_of_different_size(spark):
    rng = random.Random(7)
    shape = scan.Shape(6, 4)
    line = lambda: (1.0 + rng.choice([0, 0, 0.01, 0.05]), float(rng.choice([0, 0, -0.01])))
    planes = {p: [line() for _ in range(w * h)] for p, (w, h) in shape.planes().items()}
    df = spark.createDataFrame([(1, *[[x[k] for x in planes[p]] for p in "yuv" for k in range(2)])], "key int, a_y array<double>, b_y array<double>, a_u array<double>, b_u array<double>, a_v array<double>, b_v array<double>")
    r = scan.cleaned(df, shape).first()
    far = lambda a, b: (a - 1) ** 2 / 3 + (a - 1) * b + b * b
    faint = [1000 * sum(far(*planes[p][i if p == "y" else i // 6 // 2 * 3 + i % 6 // 2]) for p in "yuv") < scan.FAINT for i in range(24)]
    assert any(faint) and not all(faint)
    for p in "yuv":
        for j, own in enumerate(planes[p]):
            gone = faint[j] if p == "y" else any(faint[(j // 3 * 2 + dy) * 6 + j % 3 * 2 + dx] for dy in range(2) for dx in range(2))
            assert (r[f"a_{p}"][j], r[f"b_{p}"][j]) == ((1.0, 0.0) if gone else own)


def test_strengths_equal_single_ones(spark):
    rng = random.Random(8)
    w = h = 8
    rows = [(1, [rng.uniform(1, 1.5) for _ in range(64)], [rng.uniform(-0.1, 0) for _ in range(64)], [float(rng.randrange(256)) for _ in range(64)])]
    made = marks.prepared(spark.createDataFrame(rows, "k int, a array<double>, b array<double>, v array<double>"), w, h, 0.35)
    fades = [0.0, 0.3, 1.0]
    off = lambda fade: F.transform(F.arrays_zip("v", "a", "b"), lambda p: fade * (p["a"] * p["v"] + p["b"] * 255) + (1 - fade) * p["v"])
    single = [marks.strength(off(f), F.col("points"), w).alias(f"s{k}") for k, f in enumerate(fades)]
    r = made.select(marks.strengths(F.col("v"), F.col("a"), F.col("b"), F.col("points"), w, F.array(*map(F.lit, fades))).alias("all"), *single).first()
    assert r["all"] == pytest.approx([r.s0, r.s1, r.s2], abs=1e-9)


def test_erasing_gives_the_background_back(spark, small):
    """Frames of the middle of a section are restored to their plain background, but for noise."""
    frames = plans.recordings(spark, small)
    found = plans._given_mark(spark, small)
    whole = frames.select("series_id", "n", F.lit(1.0).alias("fade_top"), F.lit(1.0).alias("fade_bottom"))
    shown = frames.filter("n % 40 between 14 and 29")
    out = erasing.erased(shown, found, whole, plans.SHAPE, plans.IMAGE_Y).collect()
    assert out
    for r in out:
        for p in (r.py, r.pu, r.pv):
            assert max(p) - min(p) <= 12
    field = erasing.erased(shown, found, whole.withColumn("fade_bottom", F.lit(0.0)), plans.SHAPE, plans.IMAGE_Y).alias("o").join(shown.alias("s"), ["series_id", "n"]).select("o.py", "o.pu", F.col("s.py").alias("sy"), F.col("s.pu").alias("su")).first()
    assert all(field.py[i] == field.sy[i] for i in range(96) if i // 8 % 2 == 1)
    assert all(field.pu[i] == field.su[i] for i in range(24) if i // 4 % 2 == 0)  # the other way round where planes begin at an odd pair of rows


def test_fields_of_a_plane(spark):
    r = spark.range(1).select(pixels.field_of(F.array(*map(F.lit, range(12))), 3, 1).alias("f")).first()
    assert r.f == [3, 4, 5, 9, 10, 11]

"""Marks beside a plain walk over their pixels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmark.operators import marks

W = H = 10
RATIO = 0.3


def near(picture, x, y):
    return picture[y - 2 : y + 3, x - 2 : x + 3]


def down(p, bias=0):
    out = p.astype(float).copy()
    out[1:-1] = (p[:-2] + 2 * p[1:-1] + p[2:] + bias) / 4
    return out


def plain(frame, a, b):
    """What a frame answers to a mark, as it is and with the mark taken off, in parts of what black answers."""
    a, b, v = down(a), down(b), down(frame, 2)
    levels = [(8 * c - b * 255) / a for c in range(32)]
    inner = [(y, x) for y in range(2, H - 2) for x in range(2, W - 2)]
    spread = {(y, x): round(float(((near(levels[16], x, y) - near(levels[16], x, y).mean()) ** 2).sum()), 9) for y, x in inner}
    every = sorted(((spread.get((y, x), 0.0), y * W + x) for y in range(H) for x in range(W)), reverse=True)
    chosen = sorted((i // W, i % W) for _, i in every[: int(W * H * RATIO)] if (i // W, i % W) in spread)
    kernels = {p: near(levels[0], p[1], p[0]) - near(levels[0], p[1], p[0]).mean() for p in chosen}
    answer = lambda p, pic: float((kernels[p] * (near(pic, p[1], p[0]) - near(pic, p[1], p[0]).mean())).sum())
    table = {p: [abs(answer(p, level)) for level in levels] for p in chosen}
    limit = sum(map(sum, table.values())) / (int(W * H * RATIO) * 32) * 0.2

    def score(pic):
        out = 0.0
        for p in chosen:
            c = table[p][int(min(255, max(0, near(pic, p[1], p[0]).mean()))) // 8]
            out += max(-1.0, min(1.0, answer(p, pic) / c if c > 0 else 0.0)) * min(1.0, c / limit)
        return out

    return score(v) / score(levels[2]), score(a * v + b * 255) / score(levels[2])


def rows(frames, lines, spark):
    f = spark.createDataFrame([(0, n, [float(x) for x in v.ravel()]) for n, v in enumerate(frames)], "k int, n int, v array<double>")
    m = spark.createDataFrame([(0, n, [float(x) for x in a.ravel()], [float(x) for x in b.ravel()]) for n, (a, b) in enumerate(lines)], "k int, mark int, a array<double>, b array<double>")
    return f, m


def test_evaluation_is_that_of_a_plain_walk(spark):
    rng = np.random.default_rng(3)
    a, b = 1 + rng.integers(0, 12, (H, W)) / 16, -rng.integers(0, 9, (H, W)) / 32
    plane = np.full((H, W), 90.0)
    shown = np.floor((plane - b * 255) / a)
    f, m = rows([plane, shown, rng.integers(0, 256, (H, W)).astype(float)], [(a, b), (np.ones((H, W)), np.zeros((H, W))), (np.ones((4, 4)), np.zeros((4, 4)))], spark)
    got = {(r["n"], r["mark"]): (r["corr0"], r["corr1"]) for r in marks.evaluated(f, m, ["k"], W, H, RATIO).collect()}
    assert len(got) == 9
    for n, v in enumerate([plane, shown]):
        assert got[n, 0] == pytest.approx(plain(v, a, b), abs=1e-6)
    assert got[1, 0][0] > 0.5 > 0.2 > abs(got[1, 0][1])
    assert all(got[n, 1] == (None, None) for n in range(3))  # a mark that changes nothing shows nowhere
    assert all(got[n, 2] == (0.0, -1.0) for n in range(3))  # one of another size


def test_a_mark_is_found_again(spark):
    rng = np.random.default_rng(4)
    a, b = np.ones((H, W)), np.zeros((H, W))
    a[3:7, 3:7], b[3:7, 3:7] = 1 + rng.integers(4, 12, (4, 4)) / 16, -rng.integers(1, 9, (4, 4)) / 32
    backs = rng.integers(20, 230, 80)
    frames = [np.floor((back - b * 255) / a + 0.5) if n % 4 else np.full((H, W), float(back)) for n, back in enumerate(backs)]
    f, _ = rows(frames, [], spark)
    f = f.join(spark.createDataFrame([(n, float(back)) for n, back in enumerate(backs)], "n int, background double"), "n")
    found = marks.found_mark(f, ["k"], W, H).collect()
    assert len(found) == 1
    assert np.allclose(np.array(found[0]["a"]), a.ravel(), atol=0.02) and np.allclose(np.array(found[0]["b"]), b.ravel(), atol=0.02)


def test_a_scan_stops_at_the_first_valid_frames(spark):
    frames = spark.createDataFrame([(k, n, n % 3 != 0) for k in (0, 1) for n in range(10 if k else 3)], "k int, n int, ok boolean")
    taken = marks.first_valid(frames, ["k"], "n", F.col("ok"), 4)
    assert sorted((r["k"], r["n"]) for r in taken.collect()) == [(0, 1), (0, 2), (1, 1), (1, 2), (1, 4), (1, 5)]

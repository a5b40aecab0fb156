"""Frame series against a procedure that walks over the frames one by one."""

from __future__ import annotations

import random

import pytest

from reelmark.operators import series


def walk(scores: list[float], fps: int) -> tuple[list[int], list[float], list[tuple[int, ...]]]:
    """Labels, smoothed scores and sections, found by loops."""
    average, median, n = series.half_window(fps, 1.0), series.half_window(fps, 0.5), len(scores)
    at = lambda k: scores[min(max(k, 0), n - 1)]
    three = lambda v, t: 1 if abs(v) < t else 0 if v < 0 else 2
    labels, smooth = [], []
    for i in range(n):
        low = min(max(at(k) for k in range(i - average, i)), max(at(k) for k in range(i + 1, i + average + 1)))
        mean = round(sum(at(k) for k in range(i - average, i + average + 1)) / (2 * average + 1), 9)
        a, b = three(low, 0.5), three(mean, 0.2)
        labels.append(a if a == b else 1)
        smooth.append(sorted(at(k) for k in range(i - median, i + median + 1))[median])
    i = 0
    while i < n:
        if labels[i] != 1:
            i += 1
            continue
        j = i
        while j < n and labels[j] == 1:
            j += 1
        before, after = labels[i - 1] if i else 0, labels[j] if j < n else 0
        if before == after:
            labels[i:j] = [before] * (j - i)
        i = j
    found, it = [], 0
    while it < n:
        s = next((k for k in range(it, n) if labels[k] == 2), n)
        e_first = e = next((k for k in range(s, n) if labels[k] == 0), n)
        if s < n:
            if smooth[s] >= 0.2:
                s = next((k + 1 for k in range(s - 1, -1, -1) if smooth[k] < 0.2), 0)
            else:
                s = next((k for k in range(s, n) if smooth[k] >= 0.2), n)
        if e < n:
            if smooth[e] <= -0.2:
                e = next((k + 1 for k in range(e - 1, s - 1, -1) if smooth[k] > -0.2), s)
            else:
                e = next((k for k in range(e, n) if smooth[k] <= -0.2), n)
        s_start = next((k + 1 for k in range(s - 1, it - 1, -1) if smooth[k] <= -0.2), it)
        e_start = next((k + 1 for k in range(e - 1, s - 1, -1) if smooth[k] >= 0.2), s)
        s_best = next((k for k in range(s_start, s) if smooth[k] > 0), s)
        e_best = next((k + 1 for k in range(e - 1, e_start - 1, -1) if smooth[k] > 0), e_start)
        if s != e:
            found.append((s_best, s_start, s, e_best - 1, e_start - 1, e - 1))
        it = max(e_first, it + 1)
    return labels, smooth, found


def cases() -> list[list[float]]:
    rng = random.Random(5)
    steps = [[1.0] * 40, [-1.0] * 40, [0.0] * 40, [-1.0] * 30 + [1.0] * 30, [1.0] * 30 + [-1.0] * 30, [-0.8] * 20 + [0.9] * 3 + [-0.8] * 20, [0.7]]
    noise = [[round(rng.choice((-0.8, 0.0, 0.8)) + rng.uniform(-0.3, 0.3), 3) for _ in range(120)] for _ in range(4)]
    blocks = [[v for _ in range(12) for v in [rng.choice((-0.9, -0.1, 0.1, 0.9))] * rng.randint(3, 25)] for _ in range(6)]
    return steps + noise + blocks


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(s, n, max(v, 0.0), min(v, 0.0)) for s, scores in enumerate(cases()) for n, v in enumerate(scores)]
    return spark.createDataFrame(rows, "series_id long, n long, corr0 double, corr1 double")


def test_labels_and_sections_equal_the_walk(frames):
    labelled = series.frame_labels(frames, 12).cache()
    got = {(r.series_id, r.n): (r.label, round(r.score, 9)) for r in labelled.collect()}
    sections = sorted(tuple(r) for r in series.sections(labelled).collect())
    expected = []
    for s, scores in enumerate(cases()):
        labels, smooth, found = walk(scores, 12)
        assert [got[s, n] for n in range(len(scores))] == [(x, round(y, 9)) for x, y in zip(labels, smooth, strict=True)], s
        expected += [(s, *f) for f in found]
    assert sections == sorted(expected)


def test_later_sections_win(spark):
    frames = spark.range(12).selectExpr("cast(1 as long) as series_id", "id as n")
    found = spark.createDataFrame([(1, 1, 1, 2, 5, 5, 6), (1, 6, 6, 7, 9, 9, 10)], "series_id long, s_best long, s_start long, s_end long, e_best long, e_start long, e_end long")
    labels = [r.label for r in series.section_labels(frames, found).orderBy("n").collect()]
    assert labels == [0, 1, 2, 2, 2, 2, 1, 2, 2, 2, 1, 0]


def test_ties_take_the_first_candidate(spark):
    rows = [(1, n, logo, 0.5, 0.1) for n in range(4) for logo in ("b", "a")] + [(1, n, "c", 0.1, 0.9) for n in range(4)]
    best = series.best_candidate(series.candidate_scores(spark.createDataFrame(rows, "series_id long, n long, logo string, corr0 double, corr1 double"))).first()
    assert (best.logo, best.ratio) == ("a", 1.0)


def test_without_detections_there_is_no_score(spark):
    rows = [(1, 0, "a", 0.0, 0.9)]
    best = series.best_candidate(series.candidate_scores(spark.createDataFrame(rows, "series_id long, n long, logo string, corr0 double, corr1 double"))).first()
    assert (best.logo, best.score, best.ratio) == ("a", None, 0.0)

"""Document quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds turn its score f into
P(grade > k) = 1 / (1 + exp(thresholds[k] - f)). The expected grade is the sum of these; the tail probability P(grade > cut) selects.

A document's features are the distinct words (letters, lower-cased) and their first four bytes, runs of other marks and a few binned
figures of its whole text: share of capitals, of marks, of repeated words, and length. Each counts once, so one telling word weighs as
much in a long text. Only features that go with the grade far beyond chance get a weight (`screen`), so rare words can't be learnt by heart.

The model is fitted on at most FIT_DOCUMENTS rated documents, the first by a hash of doc_id, and as many of these as have FIT_FEATURES features
together (both parameters); everything else covers all.

Defined cases: null and empty text have the bins alone and are scored like any text; a document rated twice takes its lowest grade,
of several texts of it the one of least hash is learned from; ratings without a document or with a null are ignored; without any ratings the model is flat and every document is kept; texts of any
length are read whole; repeated rows are scored alike; other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.llm.common import Hasher, distinct, extended, mixed, steps, stored, text_bytes

BITS = 20
FIT_DOCUMENTS, FIT_FEATURES = 16_000, 40_000_000
GRADES = 3
#: P(grade > CUT_GRADE) must reach CUT_PROBABILITY for a document to be kept.
CUT_GRADE, CUT_PROBABILITY = 1, 0.7

_LETTER, _MARK = 1, 2
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(column: pa.Array, bits: int = BITS, used: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: sorted distinct feature numbers of each, end to end, and offsets; of all features or those that `used` marks."""
    data, offsets = text_bytes(column)
    for first, last in steps(np.diff(offsets)):
        part = data[offsets[first] : offsets[last]].copy()
        bounds = offsets[first : last + 1] - offsets[first]
        capital = (part >= 65) & (part < 91)
        lead = np.flatnonzero(part[:-1] == 0xC3)  # capitals of Latin-1: their second byte is 80 to 9E
        high = lead[(part[lead + 1] >= 0x80) & (part[lead + 1] <= 0x9E)] + 1
        part = _LOWER[part]
        part[high] += 32
        capital[high] = True
        kind = _CLASS[part]
        cuts = np.concatenate(([0], np.flatnonzero((kind[1:] != kind[:-1])) + 1, bounds)) if len(part) else np.zeros(1, np.int64)
        cuts = distinct(cuts)
        starts, ends = cuts[:-1], cuts[1:]
        solid = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
        starts, ends = starts[solid], ends[solid]
        hasher = Hasher(part)
        tokens = hasher.hashes(starts, ends)
        at = np.searchsorted(starts, bounds)
        n_bytes = np.maximum(np.diff(bounds), 1)
        counted = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[bounds])
        same = np.zeros(len(tokens), bool)
        words = np.flatnonzero(kind[starts] == _LETTER)
        same[words[1:]] = tokens[words[1:]] == tokens[words[:-1]]
        n_words = np.diff(np.searchsorted(words, at))
        figures = [
            np.floor(20 * counted(capital) / n_bytes),
            np.floor(20 * counted(kind == _MARK) / n_bytes),
            np.floor(10 * np.diff(np.concatenate(([0], np.cumsum(same)))[at]) / np.maximum(n_words, 1)),
            np.floor(2 * np.log2(n_words + 1)),
        ]
        binned = np.stack([mixed(np.uint64(1000 * (k + 1)) + x.astype(np.uint64)) for k, x in enumerate(figures)], 1) >> np.uint64(64 - bits)
        row = np.repeat(np.arange(last - first), np.diff(at))
        long = words[ends[words] - starts[words] > 4]
        heads = mixed(hasher.hashes(starts[long], starts[long] + 4) + np.uint64(1))
        row = np.concatenate((row, row[long]))
        numbers = (np.concatenate((tokens, heads)) >> np.uint64(64 - bits)).astype(np.int64)
        if used is not None:
            row, numbers = row[used[numbers]], numbers[used[numbers]]
        keys = np.concatenate(((row << bits) | numbers, ((np.arange(last - first) << bits)[:, None] | binned.astype(np.int64)).ravel()))
        keys = distinct(keys)
        yield keys & ((1 << bits) - 1), np.searchsorted(keys, np.arange(last - first + 1) << bits)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for numbers, offsets in features(column, int(len(self.weights)).bit_length() - 1, self.weights != 0):
            sums = np.concatenate(([0.0], np.cumsum(self.weights[numbers], dtype=np.float64)))
            out.append(sums[offsets[1:]] - sums[offsets[:-1]])
        return np.concatenate(out) if out else np.zeros(0)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) in column k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def _occurrences(numbers: np.ndarray, offsets: np.ndarray, documents: int = 1000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and the documents they stand in, some documents at a time, so that a large sample takes little memory beside itself."""
    for first in range(0, len(offsets) - 1, documents):
        ends = offsets[first : first + documents + 1]
        yield numbers[ends[0] : ends[-1]], np.repeat(np.arange(first, first + len(ends) - 1), np.diff(ends))


def screen(numbers: np.ndarray, offsets: np.ndarray, grades: np.ndarray, levels: int, bits: int, rarest: int = 8, least: float = 6.0) -> np.ndarray:
    """Features of at least `rarest` documents that shift the odds of passing some grade, among those that reached it, by `least` standard errors."""
    good = np.zeros(1 << bits, bool)
    for k in range(levels - 1):
        share = np.clip(np.mean(grades[grades >= k] > k), 1e-4, 1 - 1e-4) if (grades >= k).any() else 0.5
        n, passed = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        for own, rows in _occurrences(numbers, offsets):
            n += np.bincount(own[grades[rows] >= k], minlength=1 << bits).astype(np.int32)
            passed += np.bincount(own[grades[rows] > k], minlength=1 << bits).astype(np.int32)
        good |= (n >= rarest) & (np.abs(passed - n * share) >= least * np.sqrt(np.maximum(n, 1) * share * (1 - share)))
    return np.flatnonzero(good)


def fit_ordinal(numbers: np.ndarray, offsets: np.ndarray, grades: np.ndarray, levels: int, bits: int = BITS, passes: int = 500, ridge: float = 0.002) -> OrdinalModel:
    """Maximum likelihood over the screened features with a ridge penalty, by Adam on the whole sample."""
    used = screen(numbers, offsets, grades, levels, bits)
    slot = np.full(1 << bits, -1, np.int64)
    slot[used] = np.arange(len(used))
    kept = [(slot[own][slot[own] >= 0], rows[slot[own] >= 0]) for own, rows in _occurrences(numbers, offsets)]
    columns, rows = (np.concatenate([x[k] for x in kept]) if kept else np.zeros(0, np.int64) for k in range(2))
    n = max(1, len(grades))
    w = np.zeros(len(used))
    share = np.array([np.clip(np.mean(grades > k), 1e-3, 1 - 1e-3) if len(grades) else 1 - 1e-3 for k in range(levels - 1)])
    first = np.log((1 - share) / share)
    steps_between = np.log(np.maximum(np.diff(first), 1e-2))
    x = np.concatenate((w, first[:1], steps_between))  # thresholds: the first, then logs of positive distances
    m, v = np.zeros_like(x), np.zeros_like(x)
    p = len(used)
    if len(grades) and grades.min() < grades.max():
        for t in range(1, passes + 1):
            gaps = np.exp(x[p + 1 :])
            theta = x[p] + np.concatenate(([0.0], np.cumsum(gaps)))
            score = np.bincount(rows, x[columns], len(grades))
            tail = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -50, 50)))
            above = np.concatenate((np.ones((n, 1)), tail, np.zeros((n, 1))), 1)
            slope = np.concatenate((np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))), 1)
            i = np.arange(n)
            likely = np.maximum(above[i, grades] - above[i, grades + 1], 1e-12)
            d_score = -(slope[i, grades] - slope[i, grades + 1]) / likely / n
            d_theta = np.zeros(levels - 1)
            for k in range(levels - 1):
                d_theta[k] = (np.sum((slope[:, k + 1] / likely)[grades == k + 1]) - np.sum((slope[:, k + 1] / likely)[grades == k])) / n
            g = np.concatenate((np.bincount(columns, d_score[rows], p) + ridge / n * x[:p], [d_theta.sum()], np.cumsum(d_theta[::-1])[::-1][1:] * gaps))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            x = x - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << bits, np.float32)
    weights[used] = x[:p]
    return OrdinalModel(weights, x[p] + np.concatenate(([0.0], np.cumsum(np.exp(x[p + 1 :])))))


def grade(quality: Column, toxic: Column) -> Column:
    """The graded rating: 0 poor, 1 good but toxic, 2 good and clean."""
    return F.when(quality == 0, 0).when(toxic == 1, 1).otherwise(2)


def train(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS, bits: int = BITS, fit_features: int = FIT_FEATURES) -> OrdinalModel:
    """Fits on the first `fit_documents` rated documents by hash of doc_id, as far as they have `fit_features` features; these come to the driver as numbers."""
    rated = (
        labels.filter("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min(grade(F.col("quality"), F.col("toxic"))).alias("grade"))
    )
    chosen = F.broadcast(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_documents))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).join(chosen, "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [numbers[a:b].astype(np.int32) for numbers, at in features(batch["text"], bits) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], batch["grade"], pa.array([x.tobytes() for x in lists], pa.binary())], ["doc_id", "text_key", "grade", "numbers"])

    found = texts.select(F.col("doc_id").cast("long"), "text_key", F.col("grade").cast("int"), "text").mapInArrow(extract, "doc_id long, text_key long, grade int, numbers binary")
    sample = stored(found.groupBy("doc_id").agg(F.min_by(F.struct("grade", "numbers"), "text_key").alias("row")).select("doc_id", F.xxhash64("doc_id").alias("turn"), "row.grade", "row.numbers"))
    # Two numbers a document first, to see how many documents the driver has room for.
    sizes = sorted((r["turn"], r["doc_id"], r["n"]) for r in sample.select("turn", "doc_id", (F.octet_length("numbers") / 4).cast("long").alias("n")).collect())
    last = int(np.searchsorted(np.cumsum([n for *_, n in sizes]), fit_features, "right"))
    if last < len(sizes):
        turn, doc_id, _ = sizes[last]
        sample = sample.filter((F.col("turn") < turn) | (F.col("turn") == turn) & (F.col("doc_id") < doc_id))
    rows = sample.select("doc_id", "grade", "numbers").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    grades, parts = rows["grade"].to_numpy().astype(np.int64)[order], rows["numbers"].take(pa.array(order)).combine_chunks() if len(order) else []
    del rows
    lists = [np.frombuffer(x.as_buffer(), np.int32) for x in parts]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    return fit_ordinal(np.concatenate(lists) if lists else np.zeros(0, np.int32), offsets, grades, GRADES, bits)


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT_PROBABILITY, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """Every column of docs, then expected_grade, p_tail (probability of the top grade) and quality_kept."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fit_documents))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = model.value.tails(model.value.scores(batch["text"]))
            added = [pa.array(tails.sum(1)), pa.array(tails[:, CUT_GRADE]), pa.array(tails[:, CUT_GRADE] >= cut)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "expected_grade", "p_tail", "quality_kept"])

    plain = docs.drop("expected_grade", "p_tail", "quality_kept")
    return plain.mapInArrow(score, extended(plain.schema, "expected_grade double, p_tail double, quality_kept boolean"))

"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of order 4 over lower-cased letters, all else being one boundary mark. Counts of the highest order are those
of the text, counts of lower orders are numbers of distinct left neighbours; every order gives an absolute discount to the next lower one,
down to a uniform one. The grams of SIDE_BY_SIDE languages stand in one sorted array of 64-bit keys per order, with a column of logarithms
per language, and the discounts' weights in a sorted array of histories; texts are looked up in them by binary search.

The language of least cross-entropy per character is predicted. A prediction is accepted if that entropy lies no further above the
language's mean than those of nearly all calibration texts that are told as their language do, with a margin and allowing for the spread
of short texts; a few outliers among these don't widen it, and a least margin lets texts pass that are spelt oddly or hold some of another
language.

Models are fitted on about FIT_DOCUMENTS different texts a language, chosen by a hash of doc_id and text (a parameter), a fifth of them for
calibration; prediction reads every text whole. Models are sent to all executors; beyond MODEL_BYTES, which takes hundreds of languages, an
error says so.

Defined cases: null text and text without letters give `und`, score 0, not accepted; with no labelled text everything is `und`; equal
entropies go to the language that sorts first; repeated rows are predicted alike; letters beyond the basic plane share one symbol; other
columns pass through, those named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.llm.common import distinct, extended, steps, stored, text_bytes

ORDER = 4
FIT_DOCUMENTS = 2_500
UNKNOWN = "und"
#: Bytes of all models together that may be held by the driver and each executor, and what a gram of a language takes of them.
MODEL_BYTES, GRAM_BYTES = 1 << 30, 64
#: Languages whose grams share an array.
SIDE_BY_SIDE = 8
#: A list of more languages is joined by shuffling, not broadcast.
BROADCAST_LANGUAGES = 10_000
#: How sharply differences of entropy (bits a character) turn into the score.
SHARPNESS = 8.0
#: The calibration excess is that of this part of the texts, the least one at that; and the margin on it.
CALIBRATION_SHARE, LEAST_EXCESS, MARGIN = 0.995, 12.0, 1.5
#: Texts shorter than this may deviate more, as the square root of their length.
STEADY_LENGTH = 400

_symbols: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """For each code point: 0 if it isn't a letter, else its lower-case letter in 16 bits."""
    if not _symbols:
        table = np.zeros(0x110000, np.uint16)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                table[c] = min(ord(x.lower()[0]), 0xFFFF)
        _symbols.append(table)
    return _symbols[0]


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: packed 4-grams of each, end to end, and offsets. A text without letters has none."""
    data, offsets = text_bytes(column)
    table = symbol_table()
    for first, last in steps(np.diff(offsets)):
        part = data[offsets[first] : offsets[last]]
        at = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))[offsets[first : last + 1] - offsets[first]]
        points = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        letters = table[points]
        row = np.repeat(np.arange(last - first), np.diff(at))
        n = last - first
        has = np.bincount(row[letters > 0], minlength=n) > 0
        keep = (letters > 0) & has[row]
        if len(letters):  # the boundary after each stretch of letters
            after = np.zeros(len(letters), bool)
            after[1:] = (letters[1:] == 0) & (letters[:-1] > 0) & (row[1:] == row[:-1])
            keep |= after
        kept, kept_row = letters[keep], row[keep]
        sizes = np.bincount(kept_row, minlength=n)
        # Three boundaries before each text serve as its first history.
        padded = np.zeros(len(kept) + 3 * n, np.uint64)
        place = np.arange(len(kept)) + 3 * (kept_row + 1)
        padded[place] = kept
        key = padded[place]
        for k in range(1, ORDER):
            key = key | (padded[place - k] << np.uint64(16 * k))
        yield key, np.concatenate(([0], np.cumsum(sizes)))


@dataclass
class KneserNey:
    """Log2 probabilities of grams by order, and log2 weights of histories, for all languages side by side."""

    langs: list[str]
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    logs: dict[int, np.ndarray] = field(default_factory=dict)
    history_keys: dict[int, np.ndarray] = field(default_factory=dict)
    history_logs: dict[int, np.ndarray] = field(default_factory=dict)
    floor: float = -17.0

    def log2(self, order: int, key: np.ndarray) -> np.ndarray:
        """[grams, languages]; unseen grams take their history's weight and the next lower order."""
        if order == 0 or not len(self.langs):
            return np.full((len(key), len(self.langs)), self.floor, np.float32)
        own = self.keys[order]
        at = np.minimum(np.searchsorted(own, key), max(0, len(own) - 1))
        out = self.logs[order][at]
        missing = np.flatnonzero(own[at] != key)
        if len(missing):
            rest = key[missing]
            lower = self.log2(order - 1, rest & np.uint64((1 << 16 * (order - 1)) - 1))
            history, known = rest >> np.uint64(16), self.history_keys[order]
            h = np.minimum(np.searchsorted(known, history), len(known) - 1)
            weight = np.where((known[h] == history)[:, None], self.history_logs[order][h], np.float32(0))
            out[missing] = lower + weight
        return out


@dataclass
class Languages:
    """Models of all languages, some side by side in each part, and what is usual among a language's own texts.

    A part's arrays hold every gram of its languages, so all parts together grow with the grams of all languages, not with grams times languages.
    """

    parts: list[KneserNey]
    means: np.ndarray = None
    excess: np.ndarray = None

    @property
    def langs(self) -> list[str]:
        return [x for part in self.parts for x in part.langs]

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character, [texts, languages], and the number of characters of each text."""
        bits, sizes = [], []
        for key, offsets in grams(column):
            n = np.diff(offsets)
            some = n > 0
            sums = np.zeros((len(n), len(self.langs)))
            if some.any() and self.parts:
                starts = offsets[:-1][some]
                sums[some] = np.concatenate([np.add.reduceat(part.log2(ORDER, key), starts, axis=0, dtype=np.float64) for part in self.parts], 1)
            bits.append(-sums / np.maximum(n, 1)[:, None])
            sizes.append(n)
        return (np.concatenate(bits), np.concatenate(sizes)) if bits else (np.zeros((0, len(self.langs))), np.zeros(0, np.int64))

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        bits, sizes = self.entropies(column)
        langs = self.langs
        if not langs:
            return [UNKNOWN] * len(column), np.zeros(len(column)), np.zeros(len(column), bool)
        best = bits.argmin(1)
        least = bits[np.arange(len(bits)), best]
        score = np.where(sizes > 0, 1 / np.exp2(-SHARPNESS * (bits - least[:, None])).sum(1), 0.0)
        over = (least - self.means[best]) * np.sqrt(np.minimum(sizes, STEADY_LENGTH))
        return [langs[b] if n else UNKNOWN for b, n in zip(best, sizes, strict=True)], score, (sizes > 0) & (over <= self.excess[best])


def fit_kneser_ney(langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]], letters: int | None = None) -> KneserNey:
    """counts: for each language its distinct 4-grams (sorted) and how often each occurs; letters: number of symbols, by default those seen here."""
    model = KneserNey(langs)
    if not langs:
        return model
    by_order: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        suffix = [k & np.uint64((1 << 16 * order) - 1) for k, _ in by_order[order + 1]]
        by_order[order] = [np.unique(s, return_counts=True) for s in suffix]
    letters = letters or len(distinct(np.concatenate([k for k, _ in by_order[1]])))
    model.floor = float(-np.log2(letters + 1))
    for order in range(1, ORDER + 1):
        keys = distinct(np.concatenate([k for k, _ in by_order[order]]))
        histories = distinct(keys >> np.uint64(16))
        lower = np.exp2(model.log2(order - 1, keys & np.uint64((1 << 16 * (order - 1)) - 1)).astype(np.float64))
        prob = np.zeros((len(keys), len(langs)))
        weight = np.ones((len(histories), len(langs)))
        for col, (key, count) in enumerate(by_order[order]):
            ones, twos = np.sum(count == 1), np.sum(count == 2)
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            at = np.searchsorted(histories, key >> np.uint64(16))
            total = np.bincount(at, count, len(histories))
            weight[:, col] = np.where(total > 0, discount * np.bincount(at, minlength=len(histories)) / np.maximum(total, 1), 1.0)
            prob[np.searchsorted(keys, key), col] = (count - discount) / total[at]
        whole = prob + weight[np.searchsorted(histories, keys >> np.uint64(16))] * lower
        model.keys[order], model.logs[order] = keys, np.log2(whole).astype(np.float32)
        model.history_keys[order], model.history_logs[order] = histories, np.log2(weight).astype(np.float32)
    return model


def fit_languages(langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> Languages:
    letters = len(distinct(np.concatenate([distinct(k & np.uint64(0xFFFF)) for k, _ in counts]))) if counts else 0
    return Languages([fit_kneser_ney(langs[a : a + SIDE_BY_SIDE], counts[a : a + SIDE_BY_SIDE], letters) for a in range(0, len(langs), SIDE_BY_SIDE)])


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def train(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Languages:
    """docs: doc_id, text, lang; only rows that are not held out and have a language are read. Gram counts and one figure for each calibration text come to the driver."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    sizes = stored(known.groupBy("lang").agg(F.count("*").alias("n")))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGUAGES else sizes
    # Rows of one doc_id are chosen each by its text, and a text counts once: neither can fill the sample.
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    chosen = known.join(sizes, "lang").filter(part * F.col("n") < fit_documents).groupBy("lang", "text").agg(F.min("doc_id").alias("doc_id"))
    sample = stored(chosen.select("lang", "text", (F.pmod(F.xxhash64("text", F.lit(1)), F.lit(5)) == 0).alias("calibrates")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for lang in batch["lang"].unique().to_pylist():
                own = whole.filter(pa.compute.equal(whole["lang"], lang))["text"]
                for key, _ in grams(own):
                    seen, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array(seen.view(np.int64)), pa.array(n)], ["lang", "key", "n"])

    def counted(rows: DataFrame) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
        found = stored(rows.select("lang", "text").mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))
        if (size := found.count() * GRAM_BYTES) > MODEL_BYTES:
            raise MemoryError(f"the models would take {size} bytes; MODEL_BYTES is {MODEL_BYTES}")
        table = found.toArrow()
        lang, key, n = table["lang"].to_pandas().to_numpy(), table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
        langs = sorted(set(lang))
        pick = lambda x: (lambda i: (key[i], n[i]))(np.flatnonzero(lang == x)[np.argsort(key[lang == x])])
        return langs, [pick(x) for x in langs]

    model = fit_languages(*counted(sample.filter("not calibrates")))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, sizes = sent.value.entropies(batch["text"])
            numbers = {x: k for k, x in enumerate(sent.value.langs)}
            own = [numbers.get(x, -1) for x in batch["lang"].to_pylist()]
            ok = (sizes > 0) & (np.array(own, int) >= 0)
            ok[ok] = bits[ok].argmin(1) == np.array(own, int)[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(own, np.int64)[ok]), pa.array(bits[np.flatnonzero(ok), np.array(own, int)[ok]]), pa.array(sizes[ok])], ["lang", "bits", "n"])

    seen = sample.filter("calibrates").select("lang", "text").mapInArrow(measure, "lang long, bits double, n long").toPandas()
    n_langs = len(model.langs)
    model.means, model.excess = np.full(n_langs, 4.0), np.full(n_langs, 40.0)
    for col in range(n_langs):
        if len(own := seen[seen["lang"] == col]):
            model.means[col] = np.average(own["bits"], weights=np.minimum(own["n"], STEADY_LENGTH))
            over = (own["bits"] - model.means[col]) * np.sqrt(np.minimum(own["n"], STEADY_LENGTH))
            model.excess[col] = MARGIN * max(np.quantile(over, CALIBRATION_SHARE, method="lower"), LEAST_EXCESS)
    return model


def identify(docs: DataFrame, training: DataFrame | None = None, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """Every column of docs, then lang_pred, score and lang_accepted. The model is learned from `training`, by default docs itself."""
    model = docs.sparkSession.sparkContext.broadcast(train(training if training is not None else docs, fit_documents))
    plain = docs.drop("lang_pred", "score", "lang_accepted")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, accepted = model.value.predict(batch["text"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(accepted)], [*batch.schema.names, "lang_pred", "score", "lang_accepted"])

    return plain.mapInArrow(predict, extended(plain.schema, "lang_pred string, score double, lang_accepted boolean"))

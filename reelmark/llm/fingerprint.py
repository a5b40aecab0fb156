"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph (a line) is hashed to a wide vector and a document's fingerprint is the sum of its paragraphs' vectors: EXACT words modulo
2^64, the paragraph's BLAKE2b digest, that tell equal multisets of paragraphs from others; and SKETCH lanes modulo 2^32, among which each
word triple of the paragraph adds +1 or -1 to one, with a last lane counting the triples. No text of Spark holds enough triples for a lane to
turn over. Sums don't depend on the order of
paragraphs, and one is put in or taken out by adding or subtracting its vector (`inserted`, `deleted`). The squared length of a sketch
estimates that of the document's counts of triples, so likeness = 1 - |a - b|^2 / (|a|^2 + |b|^2), between 0 and 1.

The text written into an edited document comes from the next one by falling doc_id. Rows are dealt to ranges of doc_id of about
RANGE_BYTES of text, and the first row of each range also goes to the one before, so the text moves once and each range is read in order
as a stream. A doc_id of very many rows, or none, is cut into ranges by a hash of the text; a row that is there over HOT_COPIES times goes
once, with its number: each copy but the last is followed by its like.

Defined cases: null text counts as empty; empty texts have the zero vector and likeness 1 to each other, 0 to others; a single document is
its own next one; rows of equal doc_id follow by falling 64-bit hash of their text, those of null doc_id come last; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmark.llm.common import Hasher, mixed, runs, steps, stored, text_bytes

EXACT, SKETCH = 8, 128
#: Text that a range holds on average, and bounds of doc_id that are looked up; more ranges than bounds cut each span evenly.
RANGE_BYTES, MOST_BOUNDS = 32 << 20, 1024
#: Copies of one row that go one by one.
HOT_COPIES = 256
#: A list of more ranges is joined by shuffling, not broadcast.
BROADCAST_RANGES = 1_000_000
_K = np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its exact words [n, EXACT], sketch lanes [n, SKETCH] modulo 2^32, and number of triples."""
    n = len(offsets) - 1
    exact, sketch, count = np.zeros((n, EXACT), np.uint64), np.zeros((n, SKETCH), np.uint32), np.zeros(n, np.int64)
    for first, last in steps(np.diff(offsets)):
        part = data[offsets[first] : offsets[last]]
        if not len(part):
            continue
        bounds = offsets[first : last + 1] - offsets[first]
        m = last - first
        hasher = Hasher(part)
        # Paragraphs: what lies between line feeds and the ends of texts; empty ones add nothing.
        line_end = np.flatnonzero(part == 10)
        starts, ends = np.concatenate((bounds[:-1], line_end + 1)), np.concatenate((bounds[1:], line_end))
        starts, ends = np.sort(starts), np.sort(ends)
        solid = ends > starts
        starts, ends = starts[solid], ends[solid]
        owner = np.searchsorted(bounds, starts, "right") - 1
        whole = part.tobytes()
        vectors = np.frombuffer(b"".join(hashlib.blake2b(whole[a:b]).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), "<u8").reshape(-1, EXACT)
        sums = np.concatenate((np.zeros((1, EXACT), np.uint64), np.cumsum(vectors, 0, np.uint64)))
        at = np.searchsorted(owner, np.arange(m + 1))
        exact[first:last] = sums[at[1:]] - sums[at[:-1]]
        # Triples of words within a paragraph; shorter paragraphs count as one piece.
        word_start, word_end = runs(~_BLANK[part])
        cut = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(part))]
        cut = cut[~_BLANK[part[cut]] & ~_BLANK[part[cut - 1]]]
        if len(cut):
            word_start, word_end = np.union1d(word_start, cut), np.union1d(word_end, cut)
        words = hasher.hashes(word_start, word_end)
        line = np.searchsorted(starts, word_start, "right") - 1
        sizes = np.bincount(line, minlength=len(starts))
        triple = np.zeros(len(words), bool)
        triple[: len(words) - 2] = line[2:] == line[:-2] if len(words) > 2 else False
        at = np.flatnonzero(triple)
        short = np.flatnonzero((sizes > 0) & (sizes < 3))
        items = np.concatenate((mixed((words[at] * _K + words[at + 1]) * _K + words[at + 2]), mixed(hasher.hashes(starts[short], ends[short]) ^ _K)))
        row = np.concatenate((owner[line[at]], owner[short]))
        lane = (items >> np.uint64(32)).astype(np.int64) % SKETCH
        sign = 1 - 2 * (items & np.uint64(1)).astype(np.int64)
        sums = np.bincount(row * SKETCH + lane, sign, m * SKETCH).astype(np.int64)
        sketch[first:last] = (sums & 0xFFFFFFFF).astype(np.uint32).reshape(m, SKETCH)
        count[first:last] = np.bincount(row, minlength=m)
    return exact, sketch, count


def likeness(one: tuple, other: tuple) -> np.ndarray:
    length = lambda lanes: np.square(lanes.view(np.int32).astype(np.float64)).sum(1)
    apart, total = length(one[1] - other[1]), length(one[1]) + length(other[1])
    near = np.where(total > 0, 1 - apart / np.maximum(total, 1), 0.0)
    return np.where((one[0] == other[0]).all(1), 1.0, np.clip(near, 0.0, 1.0))


def rendered(prints: tuple) -> list[str]:
    """Hex digits of the exact words, the lanes and the count (modulo 2^32)."""
    exact, sketch, count = prints
    return [a.tobytes().hex() + b.tobytes().hex() + int(c & 0xFFFFFFFF).to_bytes(4, "little").hex() for a, b, c in zip(exact, sketch, count, strict=True)]


def parsed(fingerprint: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What rendered() wrote, as prints of one document."""
    raw = bytes.fromhex(fingerprint)
    exact, sketch = np.frombuffer(raw, "<u8", EXACT), np.frombuffer(raw, "<u4", SKETCH, 8 * EXACT)
    return exact[None, :], sketch[None, :], np.array([int.from_bytes(raw[-4:], "little")])


def inserted(fingerprint: str, paragraphs: list[str]) -> str:
    """The fingerprint of a document after paragraphs were added to it, without its text."""
    exact, sketch, count = fingerprints(*text_bytes(pa.array(["\n".join(paragraphs)])))
    own = parsed(fingerprint)
    return rendered((own[0] + exact, own[1] + sketch, own[2] + count))[0]


def deleted(fingerprint: str, paragraphs: list[str]) -> str:
    """The fingerprint of a document after paragraphs of it were taken out, without its text."""
    exact, sketch, count = fingerprints(*text_bytes(pa.array(["\n".join(paragraphs)])))
    own = parsed(fingerprint)
    return rendered((own[0] - exact, own[1] - sketch, own[2] - count))[0]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next document, or by all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranged(plain: DataFrame, bounds: list[int], parts: int, null_parts: int) -> DataFrame:
    """Adds range, a number that rises along the order of rows. plain: doc_id, text, key.

    bounds: doc_ids in rising order, a repeated one standing for as many rows each time; parts: ranges between two bounds; null_parts:
    ranges of rows without a doc_id. Bounds are looked up in two steps, first among every so many of them.
    """
    # The key, a signed 64-bit hash, falls along the rows of one doc_id.
    cut_by_key = lambda n: F.least(F.floor((0.5 - F.col("key").cast("double") / 2.0**64) * n), F.lit(n - 1))
    if not bounds:
        return plain.withColumn("range", F.when(F.col("doc_id").isNull(), cut_by_key(null_parts) + 1).otherwise(0).cast("long"))
    different = sorted(set(bounds))
    hot = [b for b in different if bounds.count(b) > 1]
    width = max(1, int(len(different) ** 0.5))
    chunks = [different[k : k + width] for k in range(0, len(different), width)]
    numbers = lambda x: F.array(*[F.lit(v).cast("long") for v in x])
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col("doc_id")))
    chunk = F.greatest(below(numbers([c[0] for c in chunks])) - 1, F.lit(0))
    placed = plain.withColumn("chunk", chunk).withColumn("at", F.col("chunk") * width + below(F.element_at(F.array(*[numbers(c) for c in chunks]), F.col("chunk") + 1)))
    edges = F.array(numbers(different[:1]), *[numbers(different[k : k + 2]) for k in range(len(different) - 1)], numbers(different[-1:]))
    edge = F.element_at(edges, F.col("at") + 1)
    low, high = F.get(edge, 0).cast("double"), F.get(edge, 1).cast("double")
    span = F.when(F.size(edge) == 2, (F.col("doc_id").cast("double") - low) / (high - low)).otherwise(0.0)
    is_hot = F.col("doc_id").isin(*hot) if hot else F.lit(False)
    # Within a hot doc_id the key cuts: as finely as all the bounds it stands for.
    copies = parts * max((bounds.count(b) for b in hot), default=1)
    within = F.when(is_hot, cut_by_key(copies)).otherwise(F.least(F.floor((1 - span) * parts), F.lit(parts - 1)))
    most = max(copies, parts)
    # In falling order of doc_id; a hot bound comes right before the span below it.
    number = (2 * (len(different) - F.col("at")) - is_hot.cast("int")) * most + within
    last = (2 * len(different) + 2) * most + cut_by_key(null_parts)
    return placed.withColumn("range", F.when(F.col("doc_id").isNull(), last).otherwise(number).cast("long")).drop("chunk", "at")


def _once(plain: DataFrame) -> DataFrame:
    """Adds copies: rows that are there over HOT_COPIES times once, with their number, all others as they are."""
    hot = stored(plain.groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_COPIES).select(F.col("doc_id").alias("hot_id"), F.col("key").alias("hot_key")))
    single = plain.withColumn("copies", F.lit(1).cast("long"))
    if hot.isEmpty():
        return single
    same = F.col("doc_id").eqNullSafe(F.col("hot_id")) & (F.col("key") == F.col("hot_key"))
    # Copies meet in the tasks that read them before anything is shuffled.
    counted = plain.join(hot, same, "left_semi").groupBy("doc_id", "text", "key").agg(F.count("*").alias("copies"))
    return single.join(hot, same, "left_anti").unionByName(counted)


def fingerprint_edits(docs: DataFrame, partitions: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how near they and the next document are."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    plain = _once(plain)
    size, rows, known = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*"), F.count("doc_id")).first()
    wanted = max(min(4 * partitions, rows), -(-int(size) // range_bytes), 1)
    null_parts = max(1, -(-wanted * (rows - known) // max(rows, 1)))
    n_bounds = min(wanted - 1, MOST_BOUNDS)
    parts = -(-wanted // (n_bounds + 1))
    found = plain.filter("doc_id is not null").agg(F.percentile_approx("doc_id", [k / (n_bounds + 1) for k in range(1, n_bounds + 1)], 20_000).alias("q")).first()["q"] if n_bounds else None
    ranged = _ranged(plain, list(found or []), parts, null_parts)
    # One row for each range that has rows: its first one's doc_id and key, and the range before it. The first range's first row closes the last range.
    tops = stored(ranged.groupBy("range").agg(F.max(F.struct("doc_id", "key")).alias("top")))
    order = Window.orderBy("range")
    last = F.max("range").over(Window.partitionBy())
    heads = tops.select("range", "top", F.coalesce(F.lag("range").over(order), last).alias("previous"))
    heads = F.broadcast(heads) if wanted <= BROADCAST_RANGES else heads
    head = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("key") == F.col("top.key"))
    place = lambda number, extra: F.struct(F.col(number).alias("range"), F.lit(extra).alias("extra"))
    places = F.when(head, F.array(place("range", 0), place("previous", 1))).otherwise(F.array(place("range", 0)))
    dealt = ranged.join(heads, "range").select("doc_id", "text", "key", "copies", F.explode(places).alias("place")).select("doc_id", "text", "key", "copies", "place.range", "place.extra")
    tasks = max(partitions, -(-int(size) // (4 * range_bytes)))
    ordered = dealt.repartition(tasks, "range").sortWithinPartitions("range", "extra", F.col("doc_id").desc_nulls_last(), F.col("key").desc()).drop("key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str, int]] = []
        size, at, closed = 0, None, False

        def flush(rows: list[tuple[int, str, int]], following: list[str]) -> pa.RecordBatch:
            pairs = [x for (d, t, n), f in zip(rows, following, strict=True) for x in ([((d, t, n - 1), t)] if n > 1 else []) + [((d, t, 1), f)]]
            rows, following = [row for row, _ in pairs], [f for _, f in pairs]
            texts = [t for _, t, _ in rows]
            changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
            own, new, after = (fingerprints(*text_bytes(pa.array(x, pa.string()))) for x in (texts, changed, following[-1:]))
            nxt = tuple(np.concatenate((a[1:], b)) for a, b in zip(own, after, strict=True))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _, _ in rows], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array(rendered(own)),
                    pa.array(rendered(new)),
                    pa.array(likeness(own, new)),
                    pa.array(likeness(own, nxt)),
                    pa.array([n for _, _, n in rows], pa.int64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "copies"],
            )

        for batch in batches:
            for doc_id, text, copies, number, extra in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "copies", "range", "extra")), strict=True):
                if number != at:
                    at, closed = number, False
                if extra and not closed and held:
                    yield flush(held, [t for _, t, _ in held[1:]] + [text])
                    held, size, closed = [], 0, True
                elif not extra:
                    if size > 1 << 20:
                        yield flush(held[:-1], [t for _, t, _ in held[1:]])
                        held = held[-1:]
                        size = len(held[0][1])
                    held.append((doc_id, text, copies))
                    size += len(text)

    found = ordered.mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")


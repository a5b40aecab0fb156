"""Hard negatives by a pivot table.

With one coordinate more, sqrt(M^2 - |x|^2) for a row and 0 for an anchor, M the largest length of a row, an inner product becomes a distance:
d(x, q)^2 = M^2 + |q|^2 - 2 x.q. A row keeps its distances to PIVOTS rows. By the triangle inequality an anchor's distance to a row lies
between the largest difference and the least sum of their distances to a pivot, which brackets the row's score without its vector; only rows
whose bracket meets what is still wanted are multiplied out, in whole numbers.

Rows are dealt to shards, ranges of the nearest pivot and the distance to it, so near rows share a shard however many are equal. An anchor
visits its own shard first, then, in rounds of GROWTH times as many shards, all others; each round starts from the scores found so far, so
what leaves a shard is little more than what is kept. Within a shard rows lie in blocks, which are passed over whole where the brackets of
their extremes allow. A round meets as groups of one shard and at most about QUERY_ROWS of its visitors, never as pairs of rows.

Two searches follow one another: the best rows of the anchor's own label, then for each of these the best rows of other labels whose score lies
in the wanted range. Pivots come from a bounded sample (SAMPLE rows by a hash); they only change the work, not the result.

Defined cases: a null label or vector, or a component that is null or no finite number, takes a row out, and so does a null vec_id, as it
can't be named; a shorter vector counts as filled up with zeros; rows of equal vec_id count one by one, but none as its own anchor's
positive; a positive without negatives gives no row; an empty table gives an empty result; other columns are ignored. Scores must stay
below 2^60, beyond which an error says so.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmark.llm.common import stored

PIVOTS, SAMPLE = 8, 1024
#: Rows of a shard at most on average, and at least where there are fewer shards than partitions.
SHARD_ROWS, LEAST_SHARD_ROWS = 1 << 16, 1 << 11
#: Visitors of a shard that meet it in one group, on average.
QUERY_ROWS = 1 << 14
#: Times as many shards as before in each round.
GROWTH = 16
_BLOCK, _CHUNK, _TILE = 128, 4096, 256
_LEAST, _MOST = -(1 << 62), 1 << 62


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part: v in whole numbers, floor(256 * x) of each component."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    taken = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return taken.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))


@dataclass(frozen=True)
class Space:
    """What all distances are relative to: components of a vector, the largest squared length, and the pivots with their own coordinate added."""

    width: int
    most: int
    pivots: np.ndarray

    @property
    def kind(self) -> type:
        """Products of whole numbers are exact in doubles up to 2^53, beyond that integers are multiplied."""
        return np.float64 if self.most < 1 << 51 else np.int64

    def matrix(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        flat = b"".join(x.as_py() for x in column)
        return np.frombuffer(flat, np.int64).reshape(-1, self.width).astype(self.kind)

    def distances(self, vectors: np.ndarray, as_rows: bool) -> np.ndarray:
        """To each pivot: of rows with their added coordinate, or of anchors, whose added coordinate is 0."""
        lengths = (vectors * vectors).sum(1)
        added = np.sqrt(np.maximum(self.most - lengths.astype(np.float64), 0.0)) if as_rows else np.zeros(len(vectors))
        own = self.pivots.astype(self.kind)
        pivot_lengths = (own * own).sum(1)
        pivot_added = np.sqrt(np.maximum(self.most - pivot_lengths.astype(np.float64), 0.0))
        apart = (lengths[:, None] + pivot_lengths[None, :] - 2 * (vectors @ own.T)).astype(np.float64)
        return np.sqrt(np.maximum(apart, 0.0) + np.square(added[:, None] - pivot_added[None, :]))


def chosen_pivots(sample: np.ndarray, most: int, pivots: int) -> np.ndarray:
    """Rows of the sample that lie far from each other, each the farthest from those before it."""
    if not len(sample):
        return sample
    far, picks = np.full(len(sample), np.inf), [0]
    while True:
        space = Space(sample.shape[1], most, sample[picks[-1:]])
        far = np.minimum(far, space.distances(sample.astype(space.kind), True)[:, 0])
        if len(picks) == pivots or far.max() == 0:
            return sample[picks]
        picks.append(int(far.argmax()))


def pivot_table(vectors: DataFrame) -> tuple[DataFrame, Space]:
    """(shard, vec_id, label, v, d): rows dealt to shards, v and d as bytes of whole numbers and of distances. vectors: as from usable()."""
    spark = vectors.sparkSession
    length = F.aggregate("v", F.lit(0).cast("long"), lambda total, x: total + x * x)
    rows, width, most = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(length), F.lit(0))).first()
    if most >= 1 << 60:
        raise ArithmeticError("vectors so long that scores leave the range of whole numbers")
    # A sample of bounded size comes to the driver.
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(SAMPLE).collect()
    sample = np.zeros((len(picked), width), np.int64)
    for k, row in enumerate(picked):
        sample[k, : len(row["v"])] = row["v"]
    space = Space(width, most, chosen_pivots(sample, most, PIVOTS))

    def place(batches):
        for batch in batches:
            column = batch["v"]
            offsets, flat = np.asarray(column.offsets), np.asarray(column.values)
            sizes = np.diff(offsets)
            whole = np.zeros((len(batch), width), np.int64)
            whole[np.repeat(np.arange(len(batch)), sizes), np.arange(sizes.sum()) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat[offsets[0] : offsets[-1]]
            d = space.distances(whole.astype(space.kind), True)
            pack = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], pack(whole), pack(d), pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1), pa.float64())], ["vec_id", "label", "v", "d", "home", "near"]
            )

    parted = vectors.mapInArrow(place, "vec_id long, label long, v binary, d binary, home int, near double")
    shards = max(-(-rows // SHARD_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // LEAST_SHARD_ROWS)), 1)
    # The hash tells equal vectors apart, so they fill as many shards as any others.
    dealt = parted.repartitionByRange(shards, "home", "near", F.xxhash64("vec_id"))
    return stored(dealt.select(F.spark_partition_id().alias("shard"), "vec_id", "label", "v", "d")), space


def best_of(slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of each slot: by falling score, then by rising vec_id."""
    order = np.lexsort((vec_id, -score, slot))
    first = np.searchsorted(slot[order], slot[order], "left")
    return order[np.arange(len(order)) - first < k]


def visit(space: Space, rows: pa.Table, asked: pa.Table, same: bool, k: int) -> tuple[pd.DataFrame, int]:
    """The k best rows of a shard for each slot of its visitors, and how many pairs were multiplied out.

    rows: vec_id, label, v, d; asked: query, slot, vec_id, label, v, low, high, least: scores wanted, and one below which enough are known.
    """
    labels, ids, d = rows["label"].to_numpy(), rows["vec_id"].to_numpy(), np.frombuffer(b"".join(x.as_py() for x in rows["d"]), np.float64).reshape(len(rows), -1)
    order = np.lexsort((d.min(1), d.argmin(1), labels))
    labels, ids, d, vectors = labels[order], ids[order], d[order], space.matrix(rows["v"])[order]
    starts = np.arange(0, len(labels), _BLOCK)
    near, far = np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)
    least_label, most_label = labels[starts], labels[np.minimum(starts + _BLOCK, len(labels)) - 1]
    slack = 1e-9 * space.most + 1.0

    query = asked["query"].to_numpy()
    first, of = np.unique(query, return_index=True)[1], np.unique(query, return_inverse=True)[1]
    anchors, anchor_labels, anchor_ids = space.matrix(asked["v"].take(pa.array(first))), asked["label"].to_numpy()[first], asked["vec_id"].to_numpy()[first]
    anchor_d = space.distances(anchors, False)
    reach = space.most + (anchors * anchors).sum(1).astype(np.float64)
    low, high, least = (asked[c].to_numpy() for c in ("low", "high", "least"))
    found = {c: np.zeros(0, np.int64) for c in ("slot", "score", "vec_id")}
    multiplied = 0
    for start in range(0, len(anchors), _TILE):
        tile = np.arange(start, min(start + _TILE, len(anchors)))
        slots = np.flatnonzero((of >= start) & (of < start + _TILE))
        bound = least[slots].copy()
        kept = {c: np.zeros(0, np.int64) for c in found}
        for at in range(0, len(starts), _CHUNK // _BLOCK):
            blocks = np.arange(at, min(at + _CHUNK // _BLOCK, len(starts)))
            wanted_low, wanted_high = np.full(len(tile), np.inf), np.full(len(tile), -np.inf)
            np.minimum.at(wanted_low, of[slots] - start, np.maximum(low[slots], bound))
            np.maximum.at(wanted_high, of[slots] - start, high[slots].astype(np.float64))
            # Brackets of whole blocks, by the extremes of their distances.
            gap, total = np.zeros((len(tile), len(blocks))), np.full((len(tile), len(blocks)), np.inf)
            for p in range(d.shape[1]):
                own = anchor_d[tile, p][:, None]
                gap = np.maximum(gap, np.maximum(near[blocks, p] - own, own - far[blocks, p]))
                total = np.minimum(total, own + far[blocks, p])
            above, below = (reach[tile, None] - gap * gap) / 2, (reach[tile, None] - total * total) / 2
            own_label = anchor_labels[tile][:, None]
            fits = (least_label[blocks] <= own_label) & (own_label <= most_label[blocks]) if same else (least_label[blocks] != own_label) | (most_label[blocks] != own_label)
            open_blocks = (above + slack >= wanted_low[:, None]) & (below - slack <= wanted_high[:, None]) & fits
            visited = blocks[open_blocks.any(0)]
            if not len(visited):
                continue
            inside = np.concatenate([np.arange(starts[b], min(starts[b] + _BLOCK, len(labels))) for b in visited])
            # Brackets of single rows.
            gap, total = np.zeros((len(tile), len(inside))), np.full((len(tile), len(inside)), np.inf)
            for p in range(d.shape[1]):
                own = anchor_d[tile, p][:, None]
                np.maximum(gap, np.abs(d[inside, p] - own), out=gap)
                np.minimum(total, d[inside, p] + own, out=total)
            survives = ((reach[tile, None] - gap * gap) / 2 + slack >= wanted_low[:, None]) & ((reach[tile, None] - total * total) / 2 - slack <= wanted_high[:, None])
            survives &= (labels[inside] == own_label) & (ids[inside] != anchor_ids[tile][:, None]) if same else labels[inside] != own_label
            some_anchors, some_rows = np.flatnonzero(survives.any(1)), np.flatnonzero(survives.any(0))
            if not len(some_anchors):
                continue
            multiplied += int(survives.sum())
            scores = np.zeros(survives.shape, space.kind)
            scores[np.ix_(some_anchors, some_rows)] = anchors[tile[some_anchors]] @ vectors[inside[some_rows]].T
            each = scores[of[slots] - start]
            good = survives[of[slots] - start] & (each >= np.maximum(low[slots], bound)[:, None]) & (each <= high[slots][:, None])
            if each.shape[1] > k:
                # A score that k others of the chunk reach is the least that counts.
                masked = np.where(good, each, _LEAST)
                good &= each >= np.partition(masked, -k, 1)[:, -k][:, None]
            i, j = np.nonzero(good)
            kept = {c: np.concatenate((kept[c], x)) for c, x in (("slot", slots[i]), ("score", each[i, j].astype(np.int64)), ("vec_id", ids[inside[j]]))}
            best = best_of(kept["slot"], kept["score"], kept["vec_id"], k)
            kept = {c: x[best] for c, x in kept.items()}
            full = np.flatnonzero(np.bincount(kept["slot"], minlength=len(of))[slots] == k)
            worst = np.full(len(of), _MOST)
            np.minimum.at(worst, kept["slot"], kept["score"])
            bound[full] = np.maximum(bound[full], worst[slots[full]])
        found = {c: np.concatenate((x, kept[c])) for c, x in found.items()}
    at = found["slot"]
    return pd.DataFrame({"query": query[at], "slot": asked["slot"].to_numpy()[at], "vec_id": found["vec_id"], "score": found["score"]}), multiplied


def search(rows: DataFrame, space: Space, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """(query, slot, vec_id, score): for each slot of a query the k best rows of the query's label, or of others, with a score between low and high.

    rows: as from pivot_table(); asked: query, home (its shard), vec_id, label, v, slot, low, high.
    """
    shards = (rows.agg(F.max("shard")).first()[0] or 0) + 1
    visitors = asked.groupBy("home").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    columns = ["query", "slot", "vec_id", "label", "v", "low", "high", "least"]
    best, start, stop = None, 0, 1
    while start < shards:
        todo = asked.withColumn("least", F.lit(_LEAST))
        if best is not None:
            enough = best.groupBy("query", "slot").agg(F.count("*").alias("n"), F.min("score").alias("worst")).filter(F.col("n") >= k).select("query", "slot", "worst")
            todo = asked.join(enough, ["query", "slot"], "left").withColumn("least", F.coalesce("worst", F.lit(_LEAST)))
        # A shard is visited from stop - start others, each with its own number of queries.
        parts = max(1, -(-min(visitors[0], visitors[1] * (stop - start)) // QUERY_ROWS))
        to = F.explode(F.sequence(F.lit(start), F.lit(stop - 1))).alias("step")
        going = todo.select(*columns, "home", to).withColumn("shard", F.pmod(F.col("home") + F.col("step"), F.lit(shards))).withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int"))
        there = rows.select("shard", "vec_id", "label", "v", "d", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return pa.table({"query": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
            return pa.Table.from_pandas(visit(space, left, right, same, k)[0], pa.schema([("query", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())]), preserve_index=False)

        met = there.groupBy("shard", "part").cogroup(going.select("shard", "part", *columns).groupBy("shard", "part")).applyInArrow(meet, "query long, slot int, vec_id long, score long")
        order = Window.partitionBy("query", "slot").orderBy(F.desc("score"), "vec_id")
        best = stored((met if best is None else best.union(met)).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k).drop("k"))
        start, stop = stop, min(shards, stop * (GROWTH + 1))
    return best


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its best rows of the same label the
    best rows of other labels whose score is low to high percent of that row's. vectors: vec_id, label and v, an array of whole numbers."""
    rows, space = pivot_table(vectors)
    anchors = stored(rows.filter(is_anchor).select(F.monotonically_increasing_id().alias("query"), F.col("shard").alias("home"), "vec_id", "label", "v"))
    near = search(rows, space, anchors.select("*", F.lit(0).alias("slot"), F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high")), True, positives)
    slots = stored(near.withColumn("slot", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")).cast("int")).withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}))
    least, most = _range(low, high)
    asked = anchors.join(slots, "query").select("query", "home", "vec_id", "label", "v", "slot", least.alias("low"), most.alias("high")).filter("low <= high")
    far = search(rows, space, asked, False, negatives)
    order = Window.partitionBy("query", "slot").orderBy(F.desc("score"), "vec_id")
    ranked = far.withColumn("rank", F.row_number().over(order).cast("int")).join(slots, ["query", "slot"]).join(anchors.select("query", F.col("vec_id").alias("anchor_id")), "query")
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _range(low: int, high: int) -> tuple[Column, Column]:
    """The least and the largest whole score between two percentages of positive_score, in whole numbers that stay small."""
    rest = "pmod(positive_score, 100L)"
    share = lambda percent, up: F.expr(f"(positive_score - {rest}) div 100L * {percent} + ({rest} * {percent} + {up}) div 100L")
    return share(low, 99), share(high, 0)

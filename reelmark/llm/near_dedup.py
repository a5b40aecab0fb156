"""Near-duplicate detection by MinHash with tensored banding, links verified on full shingle sets.

Two small collections of GROUPS groups of two minhashes each stand in for GROUPS^2 tables: the key of table (i, j) joins group i of the
first with group j of the second, four minhashes, though only 4 * GROUPS are computed. Two sets of Jaccard similarity 0.8 share no table
with a chance of 2 * (1 - 0.8^2)^GROUPS, one in 100,000 with 12 groups, and less above. Table keys are only made of groups that another
set shares, so sets without a relative cost 2 * GROUPS rows, not GROUPS^2.

Equal sets are one node from the start. In each table's bucket the nodes are tied to the bucket's leader, the one first by a hash; ties
whose signatures agree in under half of their places are dropped. The connected groups of ties hold the candidates: within a group all
pairs are verified on full sets, a bounded block of documents against another in a task, each block pair giving at most a spanning
forest of the links it finds. Groups of any size are handled whole: more blocks, no larger ones. Components of the links are the answer.

Before that each node is verified against the leaders it resembles most, in blocks by leader; only groups that these links leave in
several components go on to pairs of blocks, and of a component that fills blocks no two are paired. So a group of near copies of one text
costs work in proportion to its size, and only groups of many unlinked parts cost more.

Defined cases: null and empty text, or text of blanks, has no shingles and stays alone; fewer words than a shingle make one shingle;
documents of equal sets are linked; repeated rows share their component. A null doc_id links like any other, but names a component only
where all its rows lack one; there component_id is null and `kept` true. Rows of one doc_id and different texts are judged each by its text.
`keep_one` keeps one row of each component: the least doc_id, null last, then the least hash of the text; rows without shingles stay, once
for each doc_id and text. An empty table gives an empty result; other columns are ignored, `keep_one` returns them. Sets are compared by
64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmark.llm.common import mixed, stored
from reelmark.llm.shingles import shingle_sets

WIDTH, PERCENT = 4, 80
GROUPS = 12
#: Places of the signatures that must agree for two documents to be tied: well below the 0.8 of a link.
TIE_AGREEMENT = 0.5
#: Documents in a block of candidates, and shingles that a block holds on average.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Leaders that a node is verified against before blocks are paired.
LEADERS = 3
#: Edges of a graph that one task walks at most (16 MB); larger graphs are shuffled in rounds.
WALKED_EDGES = 1 << 20

_FACTORS = mixed(np.arange(1, 4 * GROUPS + 1, dtype=np.uint64)) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """4 * GROUPS minhashes of 32 bits."""
    least = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint64)
    for a in range(0, len(shingles), 4096):
        least = np.minimum(least, ((shingles[a : a + 4096, None] * _FACTORS) >> np.uint64(32)).min(0))
    return least.astype(np.uint32)


def set_hash(shingles: np.ndarray) -> int:
    """Equal sets have equal hashes."""
    return int(mixed(mixed(shingles).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(shingles))).view(np.int64)[0])


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, id_key, text_key, n_shingles, node, minhashes); node and minhashes are null without shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                sets = shingle_sets(part["text"], width)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        part["id_key"],
                        part["text_key"],
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([set_hash(x) if len(x) else None for x in sets], pa.int64()),
                        pa.array([signature(x).view(np.int32) if len(x) else None for x in sets], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "id_key", "text_key", "n_shingles", "node", "minhashes"],
                )

    return _keyed(docs).mapInArrow(sign, "doc_id long, id_key long, text_key long, n_shingles long, node long, minhashes array<int>")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two keys without nulls by which rows are found again; rows of equal keys are equal in both."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_row_keys())


def _row_keys() -> list[Column]:
    own = F.col("doc_id").cast("long")
    return [F.coalesce(own, F.lit(0).cast("long")).alias("id_key"), F.xxhash64(own, F.col("text")).alias("text_key")]


def ties(nodes: DataFrame) -> DataFrame:
    """(a, b, agree): nodes that share a table's bucket with its leader b, and how much of its signature, if that is much. nodes: node, minhashes."""
    at = lambda k: F.element_at("minhashes", k + 1)
    keys = F.array(*[F.xxhash64(F.lit(k), at(2 * k), at(2 * k + 1)) for k in range(2 * GROUPS)])
    groups = nodes.select("node", F.posexplode(keys).alias("group", "key"))
    shared = groups.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low != high").select("key")
    kept = groups.join(shared, "key", "left_semi")
    side = lambda test: F.collect_list(F.when(test, F.col("key")))
    pairs = kept.groupBy("node").agg(side(F.col("group") < GROUPS).alias("first"), side(F.col("group") >= GROUPS).alias("second"))
    tables = stored(pairs.select("node", "second", F.explode("first").alias("i")).select("node", "i", F.explode("second").alias("j")).select("node", F.xxhash64("i", "j").alias("bucket")))
    leaders = tables.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("leader"), F.min("node").alias("low"), F.max("node").alias("high"))
    leaders = leaders.filter("low != high").select("bucket", F.col("leader.node").alias("b"))
    tied = tables.join(leaders, "bucket").filter("node != b").select(F.col("node").alias("a"), "b").distinct()
    own, other = (nodes.select(F.col("node").alias(x), F.col("minhashes").alias(f"minhashes_{x}")) for x in "ab")
    agree = F.aggregate(F.zip_with("minhashes_a", "minhashes_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return tied.join(own, "a").join(other, "b").select("a", "b", agree.alias("agree")).filter(F.col("agree") >= int(TIE_AGREEMENT * 4 * GROUPS))


def least_of_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges a - b, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while ((above := root[root]) != root).any():
            root = above
    return nodes, nodes[root]


def _walked(edges: DataFrame) -> DataFrame:
    """components() of a graph that a task can hold."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch[k].to_numpy(zero_copy_only=False) for k in range(2)] for batch in batches]
        if parts:
            nodes, roots = least_of_components(*map(np.concatenate, zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])

    return edges.coalesce(1).mapInArrow(walk, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root the least node of its component; edges should be stored.

    Up to WALKED_EDGES are walked by one task. Beyond that two steps alternate, each cut off from its lineage by a written table: every node
    hands its larger neighbours, then its smaller ones, to the least of them."""
    edges = edges.select("a", "b").filter("a != b")
    if edges.count() <= WALKED_EDGES:
        return _walked(edges)
    stars = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = state(stars)
    while before[0]:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        larger = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(first, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = stored(smaller.union(first.select("u", F.col("m").alias("v"))).distinct())
        if (now := state(stars)) == before:
            break
        before = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", F.col("v").alias("root")).distinct())


def linked(sets: list[np.ndarray], first: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets. first: true, false or both; if both, only links between the two kinds count."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    if n < 2:
        return []
    rows = np.repeat(np.arange(n), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1
    rows, column = rows[common], column[common]
    column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1 if len(column) else column
    same = np.zeros((n, n), np.float32)
    width = 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (a, a + width))
        part = np.zeros((n, width), np.float32)
        part[rows[lo:hi], column[lo:hi] - a] = 1
        same += part @ part.T
    link = 100 * same >= percent * (sizes[:, None] + sizes[None, :] - same)
    if first.any() and not first.all():
        link &= first[:, None] != first[None, :]
    forest, fresh = [], np.ones(n, bool)
    for start in range(n):
        if fresh[start]:
            fresh[start] = False
            queue = [start]
            while queue:
                at = queue.pop()
                found = np.flatnonzero(link[at] & fresh)
                fresh[found] = False
                forest += [(at, int(k)) for k in found]
                queue += found.tolist()
    return forest


def shingle_table(docs: DataFrame, candidates: DataFrame, width: int) -> DataFrame:
    """(node, root, blocks, shingles) of the candidates, each set once or more. candidates: id_key and text_key of a row of each set, node, root, blocks."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                sets = shingle_sets(part["text"], width)
                own = np.array([bool(len(x)) and set_hash(x) == node for x, node in zip(sets, part["node"].to_pylist(), strict=True)], bool)
                data = pa.array([x.tobytes() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part["node"], part["root"], part["blocks"], data], ["node", "root", "blocks", "shingles"]).filter(pa.array(own))

    # Shuffled at every size: the candidates grow with the documents, so they are never broadcast.
    texts = _keyed(docs).hint("merge").join(candidates, ["id_key", "text_key"])
    return texts.select("text", "node", "root", "blocks").mapInArrow(build, "node long, root long, blocks int, shingles binary")


def _verified(dealt: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(a, b) links within each group of keys; rows: keys, first (boolean), node, shingles. Where both kinds occur, only links between them count."""

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").sort_values("node", ignore_index=True)
        forest = linked([np.frombuffer(x, np.uint64) for x in rows["shingles"]], rows["first"].to_numpy(bool), percent)
        node = rows["node"].to_numpy()
        return pd.DataFrame({"a": [node[i] for i, _ in forest], "b": [node[k] for _, k in forest]}, dtype="int64")

    return dealt.groupBy(*keys).applyInPandas(verify, "a long, b long")


def leader_links(sets: DataFrame, tied: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between nodes and the LEADERS leaders b that agree with them most. sets: node, n_shingles, shingles."""
    best = Window.partitionBy("a").orderBy(F.desc("agree"), F.xxhash64("b"), "b")
    picks = tied.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= LEADERS).select("a", "b")
    # A leader of many, or of long ones, stands in as many parts as its followers need.
    weighed = picks.join(sets.select(F.col("node").alias("a"), "n_shingles"), "a")
    parts = weighed.groupBy("b").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    followers = picks.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a", F.lit(2)), F.col("parts")).cast("int"))
    own = followers.select(F.col("a").alias("node"), "b", "part", F.lit(False).alias("leads"))
    heads = parts.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("leads"))
    dealt = own.union(heads).join(sets.select("node", "shingles"), "node")

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node")
        head = rows[rows["leads"]]
        if not len(head):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        leader = np.frombuffer(head["shingles"].iloc[0], np.uint64)
        found = []
        for node, data in zip(rows["node"], rows["shingles"], strict=True):
            other = np.frombuffer(data, np.uint64)
            common = int((leader[np.minimum(np.searchsorted(leader, other), len(leader) - 1)] == other).sum())
            if node != head["node"].iloc[0] and 100 * common >= percent * (len(leader) + len(other) - common):
                found.append(node)
        return pd.DataFrame({"a": found, "b": [head["node"].iloc[0]] * len(found)}, dtype="int64")

    return dealt.groupBy("b", "part").applyInPandas(verify, "a long, b long")


def _block_pairs(sets: DataFrame, known: DataFrame) -> DataFrame:
    """Rows dealt to the pairs of blocks that may still link different components: root, low, high, first, node, shingles.

    sets: node, root, n_shingles, shingles; known: (node, part), components found so far. A component that fills half a block or more has
    blocks of its own, which are not paired with each other; the others share mixed blocks. Groups of one component are left out.
    """
    placed = sets.join(known, "node", "left").withColumn("part", F.coalesce("part", "node"))
    sizes = placed.groupBy("root", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    several = sizes.groupBy("root").agg(F.count("*").alias("parts")).filter("parts > 1").select("root")
    label = F.when(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES) >= 0.5, F.col("part"))
    labels = sizes.join(several, "root", "left_semi").withColumn("label", label)
    many = labels.groupBy("root", "label").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("many"))
    before = F.coalesce(F.sum("many").over(Window.partitionBy("root").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    blocks = stored(many.withColumn("start", before))
    lists = blocks.groupBy("root").agg(F.collect_list(F.struct("label", "start", "many")).alias("others"))
    whose = labels.select("root", "part", "label").join(blocks.withColumnRenamed("label", "own"), "root").filter(F.col("label").eqNullSafe(F.col("own"))).select("root", "part", "label", "start", "many").join(lists, "root")
    dealt = placed.join(whose, ["root", "part"]).withColumn("block", F.col("start") + F.pmod(F.xxhash64("node"), F.col("many")).cast("int"))
    partners = F.filter("others", lambda o: o["label"].isNull() | ~o["label"].eqNullSafe(F.col("label")))
    others = F.flatten(F.transform(partners, lambda o: F.sequence(o["start"], o["start"] + o["many"] - 1)))
    pairs = dealt.select("root", "node", "shingles", "block", F.explode(others).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return pairs.select("root", low.alias("low"), high.alias("high"), (F.col("block") == low).alias("first"), "node", "shingles")


def links(docs: DataFrame, candidates: DataFrame, tied: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): enough verified links to connect what is linked. candidates: keys of a row, node, n_shingles and group `root` of each distinct set; tied: see ties()."""
    sizes = candidates.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sets = stored(shingle_table(docs, candidates.join(sizes, "root"), width).withColumn("n_shingles", F.octet_length("shingles") / 8))
    small = _verified(sets.filter("blocks = 1").select("root", F.lit(True).alias("first"), "node", "shingles"), ["root"], percent)
    large = sets.filter("blocks > 1").dropDuplicates(["node"])
    if sizes.filter("blocks > 1").isEmpty():
        return small
    led = stored(leader_links(large, tied.join(large.select(F.col("node").alias("a")), "a", "left_semi"), percent))
    known = stored(components(led)).select("node", F.col("root").alias("part"))
    return small.union(led).union(_verified(_block_pairs(large, known), ["root", "low", "high"], percent))


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, id_key, text_key, n_shingles, group, component_id) for every row of docs; group tells components apart, component_id is null where no doc_id names one."""
    signed = stored(signatures(docs, width))
    row = F.struct("id_key", "text_key")
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(row).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("minhashes").alias("minhashes"))
    tied = stored(ties(nodes.select("node", "minhashes")))
    groups = stored(components(tied))
    candidates = stored(nodes.select("node", "doc_id", "row.id_key", "row.text_key", "n_shingles").join(groups, "node"))
    roots = components(stored(links(docs, candidates.drop("doc_id"), tied, width, percent)))
    named = roots.join(candidates.select("node", "doc_id"), "node")
    component = named.join(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("node", F.col("root").alias("linked"), "component_id")
    first = nodes.select("node", F.col("doc_id").alias("first_id")).join(component, "node", "left")
    out = signed.select("doc_id", "id_key", "text_key", "n_shingles", "node").join(first, "node", "left")
    own = F.when(F.col("linked").isNotNull(), F.col("component_id")).when(F.col("node").isNotNull(), F.col("first_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "id_key", "text_key", "n_shingles", F.coalesce("linked", "node").alias("group"), own.alias("component_id"))


def near_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs: component_id is the least doc_id that links reach."""
    return _grouped(docs, width, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of docs for each component, with all columns."""
    rows = _grouped(docs, width, percent)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = rows.filter("group is not null").groupBy("group").agg(F.min_by(F.struct("id_key", "text_key"), order).alias("row")).select("row.*")
    kept = first.union(rows.filter("group is null").select("id_key", "text_key").distinct())
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_row_keys())
    # Both keys again tell which rows are equal, so this needs no further shuffle.
    return whole.join(kept.hint("merge"), ["id_key", "text_key"], "left_semi").dropDuplicates(["id_key", "text_key"]).select("row.*")

"""Exact duplicates by owners in Patricia tries.

Texts are compared byte by byte in compressed radix tries: an edge holds a run of bytes, a node ends a text, and what ends there is one
group. Each task first puts the texts of a window of its rows into a trie of its own, so that a text goes to the shuffle once a window,
with the doc_ids of its rows: a text that fills a third of the table costs as many copies as there are windows. Those entries are dealt to
partitions by length and content hash, where they meet in the trie of the partition; a terminal node stores the smallest entry that ended
there, its owner, and every entry learns its owner while it streams through. Owners gather sizes and the doc_id that stays by an aggregate
with partial sums, which is joined back to the entries; a row is never sought by its text again.

A partition's trie may be larger than memory. Its entries arrive sorted by their leading bytes, so from Spark's external sort come whole
subtrees one after another, spilled where they don't fit, and only the present subtree is held. Within it entries go by length and hash; if it
grows beyond TRIE_BYTES, it is dropped as soon as the next length and hash begin, as no earlier text can come again.

Defined cases: null text counts as empty and empty texts are one group; very long texts are compared whole; of a group the row with the
largest doc_id stays (with keep="smallest" the smallest), a null doc_id only where no other is there (keep_id is null then); of rows that
are equal in doc_id and text one stays; an empty table gives an empty result; other columns are ignored, `keep_one` returns them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.llm.common import stored

#: Distinct text and rows that a task's own trie holds before its entries go out.
WINDOW_BYTES, WINDOW_ROWS = 16 << 20, 1 << 16
#: Distinct text of one subtree beyond which a trie is dropped at the next length and hash.
TRIE_BYTES = 64 << 20
#: Leading bytes that tell subtrees apart.
SUBTREE_BYTES = 8


class Node:
    __slots__ = ("children", "label", "owner")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.owner = label, {}, None


def _shared(label: bytes, key: bytes, at: int) -> int:
    """How many bytes of label key continues with, by halving; fewer than all."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Texts as paths of byte runs."""

    def __init__(self) -> None:
        self.root, self.size = Node(b""), 0

    def end_of(self, key: bytes) -> Node:
        """The node at which key ends; its path is made where it is missing."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = child = Node(key[at:])
                self.size += len(key) - at
                return child
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            # The run forks, or key ends within it: a new node takes what is shared.
            same = _shared(child.label, key, at)
            fork = Node(child.label[:same])
            node.children[key[at]] = fork
            child.label = child.label[same:]
            fork.children[child.label[0]] = child
            node, at = fork, at + same
        return node


def _entries(docs: DataFrame, text: Column, largest: bool) -> DataFrame:
    """(entry, length, hash, sha256, text, ids): the different texts of each window, numbered, with the doc_ids of their rows, the one that stays first."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        trie, found, rows = Trie(), [], 0

        def out() -> pa.RecordBatch:
            nonlocal number
            texts = [text for text, _ in found]
            digests = [hashlib.sha256(text).digest() for text in texts]
            ids = [sorted(ids, key=lambda x: (x is None, 0 if x is None else -x if largest else x)) for _, ids in found]
            columns = [
                pa.array(range(number, number + len(found)), pa.int64()),
                pa.array([len(text) for text in texts], pa.int64()),
                pa.array([int.from_bytes(x[:8], "little", signed=True) for x in digests], pa.int64()),
                pa.array([x.hex() for x in digests]),
                pa.array(texts, pa.binary()),
                pa.array(ids, pa.list_(pa.int64())),
            ]
            number += len(found)
            return pa.RecordBatch.from_arrays(columns, ["entry", "length", "hash", "sha256", "text", "ids"])

        for batch in batches:
            for doc_id, key in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                key = key.as_py()
                node = trie.end_of(key)
                if node.owner is None:
                    node.owner = len(found)
                    found.append((key, []))
                found[node.owner][1].append(doc_id)
                rows += 1
                if trie.size >= WINDOW_BYTES or rows >= WINDOW_ROWS:
                    yield out()
                    trie, found, rows = Trie(), [], 0
        if found:
            yield out()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    return plain.mapInArrow(combine, "entry long, length long, hash long, sha256 string, text binary, ids array<long>")


def owned(entries: DataFrame) -> DataFrame:
    """(owner, entry, sha256, ids) of the entries: those of equal text have one owner, the smallest of them."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, subtree, present = Trie(), None, None
        for batch in batches:
            owners = []
            for entry, length, content, key in zip(batch["entry"].to_pylist(), batch["length"].to_pylist(), batch["hash"].to_pylist(), batch["text"], strict=True):
                key = key.as_py()
                if key[:SUBTREE_BYTES] != subtree or (length, content) != present and trie.size > TRIE_BYTES:
                    trie, subtree = Trie(), key[:SUBTREE_BYTES]
                present = length, content
                node = trie.end_of(key)
                if node.owner is None:
                    node.owner = entry
                owners.append(node.owner)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), batch["entry"], batch["sha256"], batch["ids"]], ["owner", "entry", "sha256", "ids"])

    leading = F.substring("text", 1, SUBTREE_BYTES)
    dealt = entries.repartition("length", "hash").sortWithinPartitions(leading, "length", "hash", "entry")
    return dealt.mapInArrow(settle, "owner long, entry long, sha256 string, ids array<long>")


def exact_groups(docs: DataFrame, text: Column | None = None, keep: str = "largest") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs. text: what is compared, the column of that name by default."""
    largest = {"largest": True, "smallest": False}[keep]
    entries = stored(owned(_entries(docs, F.col("text") if text is None else text, largest)))
    # The row that stays is the first of the entry whose first doc_id wins, the earliest of several.
    first = F.get("ids", 0)
    order = F.struct(first.isNotNull(), first if largest else -first, -F.col("entry"))
    groups = entries.groupBy("owner").agg(F.max_by(F.struct(F.col("entry").alias("keeper"), first.alias("keep_id")), order).alias("kept"), F.sum(F.size("ids")).alias("group_size"))
    rows = entries.join(groups, "owner").select("kept.keep_id", "kept.keeper", "group_size", "entry", F.col("sha256").alias("text_sha256"), F.posexplode("ids").alias("place", "doc_id"))
    return rows.select("doc_id", "keep_id", "group_size", ((F.col("entry") == F.col("keeper")) & (F.col("place") == 0)).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row of docs for each text, with all columns; of rows equal in doc_id and text any one."""
    found = exact_groups(docs, keep=keep).filter("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("own_sha256"))
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_sha256") == F.col("text_sha256"))
    return whole.join(found, same, "left_semi").dropDuplicates(["own_id", "own_sha256"]).select("row.*")

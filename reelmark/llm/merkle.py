"""Merkle manifest of a dataset: a digest of each row, a tree of digests for each language, one root over all, and each row's proof.

A leaf is the digest of a row's fields; the leaves of a language ascend by doc_id, and every FANOUT consecutive nodes of a level become the
digest of their hex digits, joined, until one node remains: the language's subroot. The subroots, in the order of languages, give the root
in the same way.

Leaves are numbered within their language by ranges, without one task that sees them all. A block is an aligned run of FANOUT^BLOCK_LEVELS
leaves and one group of a shuffle. A block is traversed in postorder: the visit of a subtree returns its digest and, while unwinding, appends
the siblings of each child to the proofs of the leaves that the child contains. The blocks' roots are the leaves of the next traversal,
and so on until a language has one block; the subroots are the leaves of a last tree, traversed likewise. On the way down each block's root
hands its own proof, a few digests a level, to the leaves of its block. Only digests are shuffled, never texts.

A leaf folds with its siblings to the root; that of a row that was changed since leads elsewhere.

Defined cases: null fields are written `-`; null doc_ids come first, and rows of equal doc_id are ordered by their digests, so repeated rows
are leaves of their own; a null language is one like the others and comes first, the empty one next; a lone leaf is its language's subroot,
a lone subroot the root, and without any sibling the proof is the digest of nothing; an empty table gives an empty result; other columns are
ignored. Very long texts are hashed where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.llm.common import stored
from reelmark.operators.ranks import numbered_within

#: Nodes that become one node of the next level.
FANOUT = 8
#: Levels of a block: a block has FANOUT^BLOCK_LEVELS leaves at most.
BLOCK_LEVELS = 4
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def field(value: Column) -> Column:
    """A value as a leaf holds it: its bytes counted, so that no two rows are written alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(x) for x in fields]).cast("binary"), 256)


def height(nodes: int) -> int:
    """Levels above `nodes` nodes until one remains."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FANOUT), levels + 1
    return levels


def traverse(leaves: list[str], levels: int) -> tuple[str, list[list[str]]]:
    """The digest of the tree of so many levels over `leaves`, and for each leaf the joined siblings of each level, from the lowest up."""
    proofs: list[list[str]] = [[] for _ in leaves]

    def visit(start: int, stop: int, level: int) -> str:
        if level == 0:
            return leaves[start]
        width = FANOUT ** (level - 1)
        cuts = range(start, stop, width)
        children = [visit(at, min(at + width, stop), level - 1) for at in cuts]
        for k, at in enumerate(cuts):
            # What stands before and after the child: folding needs to know where its digest goes.
            siblings = "".join(children[:k]) + "|" + "".join(children[k + 1 :])
            for i in range(at, min(at + width, stop)):
                proofs[i].append(siblings)
        return digest(children)

    return visit(0, len(leaves), levels), proofs


def folded(own: str, proof: list[str]) -> str:
    """The root that a leaf's digest leads to with the siblings of its proof."""
    for siblings in proof:
        before, after = siblings.split("|")
        own = digest([before, own, after])
    return own


def proof_digest(proof: list[str]) -> str:
    return digest([siblings.replace("|", "") for siblings in proof])


def _levels(blocks: int, n: int, block_levels: int) -> int:
    """Levels of a block: those of its whole tree, or all that a block can have where there are several."""
    return block_levels if blocks > 1 else height(n)


def _block(block_levels: int) -> Column:
    return F.floor(F.col("number") / FANOUT**block_levels).alias("block")


def _roots(nodes: DataFrame, keys: list[str], block_levels: int) -> DataFrame:
    """(keys, number, digest, blocks, of): the root of each block, one of `of` in its tree, as a node of the next traversal. nodes: keys, number, digest, blocks."""

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("number")
        of = rows["blocks"][0].as_py()
        root, _ = traverse(rows["digest"].to_pylist(), _levels(of, len(rows), block_levels))
        head = {name: rows[name].slice(0, 1) for name in keys}
        number = rows["number"][0].as_py() // FANOUT**block_levels
        return pa.table({**head, "number": pa.array([number], pa.int64()), "digest": [root], "blocks": pa.array([-(-of // FANOUT**block_levels)], pa.int64()), "of": pa.array([of], pa.int64())})

    fields = ", ".join(f"{name} {nodes.schema[name].dataType.simpleString()}" for name in keys)
    return nodes.groupBy(*keys, _block(block_levels)).applyInArrow(work, f"{fields}, number long, digest string, blocks long, of long")


def tree(leaves: DataFrame, keys: list[str], block_levels: int) -> tuple[DataFrame, list[DataFrame]]:
    """(keys, digest): the root of each tree; and the nodes of each traversal, the leaves first. leaves: keys, number, digest and what else a leaf has."""
    own = [F.col(name).alias(f"of_{name}") for name in keys]
    blocks = leaves.groupBy(*own).agg(F.ceil(F.count("*") / FANOUT**block_levels).alias("blocks"))
    joined = leaves.join(blocks, [leaves[name].eqNullSafe(blocks[f"of_{name}"]) for name in keys])
    floors = [stored(joined.drop(*[f"of_{name}" for name in keys]))]
    ends = None
    while True:
        roots = stored(_roots(floors[-1], keys, block_levels))
        ended = roots.filter("of = 1").select(*keys, "digest")
        ends = ended if ends is None else ends.union(ended)
        above = roots.filter("of > 1").drop("of")
        if above.isEmpty():
            return ends, floors
        floors.append(above)


def _proved(nodes: DataFrame, above: DataFrame | None, keys: list[str], block_levels: int, columns: str, finish: Callable[[pa.Table, list[list[str]]], pa.Table]) -> DataFrame:
    """finish() of the rows of each block and their proofs. nodes as for _roots(); above: (keys, number, proof) of the roots of blocks in trees of several."""
    if above is None:
        nodes = nodes.withColumn("proof", F.lit(None).cast("array<string>"))
    else:
        handed = above.select(*[F.col(name).alias(f"of_{name}") for name in keys], F.col("number").alias("of_block"), "proof")
        same = [nodes[name].eqNullSafe(handed[f"of_{name}"]) for name in keys]
        # A row for each block, to as many nodes as a block has.
        nodes = nodes.join(handed, [*same, F.floor(nodes["number"] / FANOUT**block_levels) == handed["of_block"]], "left")

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("number")
        _, proofs = traverse(rows["digest"].to_pylist(), _levels(rows["blocks"][0].as_py(), len(rows), block_levels))
        tail = rows["proof"][0].as_py() or []
        return finish(rows, [proof + tail for proof in proofs])

    return nodes.groupBy(*keys, _block(block_levels)).applyInArrow(work, columns)


def proofs(floors: list[DataFrame], keys: list[str], block_levels: int, columns: str, finish: Callable[[pa.Table, list[list[str]]], pa.Table]) -> DataFrame:
    """finish() of the leaves' blocks and their proofs up to their tree's root: the way down through the floors of tree()."""
    fields = ", ".join(f"{name} {floors[0].schema[name].dataType.simpleString()}" for name in keys)

    def hand_down(rows: pa.Table, found: list[list[str]]) -> pa.Table:
        return pa.table({**{name: rows[name] for name in keys}, "number": rows["number"], "proof": pa.array(found, pa.list_(pa.string()))})

    above = None
    for nodes in reversed(floors[1:]):
        above = stored(_proved(nodes, above, keys, block_levels, f"{fields}, number long, proof array<string>", hand_down))
    return _proved(floors[0], above, keys, block_levels, columns, finish)


def _finished(rows: pa.Table, found: list[list[str]]) -> pa.Table:
    root, top = rows["root"][0].as_py(), rows["top_proof"][0].as_py()
    whole = [proof + top for proof in found]
    ends = [folded(x, proof) for x, proof in zip(rows["found"].to_pylist(), whole, strict=True)]
    out = {name: rows[name] for name in ("doc_id", "lang", "number")} | {"leaf": rows["digest"], "subroot": rows["subroot"], "root": rows["root"]}
    return pa.table(out | {"proof": pa.array(whole, pa.list_(pa.string())), "proof_sha256": [proof_digest(proof) for proof in whole], "folded_root": ends, "verified": [x == root for x in ends]})


def manifest(docs: DataFrame, found_text: Column | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(doc_id, lang, number, leaf, subroot, root, proof, proof_sha256, folded_root, verified) for each row of docs.

    number is the leaf's place in its language; proof has the siblings of each level, those before the own node and those after it set apart
    by `|`. found_text is the text that a later reader finds, the row's own by default: folded_root is where its leaf leads with the proof.
    """
    own = [F.col(name) for name in FIELDS]
    now = [*own[:-1], found_text if found_text is not None else own[-1]]
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf(own).alias("digest"), leaf(now).alias("found"), F.monotonically_increasing_id().alias("row"))
    # Ranges are found by a sample of the rows; without this table texts would be hashed for it once more.
    # The number of its row tells a repeated row's copies apart, which may be as many as a third of the table.
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("found")]
    numbered_leaves = numbered_within(stored(leaves), ["lang"], order, "number", F.col("row")).drop("row")
    subroots, floors = tree(numbered_leaves, ["lang"], block_levels)

    # The subroots are the leaves of one more tree.
    numbered_tops = numbered_within(subroots.withColumn("tree", F.lit(0)), ["tree"], [F.col("lang").asc_nulls_first()], "number")
    roots, top_floors = tree(numbered_tops, ["tree"], block_levels)

    def named(rows: pa.Table, found: list[list[str]]) -> pa.Table:
        return pa.table({"tree": rows["tree"], "of_lang": rows["lang"], "subroot": rows["digest"], "top_proof": pa.array(found, pa.list_(pa.string()))})

    tops = proofs(top_floors, ["tree"], block_levels, "tree int, of_lang string, subroot string, top_proof array<string>", named)
    tops = stored(tops.join(roots.select("tree", F.col("digest").alias("root")), "tree").drop("tree"))
    floors[0] = floors[0].join(tops, floors[0]["lang"].eqNullSafe(tops["of_lang"])).drop("of_lang")
    columns = "doc_id long, lang string, number long, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string, verified boolean"
    return proofs(floors, ["lang"], block_levels, columns, _finished)

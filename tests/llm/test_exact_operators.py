"""Hard negatives, the Merkle manifest and exact duplicates: whole queries beside their SQL, and small tables against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmark.llm import exact_dedup, hard_negatives, merkle, queries
from tests.compare import differences

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_merkle_manifest", "op13_exact_dedup"])
def test_query_equals_its_sql(name, spark, small):
    assert differences(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, small) == ""


# Hard negatives ------------------------------------------------------------------------------------------------------------------------


def brute_negatives(rows, anchors, positives=5, negatives=10, low=30, high=90):
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for anchor, label, v in rows:
        if not anchors(anchor):
            continue
        others = sorted((-score(v, w), i, m) for i, m, w in rows)
        for p, i, _ in [x for x in others if x[2] == label and x[1] != anchor][:positives]:
            wanted = [(s, j) for s, j, m in others if m != label and low * -p <= 100 * -s <= high * -p][:negatives]
            out += [(anchor, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(wanted)]
    return sorted(out)


def mined(spark, rows, anchors, **options):
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>")
    return sorted(tuple(r) for r in hard_negatives.mine(df, anchors, **options).collect())


@pytest.mark.parametrize("shard", [1 << 11, 20])
def test_negatives_equal_brute_force(spark, monkeypatch, shard):
    """Few labels, many equal vectors and scores, negative scores; one shard, and more than one round of shards."""
    monkeypatch.setattr(hard_negatives, "LEAST_SHARD_ROWS", shard)
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", shard)
    monkeypatch.setattr(hard_negatives, "QUERY_ROWS", 16)
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), [rng.randrange(-6, 7) for _ in range(5)]) for i in range(300)]
    rows += [(1000 + i, 1, [3, 3, 3, 3, 3]) for i in range(150)]
    assert mined(spark, rows, F.col("vec_id") % 9 == 0) == brute_negatives(rows, lambda i: i % 9 == 0)


def test_negatives_with_few_rows(spark):
    rows = [(0, 1, [4, 0]), (1, 1, [2, 0]), (2, 2, [1, 0]), (3, 2, [0, 5]), (4, 1, [0, 0])]
    assert mined(spark, rows, F.col("vec_id") == 0) == brute_negatives(rows, lambda i: i == 0) == [(0, 1, 1, 2, 8, 4), (0, 4, 1, 3, 0, 0)]
    assert mined(spark, rows[:1], F.lit(True)) == [] and mined(spark, [], F.lit(True)) == []
    same = [(i, i % 2, [1, 1]) for i in range(40)]
    assert mined(spark, same, F.col("vec_id") == 0) == brute_negatives(same, lambda i: i == 0) == []


def test_shorter_vectors_and_repeated_rows(spark):
    rows = [(0, 1, [2, 2]), (1, 1, [4]), (2, 2, [2, 1]), (2, 2, [2, 1]), (3, 2, []), (0, 1, [2, 2])]
    got = mined(spark, rows, F.col("vec_id") == 0)
    assert got == sorted([(0, 1, k, 2, 8, 6) for k in (1, 2)] * 2)


def test_long_vectors_are_multiplied_in_whole_numbers(spark):
    big = 1 << 28
    rows = [(i, i % 2, [big + i, -big + 3 * i, i]) for i in range(30)]
    assert mined(spark, rows, F.col("vec_id") % 5 == 0, low=1, high=100) == brute_negatives(rows, lambda i: i % 5 == 0, low=1, high=100)
    with pytest.raises(ArithmeticError):
        mined(spark, [(0, 1, [1 << 30, 0]), (1, 1, [0, 1])], F.lit(True))


def test_rows_that_take_no_part(spark):
    schema = "vec_id long, label int, embedding array<float>, v string, d string, extra int"
    nan, inf = float("nan"), float("inf")
    data = [(1, 1, [0.5, -0.001]), (2, None, [1.0]), (3, 1, None), (4, 1, [None, 1.0]), (5, 1, [nan]), (6, 1, [inf]), (None, 1, [1.0]), (7, 2, [])]
    got = hard_negatives.usable(spark.createDataFrame([(*r, "x", "y", 1) for r in data], schema)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, [128, -1]), (7, 2, [])]


def test_brackets_spare_products_but_no_result(spark):
    """Of two clouds far apart an anchor's own is multiplied out, the other hardly."""
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, (np.array([200, 0] if i % 4 < 2 else [0, 200]) + rng.integers(-3, 4, 2)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>")
    table, space = hard_negatives.pivot_table(df)
    left = table.toArrow()
    anchors = table.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.lit(0).alias("slot"), "vec_id", "label", "v", F.lit(38000).cast("long").alias("low"), F.lit(1 << 62).alias("high"), F.lit(-(1 << 62)).alias("least")).toArrow()
    found, multiplied = hard_negatives.visit(space, left, anchors, True, 5)
    assert multiplied < 0.6 * len(rows) * len(anchors) and len(found) == 5 * len(anchors)
    whole = {i: (label, v) for i, label, v in rows}
    for query, group in found.groupby("query"):
        label, v = whole[query]
        best = sorted((-np.dot(v, w), i) for i, (m, w) in whole.items() if m == label and i != query)[:5]
        assert [(-s, i) for s, i in best] == list(zip(*(group.sort_values(["score", "vec_id"], ascending=[False, True])[c].tolist() for c in ("score", "vec_id")), strict=True))


# Merkle manifest -----------------------------------------------------------------------------------------------------------------------


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[k : k + 8]).encode()).hexdigest() for k in range(0, len(below), 8)])
    return levels


def plain_proof(levels, k):
    out = []
    for level in levels[:-1]:
        run = k // 8 * 8
        out.append(("".join(level[run:k]), "".join(level[k + 1 : run + 8])))
        k //= 8
    return out


def plain_manifest(rows, text_of):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: sha("".join(map(part, (r[0], r[3], r[2], r[4], text))))
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, text_of(r)), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_levels([leaf for _, _, leaf, _, _ in sorted(by_lang[x], key=lambda y: y[:4])]) for x in langs}
    top = plain_levels([trees[x][-1][0] for x in langs])
    out = []
    for j, lang in enumerate(langs):
        for k, (_, _, own, found, r) in enumerate(sorted(by_lang[lang], key=lambda y: y[:4])):
            proof = plain_proof(trees[lang], k) + plain_proof(top, j)
            for before, after in proof:
                found = sha(before + found + after)
            out.append((r[0], own, trees[lang][-1][0], top[-1][0], sha("".join(a + b for a, b in proof)), found, found == top[-1][0]))
    return sorted(out, key=str)


def proven(df, text=None, levels=merkle.BLOCK_LEVELS):
    return sorted((tuple(r) for r in merkle.manifest(df, text, levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def odd_rows(n):
    texts = ["", None, "ABC", "Zürich\n", "x " * 5000, "same", "same", "日本語"]
    rows = [(None if i % 19 == 18 else i, texts[i % 8], [None, "", "en", "de", "zz", "é"][i * i % 6], None if i % 7 == 6 else f"s{i % 3}", None if i % 5 == 4 else i) for i in range(n)]
    return rows + rows[:3]


@pytest.mark.parametrize("levels", [4, 1])
def test_manifest_equals_plain_trees(spark, levels):
    """With blocks of one level the trees take several traversals each."""
    rows = odd_rows(400)
    rows += [(1000 + i, f"t{i}", f"l{i:03}", "s", 1) for i in range(70)]
    df = spark.createDataFrame(rows, DOCS)
    changed = F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    assert proven(df, changed, levels) == plain_manifest(rows, lambda r: r[1].lower() if r[0] is not None and r[0] % 3 == 0 and r[1] is not None else r[1])


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_one_language_of_some_size(spark, n):
    rows = [(i, "A", "en", "s", 1) for i in range(n)]
    assert proven(spark.createDataFrame(rows, DOCS)) == plain_manifest(rows, lambda r: r[1])


def test_manifest_edges(spark):
    assert proven(spark.createDataFrame([], DOCS)) == []
    clashing = spark.createDataFrame([(*r, "n", "p", 1) for r in odd_rows(30)], DOCS + ", number string, proof string, blocks int")
    assert proven(clashing) == plain_manifest(odd_rows(30), lambda r: r[1])
    with pytest.raises(ValueError):
        merkle.folded("a", ["no mark of the own place"])


def test_copies_of_one_row_are_numbered_by_many_tasks(spark, monkeypatch):
    rows = [(7, "same", "en", "s", 1)] * 3000 + [(k, f"t{k}", "en", "s", 1) for k in range(20)]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    from reelmark.operators import ranks

    sizes = []
    monkeypatch.setattr(ranks, "ranged", lambda *a, make=ranks.ranged: (lambda out: sizes.append([r["count"] for r in out.groupBy("_range").count().collect()]) or out)(make(*a)))
    assert proven(df) == plain_manifest(rows, lambda r: r[1])
    assert max(sizes[0]) < 2000


def test_traversal_counts_its_levels():
    for n in (1, 2, 7, 8, 9, 63, 64, 65, 513):
        leaves = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)]
        root, proofs = merkle.traverse(leaves, merkle.height(n))
        assert root == plain_levels(leaves)[-1][0]
        assert all(merkle.folded(leaf, proof) == root for leaf, proof in zip(leaves, proofs, strict=True))


# Exact duplicates ----------------------------------------------------------------------------------------------------------------------


def brute_groups(rows, largest=True):
    by_text = defaultdict(list)
    for doc_id, text in rows:
        by_text[text or ""].append(doc_id)
    out = []
    for text, ids in by_text.items():
        known = [x for x in ids if x is not None]
        keep = None if not known else max(known) if largest else min(known)
        stays = [True] + [False] * (ids.count(keep) - 1)
        for x in ids:
            out.append((x, keep, len(ids), stays.pop(0) if x == keep else False, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def texts_to_group(rng, n):
    stems = ["", "a", "ab", "abc", "same head and then ", "é", "x" * 3000]
    return [rng.choice(stems) + rng.choice(["", "a", "b", "ab" * rng.randrange(3), str(rng.randrange(40))]) for _ in range(n)]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_groups_equal_a_dictionary(spark, keep):
    rng = random.Random(2)
    rows = [(None if i % 23 == 0 else i % 500, None if i % 31 == 0 else t) for i, t in enumerate(texts_to_group(rng, 1500))]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, owner string, entry int").repartition(7)
    assert sorted((tuple(r) for r in exact_dedup.exact_groups(df, keep=keep).collect()), key=str) == brute_groups(rows, keep == "largest")
    kept = exact_dedup.keep_one(df, keep)
    assert kept.columns == df.columns
    stays = {(r[0], r[4]) for r in brute_groups(rows, keep == "largest") if r[3]}
    found = [(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect()]
    assert len(found) == len(stays) and set(found) == stays


def test_groups_of_nothing_and_of_one_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(empty).collect() == [] and exact_dedup.keep_one(empty).collect() == []
    rows = [(5, "t"), (5, "t"), (None, "t"), (3, None), (3, "")]
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_groups(rows)


def test_a_text_may_be_compared_in_another_form(spark):
    df = spark.createDataFrame([(1, "A"), (2, "a")], "doc_id long, text string")
    assert {r.keep_id for r in exact_dedup.exact_groups(df, F.lower("text")).collect()} == {2}


def test_tries_end_texts_where_a_dictionary_does():
    rng = random.Random(4)
    trie, seen = exact_dedup.Trie(), {}
    for text in texts_to_group(rng, 3000):
        key = text.encode()
        node = trie.end_of(key)
        assert (node.owner is None) == (key not in seen)
        node.owner = seen.setdefault(key, len(seen))
        assert trie.end_of(key).owner == seen[key]
    assert trie.size <= sum(map(len, seen))


def test_texts_of_one_length_and_hash_are_told_apart(spark):
    """Entries that pretend to equal hashes share a partition, yet only equal bytes share an owner, whatever subtree they lie in."""
    data = [(k, 4, 7, f"sha{t}", bytearray(t.encode()), [k]) for k, t in enumerate(["aaaa", "aaab", "bbbb", "aaaa", "bbbb", "aaaa"])]
    entries = spark.createDataFrame(data, "entry long, length long, hash long, sha256 string, text binary, ids array<long>")
    got = {r.entry: r.owner for r in exact_dedup.owned(entries).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 2, 5: 0}

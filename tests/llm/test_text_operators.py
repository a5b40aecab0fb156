"""Quality, language ID, mixing, packing and near-duplicates on small tables against brute force."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelmark.llm import language_id, mixing, near_dedup, packing, quality, queries, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "   \n", "a", "Zürich", "x " * 5000, "same text of seven words right here", "same text of seven words right here", "!!! ???", "日本語のテキスト"]


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, None if i % 5 == 4 else "en", None if i % 7 == 6 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], schema)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).union(frame(spark, ODD).filter("doc_id = 4"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# Quality -------------------------------------------------------------------------------------------------------------------------------


def test_quality_separates_grades(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    rows, rated = [], []
    for i in range(900):
        text = " ".join(rng.choice(words) for _ in range(60))
        kind = i % 6
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind == 1:
            text += " vile foul"
        rows.append((i, text))
        rated.append((i, int(kind != 0), int(kind == 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(rated, "doc_id long, quality int, toxic int").filter("doc_id % 5 <> 0")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    kept = lambda kind: np.mean([got[i].quality_kept for i in range(900) if i % 6 == kind])
    assert kept(0) < 0.05 and kept(1) < 0.1 and kept(2) > 0.95
    assert all(0 <= got[i].p_tail <= got[i].expected_grade <= 2 for i in got)


def test_quality_scores_equal_a_plain_sum():
    texts = pa.array([*ODD, "One, two THREE three!! (four)"])
    bits = 12
    weights = np.random.default_rng(3).normal(size=1 << bits).astype(np.float32)
    model = quality.OrdinalModel(weights, np.array([0.0, 1.0]))
    whole = [weights[n[a:b]].sum() for n, o in quality.features(texts, bits) for a, b in zip(o[:-1], o[1:], strict=True)]
    alone = [float(model.scores(texts.slice(k, 1))[0]) for k in range(len(texts))]
    assert np.allclose(whole, model.scores(texts), atol=1e-3) and np.allclose(alone, whole, atol=1e-3)


def test_the_fit_is_the_likeliest():
    """No step from the fitted weights and thresholds raises the penalised likelihood, worked out row by row."""
    rng = np.random.default_rng(18)
    lists, grades = [], []
    for _ in range(600):
        own = np.flatnonzero(rng.random(6) < 0.4)
        score = np.array([1.5, -2.0, 0.8, 0.0, 0.0, 0.5])[own].sum() + rng.logistic()
        lists.append(own)
        grades.append(int(score > 0) + int(score > 1.5))
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    grades = np.array(grades)
    model = quality.fit_ordinal(np.concatenate(lists), offsets, grades, 3, bits=4, passes=3000, ridge=0.002)
    used = np.flatnonzero(model.weights)
    assert set(used) <= set(range(6)) and {0, 1} <= set(used)

    def loss(weights: np.ndarray, cuts: np.ndarray) -> float:
        total = 0.0
        for own, grade in zip(lists, grades, strict=True):
            above = [1.0, *(1 / (1 + np.exp(c - weights[own].sum())) for c in cuts), 0.0]
            total -= np.log(above[grade] - above[grade + 1])
        return total / len(grades) + 0.002 / len(grades) / 2 * (weights**2).sum()

    weights, cuts = model.weights.astype(float), model.thresholds
    best = loss(weights, cuts)
    for step in (-0.05, 0.05):
        for k in used:
            moved = weights.copy()
            moved[k] += step
            assert loss(moved, cuts) > best - 1e-6
        for k in range(2):
            moved = cuts.copy()
            moved[k] += step
            assert loss(weights, moved) > best - 1e-6
    tails = model.tails(np.array([0.3]))[0]
    assert tails == pytest.approx([1 / (1 + np.exp(c - 0.3)) for c in cuts])


def test_one_text_of_a_repeated_document_is_learned_from(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k} word{k % 3}") for k in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    one, other = (quality.train(d, labels, bits=12) for d in (docs, docs.orderBy(F.desc("text")).repartition(7)))
    assert (one.weights == other.weights).all() and (one.thresholds == other.thresholds).all()


def test_quality_edges(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    flat = quality.classify(odd.withColumn("p_tail", F.lit("mine")), labels)
    assert flat.count() == odd.count() and flat.filter("quality_kept").count() == odd.count() and flat.columns.count("p_tail") == 1
    some = spark.createDataFrame([(0, 0, 0), (6, 1, 0), (99, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, some).count() == odd.count()
    assert quality.classify(empty, some).count() == 0


# Language ID -----------------------------------------------------------------------------------------------------------------------------


def test_kneser_ney_sums_to_one():
    texts = pa.array(["abc abd abe bca", "cab dab", "aaa bbb"])
    model = language_id.fit_kneser_ney(["x"], [np.unique(np.concatenate([k for k, _ in language_id.grams(texts)]), return_counts=True)])
    alphabet = model.keys[1]
    for history in (0, ord("a"), ord("a") << 16 | ord("b"), ord("z")):
        keys = np.array([(history << 16 | int(c)) & ((1 << 64) - 1) for c in alphabet], np.uint64)
        total = float(np.exp2(model.log2(4, keys).astype(np.float64)).sum()) + float(np.exp2(model.log2(4, np.array([history << 16 | 0x3FF], np.uint64)).astype(np.float64))[0, 0])
        assert total == pytest.approx(1, abs=1e-3)


def plain_kneser_ney(texts: list[str], letters: int):
    """Interpolated Kneser-Ney as it is written down: a function from a history and a symbol to a probability."""
    from collections import Counter

    counts = {k: Counter() for k in range(1, 5)}
    for text in texts:
        symbols = plain_symbols(text)
        counts[4].update(tuple(symbols[k - 3 : k + 1]) for k in range(3, len(symbols)))
    for k in (3, 2, 1):
        counts[k] = Counter(gram[1:] for gram in counts[k + 1])
    discounts = {}
    for k, own in counts.items():
        ones, twos = (sum(v == n for v in own.values()) for n in (1, 2))
        discounts[k] = ones / (ones + 2 * twos) if ones and twos else 0.5

    def probability(history: tuple, symbol: str) -> float:
        if not history:
            lower = 1 / (letters + 1)
        else:
            lower = probability(history[1:], symbol)
        own, d = counts[len(history) + 1], discounts[len(history) + 1]
        after = {g: n for g, n in own.items() if g[:-1] == history}
        total = sum(after.values())
        return lower if not total else (max(after.get((*history, symbol), 0) - d, 0) + d * len(after) * lower) / total

    return probability


def plain_symbols(text: str) -> list[str]:
    out = [""] * 3
    for k, c in enumerate(text):
        if c.isalpha():
            out.append(c.lower()[0])
        elif k and text[k - 1].isalpha():
            out.append("")
    return out


def test_entropies_equal_plain_kneser_ney(monkeypatch):
    monkeypatch.setattr(language_id, "SIDE_BY_SIDE", 2)
    rng = random.Random(17)
    corpora = {lang: [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(12)) + rng.choice([".", "", "!? x"]) for _ in range(4)] for lang, letters in (("a", "abcÄ"), ("b", "bcd"), ("c", "xyzab"))}
    counts = [np.unique(np.concatenate([k for k, _ in language_id.grams(pa.array(t))]), return_counts=True) for t in corpora.values()]
    model = language_id.fit_languages(list(corpora), counts)
    assert model.langs == list(corpora) and len(model.parts) == 2
    letters = len({s for t in corpora.values() for x in t for s in plain_symbols(x)[3:]})
    texts = ["abc bcd", "Äxyz q, ab!", "d", "12 zz y-x", *corpora["c"][:2]]
    bits, sizes = model.entropies(pa.array(texts))
    for col, own in enumerate(corpora.values()):
        probability = plain_kneser_ney(own, letters)
        for row, text in enumerate(texts):
            symbols = plain_symbols(text)
            while symbols[3:] and symbols[3] == "":
                del symbols[3]
            plain = [-np.log2(probability(tuple(symbols[k - 3 : k]), symbols[k])) for k in range(3, len(symbols))]
            assert sizes[row] == len(plain) and bits[row, col] == pytest.approx(np.mean(plain), abs=1e-4)


def test_languages_are_told_apart(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    got = language_id.identify(docs.select("doc_id", "text", F.col("lang").alias("truth")), docs).withColumn("held", language_id.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held]
    assert held and np.mean([r.lang_pred == r.truth for r in held]) > 0.95
    assert np.mean([r.lang_accepted for r in got]) > 0.98


def test_what_is_no_learned_language_is_rejected(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(5)
    letters = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))
    # An outlier among each language's calibration texts: random letters under its label.
    tried = spark.createDataFrame([(10**6 + k, letters(100)) for k in range(100)], "doc_id long, text string")
    calibrating = tried.filter(~language_id.held_out(F.col("doc_id")) & (F.pmod(F.xxhash64("text", F.lit(1)), F.lit(5)) == 0)).limit(4).collect()
    outliers = [(r.doc_id, r.text, lang) for r, lang in zip(calibrating, ("de", "en", "es", "fr"), strict=True)]
    strange = [letters(n) for n in (4, 8, 20, 80, 300) for _ in range(4)] + [
        "Kolme pientä porsasta rakensi talon metsän reunaan ja susi tuli puhaltamaan sen nurin kun talvi oli kylmä",
        "Het was een koude dag in april en de klokken sloegen dertien toen hij door de glazen deuren van het gebouw liep",
    ]
    mixed = docs.unionByName(spark.createDataFrame(outliers, "doc_id long, text string, lang string"))
    got = language_id.identify(docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-k - 1, t) for k, t in enumerate(strange)], "doc_id long, text string")), mixed).collect()
    assert not [r.text for r in got if r.doc_id < 0 and r.lang_accepted]
    assert np.mean([r.lang_accepted for r in got if r.doc_id >= 0]) > 0.98


def test_language_edges(spark, odd, empty):
    got = language_id.identify(odd.withColumn("score", F.lit(9))).collect()
    assert len(got) == odd.count()
    blank = {r.doc_id: r for r in got}
    assert all(blank[i].lang_pred == "und" and blank[i].score == 0 and not blank[i].lang_accepted for i in (0, 1, 2, 8))
    assert language_id.identify(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# Mixing ----------------------------------------------------------------------------------------------------------------------------------


def poured(budget: int, supplies: list[int], weights: list[int]) -> list[float]:
    """Budgets by repeated sharing: whoever is full gives back what is over."""
    given, open_ = [0.0] * len(supplies), set(range(len(supplies)))
    left = float(budget)
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if supplies[k] - given[k] <= left * weights[k] / total + 1e-9}
        if not full:
            for k in open_:
                given[k] += left * weights[k] / total
            return given
        used = sum(supplies[k] - given[k] for k in full)
        for k in full:
            given[k] = float(supplies[k])
        left, open_ = left - used, open_ - full
    return given


def test_shares_equal_repeated_pouring(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for parent in range(30):
        n = rng.randint(1, 6)
        supplies, weights = [rng.choice((0, 10, 1000, 50)) + rng.randint(0, 30) for _ in range(n)], [rng.randint(1, 5) for _ in range(n)]
        budget = rng.randint(0, int(1.3 * sum(supplies)) + 5)
        rows += [(parent, f"c{k}", s, w, budget) for k, (s, w) in enumerate(zip(supplies, weights, strict=True))]
        expected[parent] = poured(min(budget, sum(supplies)), supplies, weights)
    got = mixing.share(spark.createDataFrame(rows, "p int, node string, supply long, weight long, parent_budget long"), ["p"]).collect()
    assert len(got) == len(rows)
    assert all(abs(r.budget - expected[r.p][int(r.node[1:])]) <= 1 for r in got)


def test_prefixes_fill_their_budgets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = mixing.mix(docs, queries.mix_domain(), queries.mix_weights(), 0.9, 3, "s").collect()
    tokens = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    leaves, sizes = defaultdict(lambda: defaultdict(list)), defaultdict(dict)
    for r in docs.select("*", queries.mix_domain().alias("domain")).collect():
        sizes[r.domain, r.lang, r.source][r.doc_id] = tokens[r.doc_id]
    for r in got:
        leaves[r.domain, r.lang, r.source, r.leaf_budget][r.epoch].append(r.doc_id)
    for (*leaf, budget), epochs in leaves.items():
        own = sizes[tuple(leaf)]
        for e, ids in epochs.items():
            order = sorted(own, key=lambda d: hashlib.md5(f"s|{e}|{d}".encode()).hexdigest())
            assert sorted(ids) == sorted(order[: len(ids)])  # a prefix of the epoch's order
            spent = sum(own.values()) * e + sum(own[d] for d in ids)
            assert spent <= budget
            if len(ids) < len(order):
                assert spent + own[order[len(ids)]] > budget


def test_mixing_edges(spark, odd, empty):
    inner = ("tokens", "full", "last_range", "last_spot", "mix_domain", "mix_lang", "mix_source", "row", "size", "budget")
    clashing = odd.withColumn("epoch", F.lit("mine")).withColumns({name: F.lit(f"own {name}") for name in inner})
    got = mixing.mix(clashing, queries.mix_domain(), queries.mix_weights(), 5.0, 2, "s")
    rows = got.collect()
    assert got.columns == [*odd.columns, *inner, "domain", "epoch", "leaf_budget"]
    assert all(r[name] == f"own {name}" for r in rows for name in inner)
    assert {r.doc_id for r in rows} == set(range(len(ODD)))
    assert mixing.mix(empty, queries.mix_domain(), queries.mix_weights(), 1.0, 2, "s").count() == 0


# Packing ---------------------------------------------------------------------------------------------------------------------------------


def test_ids_equal_the_tokenizer():
    encode = packing.encoder(public_tokenizers.path(queries.TOKENIZER))
    for text in [*[t or "" for t in ODD], "it's <|endoftext|> don't", "ªº½ x² a_b é É", "a\x1cb\x85c\xa0d", "can't,'s. ''ve 12ab34 -- !!.,é'É", "ΑΣ Σ İi", "<|ENDOFTEXT|>", "naïve, (Œuvre) ÀÉ. f­f"]:
        ids = encode.tokenizer.encode(text, add_special_tokens=False).ids
        assert encode.encode(text) == struct.pack(f"<{len(ids)}I", *ids), text


def test_ids_of_random_characters_equal_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "_CACHED", 200)  # so that pretokens are dropped and encoded again
    encode = packing.encoder(public_tokenizers.path(queries.TOKENIZER))
    rng = random.Random(5)
    characters = [*map(chr, range(256)), *(["'s", "'ll", "'re", "'", " ", "a", "é", "<|", "|>", "\n", "1", "²"] * 8)]
    plain = [c for c in characters if c not in packing._ODD]
    for k in range(6000):
        text = "".join(rng.choice(plain if k % 3 else characters) for _ in range(rng.randint(1, 40)))
        ids = encode.tokenizer.encode(text, add_special_tokens=False).ids
        assert encode.encode(text) == struct.pack(f"<{len(ids)}I", *ids), text


def test_other_tokenizers_give_their_own_ids(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = packing.encoder(path)
    assert not encode.cuts_known and packing.encoder(public_tokenizers.path(queries.TOKENIZER)).cuts_known
    for text in ["It's Upper CASE", "  two  blanks\n", *[t or "" for t in ODD]]:
        ids = encode.tokenizer.encode(text, add_special_tokens=False).ids
        assert encode.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(4)
    lengths = sorted((rng.randint(1, 64) for _ in range(400)), reverse=True)
    rooms: list[int] = []
    used = [0]
    number, offset = packing.best_fit(lengths, 64)
    for need, n, at in zip(lengths, number, offset, strict=True):
        fits = [r for r in rooms if r >= need]
        if fits:
            assert rooms[n] == min(fits) and at == 64 - rooms[n]
        else:
            assert n == len(rooms) and at == 0
            rooms.append(64)
        rooms[n] -= need
    assert used and min(rooms) >= 0


def test_packing_is_whole(spark, odd, empty):
    path = public_tokenizers.path(queries.TOKENIZER)
    long = " ".join(f"word{k}" for k in range(4000))
    docs = odd.select("doc_id", "text", F.lit(1).alias("start")).union(spark.createDataFrame([(50, long, 1)], "doc_id long, text string, start int"))
    rows = packing.pack_documents(docs, path, group_documents=4).collect()
    texts = {i: t or "" for i, t in enumerate(ODD)} | {50: long}
    encode = packing.encoder(path).encode
    pieces = defaultdict(list)
    for r in rows:
        ids = encode(texts[r.doc_id]) + struct.pack("<I", 1)
        assert r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
        pieces[r.doc_id].append((r.start, r.length))
    for doc_id, own in pieces.items():
        copies = 2 if doc_id == 4 else 1
        own = sorted(own)[::copies]
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == len(encode(texts[doc_id])) // 4 + 1
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for own in windows.values():
        own.sort()
        assert all(a == sum(n for _, n in own[:k]) for k, (a, _) in enumerate(own)) and sum(n for _, n in own) <= 2048
    assert packing.pack_documents(empty, path).count() == 0


# Near-duplicates -------------------------------------------------------------------------------------------------------------------------


def plain_set(text: str | None, width: int = 4) -> frozenset:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def plain_components(texts: dict[int, str | None], percent: int = 80, width: int = 4) -> dict[int, int]:
    sets = {i: plain_set(t, width) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in texts}


def test_shingle_sets_count_like_plain_ones(small, spark):
    texts = [*ODD, "One two\tTHREE\x0bfour five", "É é É é É é", "a b c d a b c d", "ends with blank ", " starts"]
    sets = shingles.shingle_sets(pa.array(texts), 4)
    plain = [plain_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert len(np.intersect1d(sets[a], sets[b])) == len(plain[a] & plain[b])


def test_groups_equal_all_pairs(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts: dict[int, str | None] = {}
    for base in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 150))]
        for _ in range(rng.randint(1, 8)):
            copy = list(words)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts[len(texts) * 3 + 7] = " ".join(copy) + (f"\n{passage}" if base % 4 == 0 else "")
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for step in range(30):  # each next to the one before, the ends far apart
        chain[3 * step] = f"new{step}"
        texts[1000 + step] = " ".join(chain)
    texts |= {2000 + i: t for i, t in enumerate(ODD)}
    expected = plain_components(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in near_dedup.near_groups(docs).collect()}
    assert {i: r.component_id for i, r in got.items()} == expected
    assert all(got[i].n_shingles == len(plain_set(t)) and got[i].kept == (i == expected[i]) for i, t in texts.items())


@pytest.mark.parametrize(("name", "size"), [("BLOCK", 7), ("BLOCK_SHINGLES", 400)])
def test_blocks_lose_no_link(spark, monkeypatch, name, size):
    monkeypatch.setattr(near_dedup, name, size)
    monkeypatch.setattr(near_dedup, "LEADERS", 1)  # so that pairs of blocks have links left to find
    rng = random.Random(8)
    words = [f"w{k}" for k in range(90)]
    texts = {i: " ".join(f"x{rng.randint(0, 999)}" if rng.random() < 0.03 else w for w in words) for i in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(docs).collect()} == plain_components(texts)


def test_parts_of_a_large_group_are_paired(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    sets = spark.createDataFrame([(n, 1 if n < 60 else 2, 1, bytearray(b"")) for n in range(70)], "node long, root long, n_shingles long, shingles binary")
    # Of group 1 a component of 40 nodes, one of 12 and eight alone; group 2 is one component.
    known = spark.createDataFrame([(n, 0 if n < 40 else 40 if n < 52 else 60) for n in range(70) if n < 52 or n >= 60], "node long, part long")
    met = set()
    for key, rows in __import__("itertools").groupby(sorted(tuple(r) for r in near_dedup._block_pairs(sets, known).select("root", "low", "high", "first", "node").collect()), lambda r: r[:3]):
        rows = list(rows)
        assert key[0] == 1
        both = len({r[3] for r in rows}) == 2
        met |= {frozenset((a[4], b[4])) for a in rows for b in rows if a[4] != b[4] and (a[3] != b[3] or not both)}
    part = lambda n: 0 if n < 40 else 40 if n < 52 else n
    assert {frozenset((a, b)) for a in range(60) for b in range(a) if part(a) != part(b)} <= met
    assert not {frozenset((a, b)) for a in range(40) for b in range(a)} & met


def test_components_of_any_shape(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}


def test_small_graphs_are_walked_in_one_go(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(k * 7919 % 500, (k + 1) * 7919 % 500) for k in range(499)] + [(rng.randint(-900, -1), rng.randint(-900, -1)) for _ in range(500)] + [(1 << 62, 1 << 61)]
    graph = spark.createDataFrame(edges, "a long, b long").repartition(7)
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    found, stages = [], []
    for most in (near_dedup.WALKED_EDGES, 10):
        monkeypatch.setattr(near_dedup, "WALKED_EDGES", most)
        context.setJobGroup(f"components {most}", "")
        found.append(sorted(tuple(r) for r in near_dedup.components(graph).select("node", "root").collect()))
        stages.append(sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(f"components {most}")))
        context.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1] and len(found[0]) > 900
    assert stages[0] * 5 < stages[1]
    empty = near_dedup.components(graph.limit(0))
    assert empty.columns == ["node", "root"] and empty.count() == 0


def test_one_of_each_group_stays(spark, odd, empty):
    kept = near_dedup.keep_one(odd.withColumn("node", F.lit("mine")).withColumn("text_key", F.lit(7)))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9] and "node" in kept.columns
    assert near_dedup.near_groups(empty).count() == 0 and near_dedup.keep_one(empty).count() == 0


def test_rows_without_an_id_are_grouped_too(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (7, text), (9, text), (None, "alone here"), (None, "alone here"), (None, None), (None, " "), (3, None), (3, None), (5, "first text of five"), (5, "second text of the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.near_groups(docs).collect())
    assert got == sorted([("None", "7", False), ("7", "7", True), ("9", "7", False), *[("None", "None", True)] * 4, *[("3", "3", True)] * 2, *[("5", "5", True)] * 2])
    kept = sorted((str(r.doc_id), str(r.text)) for r in near_dedup.keep_one(docs).collect())
    assert kept == sorted([("7", text), ("None", "alone here"), ("None", "None"), ("None", " "), ("3", "None"), ("5", "first text of five"), ("5", "second text of the same id")])


# Bounds of samples ---------------------------------------------------------------------------------------------------------------------


def test_a_doc_id_of_most_rows_does_not_fill_the_language_sample(spark, monkeypatch):
    rows = [(7, f"hot text number {k} of many", "en") for k in range(3000)] + [(7, "the very same text", "en")] * 3000 + [(k, f"der text nummer {k} von vielen", "de") for k in range(100, 1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").filter(~language_id.held_out(F.col("doc_id")))
    seen = []
    monkeypatch.setattr(language_id, "fit_languages", lambda langs, counts, fit=language_id.fit_languages: seen.append([int(n.sum()) for _, n in counts]) or fit(langs, counts))
    model = language_id.train(docs, 200)
    # About 200 texts a language of some 20 characters, a fifth of them for calibration; those of doc_id 7 are chosen one by one.
    assert model.langs == ["de", "en"] or model.langs == ["de"]
    assert all(500 < n < 12_000 for n in seen[0])


def test_models_beyond_their_bound_are_refused(spark, small, monkeypatch):
    monkeypatch.setattr(language_id, "MODEL_BYTES", 1000)
    with pytest.raises(MemoryError):
        language_id.train(spark.read.parquet(f"{small}/documents.parquet"))


def test_the_fit_takes_documents_as_far_as_features_go(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + j) % 50}" for j in range(30))) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    whole, cut, none = (quality.train(docs, labels, fit_features=n) for n in (10**6, 2000, 0))
    assert whole.weights.shape == cut.weights.shape and not none.weights.any()
    assert quality.classify(docs, labels).count() == 200


def test_long_followers_of_one_leader_are_dealt_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 100)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(60):
        own = list(base)
        for _ in range(k % 4):
            own[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(own)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(60), 0)

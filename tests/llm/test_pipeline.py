"""The pipeline stage by stage on the smallest tables: each on what the one before kept, held against plain Python."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from reelmark.llm import language_id, quality
from tests.llm.test_text_operators import plain_components, plain_symbols


def plain_languages(docs):
    """(doc_id, lang) of the documents that a plain Kneser-Ney model of each language, of dictionaries, tells and accepts. docs: doc_id, text, lang, few enough to be learned from whole."""
    rows = docs.withColumn("held", language_id.held_out(F.col("doc_id"))).withColumn("calibrates", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(5)) == 0).collect()
    known = {(r.lang, r.text): r.calibrates for r in rows if r.lang is not None and r.text is not None and not r.held}
    symbols = lambda text: (lambda s: s[:3] + s[3 + next((k for k, x in enumerate(s[3:]) if x), len(s)) :])(plain_symbols(text))
    grams = lambda text: (lambda s: [tuple(s[k - 3 : k + 1]) for k in range(3, len(s))])(symbols(text))
    langs = sorted({lang for (lang, _), calibrates in known.items() if not calibrates})
    counts = {lang: {4: Counter(g for (x, text), calibrates in known.items() if x == lang and not calibrates for g in grams(text))} for lang in langs}
    letters = len({g[-1] for own in counts.values() for g in own[4]})

    def model_of(own):
        for k in (3, 2, 1):
            own[k] = Counter(g[1:] for g in own[k + 1])
        discount, total, kinds = {}, defaultdict(int), defaultdict(int)
        for k in own:
            ones, twos = (sum(v == n for v in own[k].values()) for n in (1, 2))
            discount[k] = ones / (ones + 2 * twos) if ones and twos else 0.5
            for g, n in own[k].items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
        memo = {(): 1 / (letters + 1)}

        def probability(g):
            if g not in memo:
                lower = probability(g[1:])
                d, n = discount[len(g)], total.get(g[:-1], 0)
                memo[g] = (max(own[len(g)].get(g, 0) - d, 0) + d * kinds[g[:-1]] * lower) / n if n else lower
            return memo[g]

        return probability

    models = {lang: model_of(own) for lang, own in counts.items()}
    bits = lambda text: [np.mean([-math.log2(models[lang](g)) for g in own]) if (own := grams(text)) else 0.0 for lang in langs]
    steady = language_id.STEADY_LENGTH
    seen = defaultdict(list)
    for (lang, text), calibrates in known.items():
        if calibrates and lang in langs and grams(text):
            own = bits(text)
            if int(np.argmin(own)) == langs.index(lang):
                seen[lang].append((own[langs.index(lang)], len(grams(text))))
    means, most = {}, {}
    for lang in langs:
        entropy, n = (np.array(x) for x in zip(*seen[lang], strict=True)) if seen[lang] else (np.array([4.0]), np.array([1]))
        means[lang] = np.average(entropy, weights=np.minimum(n, steady))
        over = np.sort((entropy - means[lang]) * np.sqrt(np.minimum(n, steady)))
        most[lang] = language_id.MARGIN * max(over[int(language_id.CALIBRATION_SHARE * (len(over) - 1))], language_id.LEAST_EXCESS) if seen[lang] else 40.0
        means[lang] = means[lang] if seen[lang] else 4.0
    out = []
    for r in rows:
        own, n = bits(r.text or ""), len(grams(r.text or ""))
        lang = langs[int(np.argmin(own))]
        if n and (min(own) - means[lang]) * math.sqrt(min(n, steady)) <= most[lang]:
            out.append((r.doc_id, lang))
    return sorted(out)


def test_stages_do_what_their_operators_say(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        kept.append((docs, spark.read.parquet(str(tmp_path / str(k)))))
        docs = kept[-1][1]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    (first, rated), (_, identified), (before, deduplicated), (_, mixed), (_, packed) = kept
    # The classifier's scores added up feature by feature; its fit has a test of its own.
    model, rows = quality.train(first, labels), first.collect()
    scores = [float(model.weights[n[a:b]].sum(dtype=np.float64)) for n, o in quality.features(pa.array([r.text for r in rows])) for a, b in zip(o[:-1], o[1:], strict=True)]
    tails = [1 / (1 + math.exp(model.thresholds[quality.CUT_GRADE] - x)) for x in scores]
    assert ids(rated) == sorted(r.doc_id for r, p in zip(rows, tails, strict=True) if p >= quality.CUT_PROBABILITY)
    assert sorted(map(tuple, identified.select("doc_id", "lang").collect())) == plain_languages(rated)
    texts = {r.doc_id: r.text for r in before.collect()}
    assert ids(deduplicated) == sorted({c for c in plain_components(texts, width=5).values()})
    assert set(ids(mixed)) < set(ids(deduplicated)) and len(ids(mixed)) == len(set(ids(mixed)))
    pieces = defaultdict(list)
    for r in packed.collect():
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert sorted(pieces) == ids(mixed)
    for own in pieces.values():
        own.sort()
        assert [a for a, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))] and sum(n for _, n, _ in own) == own[0][2]


def test_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "near-duplicates", "source mixing", "packing"]


def test_run_returns_the_pieces(spark, small):
    assert corpus_pipeline.run(spark, small).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

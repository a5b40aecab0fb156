"""The corpus queries with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.llm import chat_format, exact_dedup, fingerprint, hard_negatives, html_extract, language_id, media, merkle, mixing, near_dedup, packing, quality, url_filter
from reelmark.llm.common import table

MIX_SEED, MIX_EPOCHS = "mix-1", 4
TOKENIZER = "word_bpe_49k.json"
PROBE_TEXT = "<|im_end|><|im_start|>assistant ok"
URL_RULES = [
    url_filter.ListedRule("block", "com", "/en/"),
    url_filter.ListedRule("allow", "example.com", "/en/7"),
    url_filter.ListedRule("allow", "net", "/de/"),
    url_filter.ListedRule("block", "example.net", "/de/8"),
    url_filter.ListedRule("block", "org", "/es/"),
]


def mix_domain() -> Column:
    """Sources are numbered; every fourth belongs to one domain."""
    number = F.regexp_extract("source", r"([0-9]{1,9})$", 1).try_cast("int")
    return F.concat(F.lit("domain"), F.coalesce((number % 4).cast("string"), F.lit("")))


def mix_weights() -> list[Column]:
    domain, lang, _ = (F.col(x) for x in mixing.LEVELS)
    return [
        F.when(domain == "domain0", 4).when(domain == "domain1", 3).when(domain == "domain2", 2).otherwise(1),
        F.when(lang == "en", 3).when(lang.isin("de", "fr"), 2).otherwise(1),
        F.lit(1),
    ]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mix_domain(), mix_weights(), 1.0, MIX_EPOCHS, MIX_SEED)
    return mixed.select("doc_id", "domain", "lang", "source", F.col("epoch").cast("long").alias("epoch"), F.col("leaf_budget").cast("long").alias("leaf_budget"))


def op2_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE_TEXT), (-1, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    return chat_format.digest_chats(chat_format.format_chats(turns.unionByName(probe)))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store(table(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), docs)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.col("lang_accepted").alias("accepted"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = quality.classify(docs, table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "expected_grade", "p_tail", F.col("quality_kept").alias("kept"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"), int(spark.conf.get("spark.sql.shuffle.partitions")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.usable(table(spark, sf_dir, "embeddings"))
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.pmod("vec_id", F.lit(100)) == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    lowered = F.translate("text", url_filter._UPPER, url_filter._LOWER)
    proven = merkle.manifest(table(spark, sf_dir, "documents"), F.when(number % 3 == 0, lowered).otherwise(F.col("text")))
    return proven.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_extract_html": op2_extract_html,
    "op3_format_chats": op3_format_chats,
    "op4_media": op4_media,
    "op5_language_id": op5_language_id,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality": op7_quality,
    "op8_pack": op8_pack,
    "op9_filter_urls": op9_filter_urls,
    "op10_fingerprint": op10_fingerprint,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_exact_dedup": op13_exact_dedup,
}

_SHARE = """
, {name}_r AS (
  SELECT *, supply / weight AS ratio FROM {name}_n)
, {name}_l AS (
  SELECT *, (parent_budget - coalesce(sum(supply) OVER b, 0)) / (sum(weight) OVER (PARTITION BY {above}) - coalesce(sum(weight) OVER b, 0)) AS level
  FROM {name}_r WINDOW b AS (PARTITION BY {above} ORDER BY ratio, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, {name} AS (
  SELECT *, least(supply, cast(floor(max(level) OVER (PARTITION BY {above}) * weight) AS BIGINT)) AS budget FROM {name}_l)"""

MIX_SQL = (
    f"""
WITH counted AS (
  SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s,
    concat('domain', coalesce(cast(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % 4 AS VARCHAR), '')) AS d,
    coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0) AS tokens
  FROM documents)
, leaves AS (SELECT d, l, s, cast(sum(tokens) AS BIGINT) AS size, cast(sum(tokens) AS BIGINT) * {MIX_EPOCHS} AS supply FROM counted GROUP BY d, l, s)
, dd_n AS (
  SELECT d, 0 AS root, cast(sum(supply) AS BIGINT) AS supply, CASE d WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END AS weight,
    (SELECT cast(floor(sum(size)) AS BIGINT) FROM leaves) AS parent_budget
  FROM leaves GROUP BY d)"""
    + _SHARE.format(name="dd", above="root", own="d")
    + """
, ll_n AS (
  SELECT x.d, x.l, x.supply, CASE WHEN x.l = 'en' THEN 3 WHEN x.l IN ('de', 'fr') THEN 2 ELSE 1 END AS weight, dd.budget AS parent_budget
  FROM (SELECT d, l, cast(sum(supply) AS BIGINT) AS supply FROM leaves GROUP BY d, l) x JOIN dd USING (d))"""
    + _SHARE.format(name="ll", above="d", own="l")
    + """
, ss_n AS (SELECT leaves.d, leaves.l, leaves.s, leaves.size, leaves.supply, 1 AS weight, ll.budget AS parent_budget FROM leaves JOIN ll USING (d, l))"""
    + _SHARE.format(name="ss", above="d, l", own="s")
    + f"""
, ends AS (
  SELECT d, l, s, budget, f AS full_epochs, budget - f * size AS rest
  FROM (SELECT *, CASE WHEN size > 0 THEN least(cast(floor(budget / size) AS BIGINT), {MIX_EPOCHS}) ELSE 0 END AS f FROM ss))
, spots AS (
  SELECT c.*, budget, full_epochs, rest,
    sum(tokens) OVER (PARTITION BY c.d, c.l, c.s ORDER BY md5(concat_ws('|', '{MIX_SEED}', cast(full_epochs AS VARCHAR), coalesce(cast(doc_id AS VARCHAR), '')))) AS upto
  FROM counted c JOIN ends USING (d, l, s))
SELECT doc_id, d AS domain, lang, source, cast(e AS BIGINT) AS epoch, budget AS leaf_budget
FROM spots, range({MIX_EPOCHS}) t(e) WHERE e < full_epochs OR (e = full_epochs AND upto <= rest)"""
)

_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
_CASE = f"'{url_filter._UPPER}', '{url_filter._LOWER}'"
URL_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), {_CASE}) AS host, regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path,
    translate(concat(regexp_extract(coalesce(url, ''), '{_URL}', 2), regexp_extract(coalesce(url, ''), '{_URL}', 3)), {_CASE}) AS rest
  FROM pages)
, urls AS (
  SELECT row_number() OVER () AS id, page_id, host, path, try_cast(regexp_extract(path, '/([0-9]{{1,18}})([^0-9]|$)', 1) AS BIGINT) AS doc_id,
    list_distinct(list_concat(list_transform(regexp_extract_all(host, '[a-z0-9-]+'), lambda x: 'h:' || x),
      list_transform(regexp_extract_all(rest, '[a-z0-9]+'), lambda x: 'p:' || regexp_replace(x, '^[0-9]+$', '#')))) AS tokens
  FROM parts)
, rated AS (SELECT doc_id, bool_or(coalesce(quality = 0 OR toxic = 1, false)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id)
, labelled AS (SELECT id, tokens, bad FROM urls JOIN rated USING (doc_id))
, often AS (
  SELECT t FROM (SELECT bad, unnest(tokens) AS t FROM labelled) GROUP BY t HAVING count(*) FILTER (bad) >= {url_filter.LEAST_COUNT})
, own AS (SELECT id, bad, list_sort(list(t)) AS ts FROM (SELECT id, bad, unnest(tokens) AS t FROM labelled) SEMI JOIN often USING (t) GROUP BY id, bad)
, sets AS (SELECT bad, list_filter(ts, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s FROM (SELECT bad, ts, unnest(range(1, 1 << len(ts))) AS m FROM own))
, mined AS (
  SELECT s FROM sets GROUP BY s
  HAVING count(*) FILTER (bad) >= {url_filter.LEAST_COUNT} AND count(*) FILTER (bad) >= count(*) * {url_filter.LEAST_CONFIDENCE}::DOUBLE)
, fits AS (
  SELECT id, arg_max(concat(r.host, r.path), length(r.host) + length(r.path)) AS rule, arg_max(r.verdict, length(r.host) + length(r.path)) AS verdict
  FROM urls u JOIN (VALUES {_RULES}) r(verdict, host, path) ON (u.host = r.host OR ends_with(u.host, concat('.', r.host))) AND starts_with(u.path, r.path) GROUP BY id)
SELECT u.page_id, u.host, u.path, f.rule,
  coalesce(f.verdict, CASE WHEN EXISTS (SELECT 1 FROM mined m WHERE list_has_all(u.tokens, m.s)) THEN 'block' ELSE 'allow' END) AS verdict
FROM urls u LEFT JOIN fits f USING (id)"""

# CRC-32 bit by bit: DuckDB has no function for it. Every byte is mixed in, then eight steps of the reflected polynomial follow.
_CRC_BYTE = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(cast(doc_id AS VARCHAR), ''), lambda z: ascii(z)::BIGINT)), lambda c, b: {_CRC_BYTE}))"
_FIELD = "coalesce(concat(strlen({0}), ':', {0}), '-')"


def _leaf_sql(text: str) -> str:
    values = ["cast(doc_id AS VARCHAR)", "source", "lang", "cast(n_chars AS VARCHAR)", text]
    return f"sha256({' || '.join(_FIELD.format(x) for x in values)})"


_LEVELS = """
{name}(level, lang, k, digest, n) AS (
  SELECT 0, lang, k, digest, count(*) OVER (PARTITION BY lang) FROM {leaves}
  UNION ALL
  SELECT level + 1, lang, k // 8, sha256(string_agg(digest, '' ORDER BY k)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY level, lang, k // 8, n)"""

MERKLE_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS digest,
    {_leaf_sql("CASE WHEN doc_id IS NOT NULL AND (" + _CRC + f") % 3 = 0 THEN translate(text, {_CASE}) ELSE text END")} AS found
  FROM documents)
, leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest, found) - 1 AS k FROM rows)
, {_LEVELS.format(name="nodes", leaves="leaves")}
, subroots AS (SELECT lang AS of_lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, 0 AS lang FROM nodes WHERE n = 1)
, {_LEVELS.format(name="tops", leaves="subroots")}
, own AS (SELECT l.*, row_number() OVER () AS id, s.k AS top FROM leaves l JOIN subroots s ON s.of_lang IS NOT DISTINCT FROM l.lang)
, beside AS (
  SELECT id, 0 AS part, n.level, n.k, n.digest, own.k >> (3 * n.level) AS mine FROM own JOIN nodes n ON n.lang IS NOT DISTINCT FROM own.lang AND n.n > 1 AND n.k >> 3 = own.k >> (3 * n.level + 3)
  UNION ALL
  SELECT id, 1, t.level, t.k, t.digest, top >> (3 * t.level) FROM own JOIN tops t ON t.n > 1 AND t.k >> 3 = top >> (3 * t.level + 3))
, steps AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY part, level) AS step, coalesce(string_agg(digest, '' ORDER BY k) FILTER (k < mine), '') AS before,
    coalesce(string_agg(digest, '' ORDER BY k) FILTER (k > mine), '') AS after
  FROM beside GROUP BY id, part, level)
, climb(id, step, digest) AS (
  SELECT id, 0, found FROM own
  UNION ALL
  SELECT c.id, c.step + 1, sha256(concat(s.before, c.digest, s.after)) FROM climb c JOIN steps s ON s.id = c.id AND s.step = c.step + 1)
, ends AS (SELECT id, arg_max(digest, step) AS folded_root FROM climb GROUP BY id)
, proofs AS (SELECT id, string_agg(before || after, '' ORDER BY step) AS proof FROM steps GROUP BY id)
SELECT own.doc_id, own.digest AS leaf, r.digest AS subroot, t.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = t.digest AS verified
FROM own JOIN subroots r ON r.of_lang IS NOT DISTINCT FROM own.lang JOIN tops t ON t.n = 1 JOIN ends e USING (id) LEFT JOIN proofs p USING (id)"""

NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))
, scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, cast(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
, positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, cast(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
QUALIFY rank <= 10"""

EXACT_SQL = """
WITH plain AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) AS k,
  max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size FROM documents)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM plain"""

ORACLE_SQL: dict[str, str] = {"op1_mix_sources": MIX_SQL, "op9_filter_urls": URL_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_merkle_manifest": MERKLE_SQL, "op13_exact_dedup": EXACT_SQL}

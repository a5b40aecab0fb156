"""URL filtering by association rules.

Labelled URLs become sets of tokens (labels of the host, pieces of the rest, numbers as '#'). Tokens that stand in just the same labelled
URLs are one item, so what a site's URLs all share costs one item however many tokens it has. Spark's FP-growth mines the items of the bad
URLs; combinations of any length that reach the least count and, over all labelled URLs, the least confidence become rules, but for those
that hold another rule. A rule is filed in an inverted index under its rarest item; a URL is blocked if it holds all items of a rule found
under one of its own, where any token of an item stands for it: each would make a rule of the same figures. Listed rules (host and path)
come first: the longest that fits the host or a parent domain and starts the path decides.

Matching runs on distinct URLs, so a URL that fills a third of the table costs one row, and joins rather than broadcasts the rules.

Defined cases: ratings of no page are ignored; a null URL, or one without '://', has empty host and path and no tokens, fits no listed rule and is allowed; a document
rated twice counts as bad if one rating is; with fewer than LEAST_COUNT bad URLs there are no mined rules; repeated rows get equal verdicts; an empty
table gives an empty result. Native operations and MLlib only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.llm.common import stored

#: Bad URLs that a rule must cover, whatever the size of the table, and their least part of all labelled URLs it covers.
LEAST_COUNT, LEAST_CONFIDENCE = 20, 0.6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


@dataclass(frozen=True)
class ListedRule:
    verdict: str
    host: str
    path: str


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _SPLIT, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def label_key(url: Column) -> Column:
    """The first number in the path that is a piece of it: the document that the page shows."""
    return F.regexp_extract(url_path(url), "/([0-9]{1,18})([^0-9]|$)", 1).try_cast("long")


def url_tokens(url: Column) -> Column:
    """Distinct tokens: 'h:' and a label of the host, 'p:' and a piece of what follows it, in lower case."""
    rest = F.translate(F.concat(F.regexp_extract(url, _SPLIT, 2), F.regexp_extract(url, _SPLIT, 3)), _UPPER, _LOWER)
    hosts = F.transform(F.regexp_extract_all(url_host(url), F.lit("[a-z0-9-]+"), F.lit(0)), lambda x: F.concat(F.lit("h:"), x))
    pieces = F.transform(F.regexp_extract_all(rest, F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "^[0-9]+$", "#")))
    return F.coalesce(F.array_distinct(F.concat(hosts, pieces)), F.array().cast("array<string>"))


def token_items(labelled: DataFrame, least_count: int) -> DataFrame:
    """(token, item, n) for tokens of enough bad URLs: item names all tokens that stand in the same URLs, n of them. labelled: id, tokens, bad."""
    each = labelled.select("id", "bad", F.explode("tokens").alias("token"))
    where = [F.bit_xor(F.xxhash64(F.lit(k), F.col("id"))).alias(f"where{k}") for k in range(2)]
    found = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), *where).filter(F.col("bad") >= least_count)
    same = ["n", "bad", "where0", "where1"]
    return found.join(found.groupBy(*same).agg(F.min("token").alias("item")), same).select("token", "item", "n")


def _items_of(rows: DataFrame, key: str, tokens: str, items: DataFrame) -> DataFrame:
    """(key, items): the distinct items of each row that has any."""
    each = rows.select(key, F.explode(tokens).alias("token")).join(items.select("token", "item"), "token")
    return each.groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("items"))


def mine(labelled: DataFrame, items: DataFrame, least_count: int = LEAST_COUNT, confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(index_item, items, bad, total) of the rules to block, none of which holds another. labelled: id, tokens and bad, a row for each labelled URL; items: see token_items()."""
    spark = labelled.sparkSession
    baskets = stored(_items_of(labelled, "id", "tokens", items).join(labelled.select("id", "bad"), "id"))
    wrong = baskets.filter("bad").select("items")
    n = wrong.count()
    if n < least_count:
        return spark.createDataFrame([], "index_item string, items array<string>, bad long, total long")
    # Half a row less, so that rounding can't ask for one more.
    found = FPGrowth(itemsCol="items", minSupport=(least_count - 0.5) / n).fit(wrong).freqItemsets
    candidates = stored(found.select(F.array_sort("items").alias("items"), F.col("freq").alias("bad")))
    counts = items.select("item", "n").distinct()
    rarest = candidates.select("items", F.explode("items").alias("item")).join(counts, "item").groupBy("items").agg(F.min_by("item", F.struct("n", "item")).alias("index_item"))
    filed = candidates.join(rarest, "items")
    holders = baskets.select(F.col("items").alias("own"), F.explode("items").alias("index_item"))
    held = filed.join(holders, "index_item").filter(F.size(F.array_except("items", "own")) == 0)
    totals = held.groupBy("index_item", "items", "bad").agg(F.count("*").alias("total"))
    rules = stored(totals.filter(F.col("bad") >= F.col("total") * F.lit(confidence)))
    shorter = rules.select(F.col("index_item").alias("item"), F.col("items").alias("part"))
    longer = rules.select("items", F.explode("items").alias("item")).join(shorter, "item").filter((F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0))
    return rules.join(longer.select("items").distinct(), "items", "left_anti").select("index_item", "items", "bad", "total")


def listed(urls: DataFrame, rules: list[ListedRule]) -> DataFrame:
    """Adds rule and rule_verdict, null where no listed rule fits. urls: url, host, path."""
    spark = urls.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "rule_host string, rule_path string, rule_verdict string")
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = urls.select("url", "path", F.explode(suffixes).alias("rule_host")).join(table, "rule_host").filter(F.expr("startswith(path, rule_path)"))
    rule = F.concat("rule_host", "rule_path")
    best = fits.groupBy("url").agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), "rule_verdict")).alias("best"))
    return urls.join(best.select("url", "best.rule", "best.rule_verdict"), "url", "left")


def judge(pages: DataFrame, labels: DataFrame, rules: list[ListedRule]) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages; labels rate the document whose number is the first in the URL's path."""
    keyed = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    rated = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    labelled = keyed.withColumn("doc_id", label_key(F.col("url"))).join(rated, "doc_id").select(F.monotonically_increasing_id().alias("id"), url_tokens(F.col("url")).alias("tokens"), "bad")
    labelled = stored(labelled)
    items = stored(token_items(labelled, LEAST_COUNT))
    rules_mined = stored(mine(labelled, items))
    urls = keyed.select("url").distinct().select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), url_tokens(F.col("url")).alias("url_tokens"))
    own = _items_of(urls, "url", "url_tokens", items).select("url", F.col("items").alias("own"))
    hits = own.select("url", "own", F.explode("own").alias("index_item")).join(rules_mined, "index_item")
    blocked = hits.filter(F.size(F.array_except("items", "own")) == 0).select("url").distinct().withColumn("mined", F.lit("block"))
    judged = listed(urls.drop("url_tokens"), rules).join(blocked, "url", "left")
    verdict = F.coalesce("rule_verdict", "mined", F.lit("allow"))
    return keyed.join(judged.select("url", "host", "path", "rule", verdict.alias("verdict")), "url").select("page_id", "host", "path", "rule", "verdict")

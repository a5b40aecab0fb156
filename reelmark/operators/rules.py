"""Ordered rules: the first whose enabled tests all hold decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (
    "rule_set string, seq int, tag_enabled boolean, tag string, file_name_enabled boolean, file_name string, content_enabled boolean, contents array<struct<space:int,level1:int,level2:int>>, "
    "service_enabled boolean, service_ids array<int>, size_enabled boolean, sizes array<string>, profile string, priority int"
)
AUTO_PREFIX = "自動選択_"


def size_bucket(width: Column) -> Column:
    return F.when(width > 1440, "FullHD").when(width > 720, "HD1440").when(width > 320, "SD").otherwise("OneSeg")


def genre_matches(genres: Column, wanted: Column) -> Column:
    """The first genre is one of those wanted; -1 stands for any second level, the space isn't looked at."""
    own = F.try_element_at(genres, F.lit(1))
    hit = F.exists(wanted, lambda w: (w["level1"] == own["level1"]) & ((w["level2"] == -1) | (w["level2"] == own["level2"])))
    return F.coalesce((F.size(genres) > 0) & hit, F.lit(False))


def rule_lists(rules: DataFrame) -> DataFrame:
    """(rule_set, rule_list): the rules of each set in their order. Sets are what people write and read, so a list fits in a row."""
    rest = [c for c in rules.columns if c not in ("rule_set", "seq")]
    return rules.groupBy("rule_set").agg(F.array_sort(F.collect_list(F.struct("seq", *rest))).alias("rule_list"))


def first_rule(rule_list: Column, item: dict[str, Column]) -> Column:
    """The first rule of a list whose enabled tests all hold for an item; null if none does or there is no list."""

    def passes(rule: Column) -> Column:
        test = lambda enabled, holds: ~rule[enabled] | F.coalesce(holds, F.lit(False))
        return (
            test("tag_enabled", F.array_contains(item["tags"], rule["tag"]))
            & test("file_name_enabled", F.contains(item["file_name"], rule["file_name"]))
            & test("content_enabled", genre_matches(item["genres"], rule["contents"]))
            & test("service_enabled", F.array_contains(rule["service_ids"], item["service_id"]))
            & test("size_enabled", F.array_contains(rule["sizes"], size_bucket(item["width"])))
        )

    return F.get(F.filter(rule_list, passes), 0)


def assign(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds profile and priority of the first rule of the item's rule_set that holds, null and 0 if none does, and known_set, whether there is such a set.

    items: rule_set, tags, file_name, genres, service_id, width. Each set is one row, joined to its items; an item then goes through its own
    set's rules in order, so items are neither multiplied nor grouped.
    """
    listed = items.join(rule_lists(rules), "rule_set", "left")
    hit = first_rule(F.col("rule_list"), {c: F.col(c) for c in ("tags", "file_name", "genres", "service_id", "width")})
    found = listed.withColumn("hit", hit)
    return found.select(*items.columns, F.col("hit.profile").alias("profile"), F.coalesce("hit.priority", F.lit(0)).alias("priority"), F.col("rule_list").isNotNull().alias("known_set"))


def resolve(items: DataFrame, rules: DataFrame, profiles: DataFrame) -> DataFrame:
    """items: requested and the columns of assign() but rule_set. Adds profile, priority and fail_reason.

    A requested name with the prefix of automatic choice goes through the rule set named after it, others are profiles. Names of rule sets and
    profiles are compared without regard to case. Missing set, no rule that holds and missing profile are told apart.
    """
    auto = F.startswith("requested", F.lit(AUTO_PREFIX))
    routed = items.withColumn("is_auto", auto).withColumn("rule_set", F.lower(F.when(auto, F.expr(f"substring(requested, {len(AUTO_PREFIX) + 1})"))))
    lowered = rules.withColumn("rule_set", F.lower("rule_set"))
    chosen = assign(routed, lowered)
    name = F.when(F.col("is_auto"), F.col("profile")).otherwise(F.col("requested"))
    named = chosen.withColumn("name", F.lower(name))
    found = named.join(profiles.select(F.lower("profile_name").alias("found"), F.col("profile_name")), F.col("name") == F.col("found"), "left")
    reason = (
        F.when(F.col("is_auto") & ~F.col("known_set"), "no such rule set")
        .when(F.col("is_auto") & F.col("profile").isNull(), "no rule holds")
        .when(F.col("found").isNull(), "no such profile")
        .otherwise("")
    )
    return found.select(*[items[c] for c in items.columns], F.col("profile_name").alias("profile"), "priority", reason.alias("fail_reason"))

"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of domain, language and source. At each node it is shared among the children by weight; a child takes
at most what it can supply (its tokens times the epochs allowed). What one can't take goes to its siblings by weight, and only what all
of them can't take goes up, to the siblings of their parent: a node's supply is the sum of its children's, so sharing at each level from
the top with supplies as ceilings does just that. Each leaf then takes documents in the order of a seeded hash, epoch after epoch, up to
the first document that would pass its budget: whole epochs first, then a prefix of the next.

A leaf's prefix is found without gathering the leaf: documents fall into 4096 ranges of the hash; sums over ranges tell which are taken
whole, and only the one range in which the budget ends is put in order row by row.

Defined cases: null domain, language or source counts as ''; text without tokens weighs nothing and is taken or left with its place;
rows of equal doc_id stand in equal places and are taken or left together; a budget above the supply takes every document in every
epoch; an empty table gives an empty result; columns of the input named like the added ones are replaced. Native operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmark.llm.common import stored

#: Hex digits of the hash that name a range: 16^3 = 4096 ranges a leaf.
RANGE_DIGITS = 3
LEVELS = ["mix_domain", "mix_lang", "mix_source"]
#: Columns of the result; the input's columns of these names are replaced.
ADDED = ["domain", "epoch", "leaf_budget"]
#: A plan of more leaves than this is joined by shuffling, not broadcast.
BROADCAST_LEAVES = 50_000


def token_count(text: Column) -> Column:
    """Stretches of characters other than blank and the control characters 9 to 13."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def place(seed: str, epoch: Column, doc_id: Column) -> Column:
    """Where a document stands in an epoch's order: 32 hex digits."""
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def share(children: DataFrame, parents: list[str]) -> DataFrame:
    """Splits parent_budget among the rows of one parent by weight, each at most its supply; adds budget.

    In the order of supply per weight, `level` is what a unit of weight would get once the rows before are full. It rises as long as
    rows fill up and falls after that, so its highest value is the common level of those that don't.
    """
    by = Window.partitionBy(*parents).orderBy("ratio", children.columns[len(parents)]).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parents)
    ranked = children.withColumn("ratio", F.col("supply") / F.col("weight")).withColumn(
        "level",
        (F.col("parent_budget") - F.coalesce(F.sum("supply").over(by), F.lit(0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by), F.lit(0))),
    )
    return ranked.withColumn("budget", F.least(F.col("supply"), F.floor(F.max("level").over(whole) * F.col("weight")).cast("long")))


def plan(leaves: DataFrame, budget_share: float, weights: list[Column]) -> DataFrame:
    """Adds budget to leaves (the three levels, size, supply). weights: a positive whole number for each level."""
    budgets = leaves.agg(F.floor(F.sum("size") * F.lit(float(budget_share))).cast("long").alias("parent_budget"))
    for depth, weight in enumerate(weights):
        path = LEVELS[: depth + 1]
        nodes = leaves.groupBy(*path).agg(F.sum("supply").alias("supply")).withColumn("weight", weight.cast("long"))
        nodes = nodes.join(budgets, path[:-1]) if depth else nodes.crossJoin(F.broadcast(budgets)).select(F.lit(0).alias("root"), "*")
        budgets = share(nodes, path[:-1] or ["root"]).select(*path, F.col("budget").alias("parent_budget"))
    return leaves.join(budgets.withColumnRenamed("parent_budget", "budget"), LEVELS)


def mix(docs: DataFrame, domain: Column, weights: list[Column], budget_share: float, epochs: int, seed: str) -> DataFrame:
    """The chosen documents, once for each epoch that takes them: all columns, then domain, epoch and leaf_budget.

    budget_share: the budget as a part of all tokens; weights: for the levels mix_domain, mix_lang and mix_source, see plan().
    """
    leaf_of = [F.coalesce(x.cast("string"), F.lit("")).alias(name) for x, name in zip((domain, F.col("lang"), F.col("source")), LEVELS, strict=True)]
    counted = stored(docs.select("doc_id", *leaf_of, token_count(F.col("text")).alias("tokens")))
    sizes = counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("size")).withColumn("supply", F.col("size") * epochs)
    full = F.when(F.col("size") > 0, F.least(F.floor(F.col("budget") / F.col("size")), F.lit(epochs))).otherwise(0).cast("int")
    leaves = stored(plan(sizes, budget_share, weights).withColumn("full", full).withColumn("rest", F.col("budget") - F.col("full") * F.col("size")))
    few = leaves.count() <= BROADCAST_LEAVES
    hinted = F.broadcast if few else (lambda df: df)

    spot = place(seed, F.col("full"), F.col("doc_id"))
    spots = counted.join(hinted(leaves), LEVELS).select(*LEVELS, "rest", "tokens", spot.alias("spot"), F.substring(spot, 1, RANGE_DIGITS).alias("range"))
    in_order = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = spots.groupBy(*LEVELS, "range", "rest").agg(F.sum("tokens").alias("tokens")).withColumn("upto", F.sum("tokens").over(in_order))
    last_range = ranges.filter("upto > rest").groupBy(*LEVELS).agg(F.min("range").alias("last_range"), F.min_by(F.col("upto") - F.col("tokens"), "range").alias("before"))
    # Equal places are summed together, as the default frame of an ordered window does.
    ending = spots.join(hinted(last_range), LEVELS).filter("range = last_range")
    ending = ending.withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("spot")))
    last_spot = ending.filter("upto <= rest").groupBy(*LEVELS).agg(F.max("spot").alias("last_spot"))
    ends = leaves.select(*LEVELS, F.col("budget").alias("leaf_budget"), "full").join(last_range.drop("before"), LEVELS, "left").join(last_spot, LEVELS, "left")
    ends = stored(ends)

    # The input's columns travel as one, so that none of theirs meets a name used here.
    own = [c for c in docs.columns if c.lower() not in ADDED]
    placed = docs.select(F.struct(*[docs[c] for c in own]).alias("row"), "doc_id", *leaf_of).join(hinted(ends), LEVELS)
    start = F.substring(spot, 1, RANGE_DIGITS)
    in_prefix = F.col("last_range").isNull() | (start < F.col("last_range")) | ((start == F.col("last_range")) & F.coalesce(spot <= F.col("last_spot"), F.lit(False)))
    taken = F.filter(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: (e < F.col("full")) | ((e == F.col("full")) & in_prefix))
    return placed.select("row", F.col(LEVELS[0]).alias("domain"), F.explode(taken).alias("epoch"), "leaf_budget").select(*[F.col("row")[c].alias(c) for c in own], *ADDED)

"""Queries whose answer depends on one order of a whole table: a queue and its numbers, a log as it is exported, cache names, lists side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.functions import names, times
from reelmark.operators import catalogue, ranks, scheduling
from reelmark.plans.catalogue import _JOBS, _SHOWN, _jobs
from reelmark.sources.storage import stored
from reelmark.sources.tables import table

#: Slots of the cache in the query: few, so that many names collide.
CACHE_BITS = 11


def queue_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs as one saved queue, in the order of their recordings, taken up again: numbered from 1, waiting and running ones start over."""
    jobs = _jobs(spark, sf_dir).select("id", "state", "start", "seconds", "ts_time")
    return catalogue.taken_up(jobs, [F.col("ts_time"), F.col("id")]).select("id", "number", "state", "start", "seconds")


def queue_cleared_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places, from 0 on, of what stays in one queue of all jobs after it was cleared."""
    stays = _jobs(spark, sf_dir).filter(~catalogue.is_cleared(F.col("state"))).select("id", "state", "ts_time")
    return ranks.numbered(stays, [F.col("ts_time"), F.col("id")], "position").select("id", "state", "position")


def queue_move_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One queue of all jobs by id after the 100th of them was moved to place 7; a move beyond the end is refused."""
    queue = ranks.numbered(_jobs(spark, sf_dir).select("id"), [F.col("id")], "position")
    item = queue.filter("position = 99").first()["id"]
    return scheduling.moved_whole(scheduling.moved_whole(queue, "id", item, 7), "id", item, 1 << 40)


def cache_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name for each script, the same for equal scripts. Parts' descriptions are scripts; their codes are cut to a few bits so that they collide."""
    scripts = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_brand", F.col("p_size").cast("string")).alias("script"))
    homes = scripts.distinct().withColumn("home", names.folded_md5(F.col("script")).bitwiseAND(F.lit((1 << CACHE_BITS) - 1)))
    named = ranks.probed(homes, "home", [F.col("script")], "slot")
    return scripts.join(named, "script").groupBy("script").agg(F.first("home").alias("home"), F.first("slot").alias("slot"), F.lpad(F.hex(F.first("slot")), 8, "0").alias("name"), F.count("*").alias("uses"))


def cache_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name for each script where a cache holds the scripts of some parts already: those keep theirs, the others find free ones around them."""
    parts = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_brand", F.col("p_size").cast("string")).alias("script"), (F.col("p_size") % 3 == 0).alias("held"))
    scripts = parts.groupBy("script").agg(F.bool_or("held").alias("held")).withColumn("home", names.folded_md5(F.col("script")).bitwiseAND(F.lit((1 << CACHE_BITS) - 1)))
    scripts = stored(scripts)
    held = stored(ranks.probed(scripts.filter("held"), "home", [F.col("script")], "slot"))
    added = ranks.probed_beside(scripts.filter("not held"), "home", [F.col("script")], "slot", held, "slot")
    return held.unionByName(added).select("script", "held", "home", "slot")


def lists_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a list shows at each place beside what now belongs there: customers by key beside orders by time, as far as the shorter goes."""
    shown = table(spark, sf_dir, "customer").select("c_custkey")
    model = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return ranks.zipped(shown, model, [F.col("c_custkey")], [F.col("o_orderdate"), F.col("o_orderkey")]).select("position", "c_custkey", "o_orderkey")


def log_export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that each finished job has in an exported log, the newest first, below a header."""
    log = _jobs(spark, sf_dir).filter("start is not null").select("id", "start")
    lines = ranks.numbered(log, [F.col("start").desc(), F.col("id").desc()], "before")
    return lines.select("id", "start", (F.col("before") + 2).alias("line"))


def active_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workers that a list shows: the first so many, and all up to the last that runs. Suppliers are workers, those of a high balance run."""
    workers = ranks.numbered(table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") > 9000).alias("running")), [F.col("s_suppkey")], "place")
    return scheduling.shown_workers(workers, "running", "place", 4).select("s_suppkey", "running", "place")


def written_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of events as each kind of text, and the digest of their digits as bytes."""
    events = table(spark, sf_dir, "events").filter("ts is not null").select("event_id", *[times.written(F.col("ts"), kind).alias(kind) for kind in times.FORMATS])
    return events.withColumn("digits", F.md5(names.from_hex(F.col("number"))))


QUERIES = {f.__name__: f for f in (written_times, queue_renumbered, queue_cleared_order, queue_move_whole, cache_slots, cache_additions, lists_side_by_side, log_export_order, active_workers)}

_WORD = lambda k: f"('0x' || h[{k + 7}:{k + 8}] || h[{k + 5}:{k + 6}] || h[{k + 3}:{k + 4}] || h[{k + 1}:{k + 2}])::BIGINT"
_FOLDED = f"xor(xor({_WORD(0)}, {_WORD(8)}), xor({_WORD(16)}, {_WORD(24)}))"
ORACLE_SQL = {
    "written_times": """SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS list, strftime(ts, '%Y%m%d%H%M') AS number, concat(strftime(ts, '%Y-%m-%d_%H%M%S.'), lpad(cast(microsecond(ts) // 1000 % 1000 AS VARCHAR), 3, '0')) AS log,
  strftime(ts, '%Y年%m月%d日') AS day, md5(unhex(strftime(ts, '%Y%m%d%H%M'))) AS digits FROM events WHERE ts IS NOT NULL""",
    "queue_renumbered": f"""WITH {_SHOWN} SELECT id, row_number() OVER (ORDER BY ts_time, id) AS number, CASE WHEN state IN ('Encoding', 'Queue') THEN 'LogoPending' ELSE state END AS state,
  CASE WHEN state NOT IN ('Encoding', 'Queue') THEN start END AS start, CASE WHEN state NOT IN ('Encoding', 'Queue') THEN seconds END AS seconds FROM shown""",
    "queue_cleared_order": f"WITH {_JOBS} SELECT id, state, row_number() OVER (ORDER BY ts_time, id) - 1 AS position FROM jobs WHERE state NOT IN ('Complete', 'PreFailed')",
    "queue_move_whole": f"""WITH {_JOBS}, q AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p FROM jobs)
SELECT id, row_number() OVER (ORDER BY CASE WHEN p = 99 THEN 6.5 ELSE p END) - 1 AS position FROM q""",
    "cache_slots": f"""WITH RECURSIVE scripts AS (SELECT concat(p_type, ' ', p_brand, ' ', p_size) AS script, count(*) AS uses FROM part GROUP BY 1)
, codes AS (SELECT *, md5(script) AS h FROM scripts)
, homes AS (SELECT script, uses, {_FOLDED} & {(1 << CACHE_BITS) - 1} AS home FROM codes)
, turns AS (SELECT *, row_number() OVER (ORDER BY home, script) AS turn FROM homes)
, placed(turn, script, home, uses, slot) AS (
  SELECT turn, script, home, uses, home FROM turns WHERE turn = 1
  UNION ALL
  SELECT t.turn, t.script, t.home, t.uses, greatest(t.home, p.slot + 1) FROM placed p JOIN turns t ON t.turn = p.turn + 1)
SELECT script, home, slot, printf('%08X', slot) AS name, uses FROM placed""",
    "cache_additions": f"""WITH RECURSIVE scripts AS (SELECT concat(p_type, ' ', p_brand, ' ', p_size) AS script, bool_or(p_size % 3 = 0) AS held FROM part GROUP BY 1)
, codes AS (SELECT *, md5(script) AS h FROM scripts)
, homes AS (SELECT script, held, {_FOLDED} & {(1 << CACHE_BITS) - 1} AS home FROM codes)
, turns AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY home, script) AS turn FROM homes)
, first(turn, script, home, slot) AS (
  SELECT turn, script, home, home FROM turns WHERE turn = 1 AND held
  UNION ALL SELECT t.turn, t.script, t.home, greatest(t.home, p.slot + 1) FROM first p JOIN turns t ON t.turn = p.turn + 1 AND t.held)
, free AS (SELECT s, min(CASE WHEN s NOT IN (SELECT slot FROM first) THEN s END) OVER (ORDER BY s DESC) AS next FROM range({4 << CACHE_BITS}) r(s))
, second(turn, script, home, slot) AS (
  SELECT turn, script, home, next FROM turns JOIN free ON s = home WHERE turn = 1 AND NOT held
  UNION ALL SELECT t.turn, t.script, t.home, f.next FROM second p JOIN turns t ON t.turn = p.turn + 1 AND NOT t.held JOIN free f ON f.s = greatest(t.home, p.slot + 1))
SELECT script, true AS held, home, slot FROM first UNION ALL SELECT script, false, home, slot FROM second""",
    "lists_side_by_side": """WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders)
SELECT position, c_custkey, o_orderkey FROM c JOIN o USING (position)""",
    "log_export_order": f"WITH {_SHOWN} SELECT id, start, row_number() OVER (ORDER BY start DESC, id DESC) + 1 AS line FROM shown WHERE start IS NOT NULL",
    "active_workers": """WITH w AS (SELECT s_suppkey, s_acctbal > 9000 AS running, row_number() OVER (ORDER BY s_suppkey) - 1 AS place FROM supplier)
SELECT * FROM w WHERE place < greatest(4, (SELECT coalesce(max(place) FILTER (running), -1) + 1 FROM w))""",
}

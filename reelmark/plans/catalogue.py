"""Queries over a catalogue of jobs; orders stand in for jobs, nations and suppliers for services, parts for recordings.

The stand-ins: state from o_orderstatus (O waits, P runs or is pending, F is over, in several kinds by key), priority from the first digit of
o_orderpriority, the source of a job from its customer, sizes from the key, the time of its recording from o_orderdate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmark.operators import catalogue, rules, scheduling
from reelmark.sources.storage import stored
from reelmark.sources.tables import table

AUTO = rules.AUTO_PREFIX
#: The moment at which a list is looked at.
NOW = "2001-01-01 12:00:00"
MODES = ("Batch", "AutoBatch", "Test", "DrcsCheck", "CMCheck")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    state = (
        F.when(F.col("o_orderstatus") == "O", "Queue")
        .when(F.col("o_orderstatus") == "P", F.when(key % 2 == 0, "Encoding").otherwise("LogoPending"))
        .when(key % 5 == 0, "Failed")
        .when(key % 5 == 1, "PreFailed")
        .when(key % 5 == 2, "Canceled")
        .otherwise("Complete")
    )
    started = ~state.isin("Queue", "LogoPending", "PreFailed")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("source"),
        state.alias("state"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.element_at(F.array(*map(F.lit, MODES)), (key % 5 + 1).cast("int")).alias("mode"),
        F.when(key % 3 == 0, f"{catalogue.TOO_SMALL}(320x180)").otherwise("TS").alias("fail_reason"),
        F.when(started, F.col("o_orderdate")).alias("start"),
        F.when(key % 5 > 0, key % 5000 * 60).otherwise(0).alias("seconds"),
        (key % 4).cast("int").alias("console"),
        (key % 9 * 240).cast("int").alias("width"),
        (key % 5 * 270).cast("int").alias("height"),
        F.col("o_orderdate").alias("ts_time"),
        F.col("o_orderpriority").alias("profile_name"),
        F.concat(F.when(key % 2 == 0, "\\\\nas\\").otherwise("C:\\"), F.lit("rec_"), key.cast("string"), F.lit(".ts")).alias("path"),
        F.concat(F.lit("/out/"), (key % 6).cast("string"), F.lit("/rec_"), key.cast("string")).alias("dst_path"),
        (key % 3 == 0).alias("hash_disabled"),
        F.when(key % 4 > 0, F.array(F.concat(F.lit("genre"), (key % 11).cast("string")))).alias("genres"),
        F.concat(F.lit("rec_"), key.cast("string"), F.lit(".ts")).alias("file_name"),
        (key % 25).cast("int").alias("service_id"),
        F.concat(F.lit("S"), (key % 25).cast("string")).alias("service_name"),
    )


def queue_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word is looked for in all six fields that a list can search."""
    fields = ["file_name", "service_name", "profile_name", "genre_text", "state_text", "mode_text"]
    shown = catalogue.View(True, [0, 1, 2], [2, 3, 5], "1995-01-01 00:00:00", "1999-06-30 00:00:00", "7", fields)
    jobs = catalogue.displayed(_jobs(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))
    return catalogue.view(jobs, shown).select("id", "state", "priority", "start", "finish", "file_name")


def queue_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a queue shows of each job, and what its mode allows."""
    jobs = catalogue.displayed(_jobs(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))
    mode = F.col("mode")
    return jobs.select(
        "id", "is_error", "is_too_small", "elapsed_s", "finish", "genre_text", "size_text", "state_text", "mode_text", "service_text", "time_text", "out_dir",
        catalogue.is_batch(mode).alias("is_batch"), catalogue.is_check(mode).alias("is_check"), catalogue.is_test(mode).alias("is_test"), catalogue.is_small(F.col("width"), F.col("height")).alias("is_one_seg"),
        catalogue.needs_separate_hash(mode, F.col("hash_disabled"), F.col("path")).alias("separate_hash"),
    )


def queue_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's jobs as a saved queue that is taken up again."""
    return catalogue.reloaded(_jobs(spark, sf_dir), "source", "id").select("source", "id", "number", "state", "start", "seconds", catalogue.is_cleared(F.col("state")).alias("cleared"))


def cleared_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clearing takes out of each source's queue, and what stays in its order, numbered from 0."""
    jobs = _jobs(spark, sf_dir).withColumn("cleared", catalogue.is_cleared(F.col("state")))
    order = Window.partitionBy("source", "cleared").orderBy("id")
    return jobs.select("source", "id", "cleared", F.when(~F.col("cleared"), F.row_number().over(order) - 1).alias("position"))


def condition_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as services of which the first fifteen are known; every second one of all, and ids without a service, are on a condition's list."""
    nation = table(spark, sf_dir, "nation")
    listed = nation.select((F.col("n_nationkey") * 2).alias("service_id"), (F.col("n_nationkey") % 3 > 0).alias("checked"))
    return catalogue.checked_last(listed, nation.filter("n_nationkey < 15").select(F.col("n_nationkey").alias("service_id")), "service_id")


def queue_active_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.progress(_jobs(spark, sf_dir), ["priority"]).select("priority", "total", "remaining", F.round("progress", 9).alias("progress"))


def exclude_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), F.col("c_name").alias("path"))
    return catalogue.not_active(files, _jobs(spark, sf_dir), "source")


def service_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as items, nations as services: pairs of them share an id, of which the first in the list counts, and id 0 is none; an item of no service is unknown."""
    services = table(spark, sf_dir, "nation").select(F.floor(F.col("n_nationkey") / 2).cast("int").alias("id"), "n_nationkey", "n_name")
    first = catalogue.first_of(services.filter("id <> 0"), ["id"], ["n_nationkey"]).select("id", "n_name")
    items = table(spark, sf_dir, "supplier")
    return items.join(first, items["s_nationkey"] == first["id"], "left").select("s_suppkey", F.coalesce("n_name", F.lit("不明")).alias("service_name"))


def _logo_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the first four years' names for every service, some off or missing; one in three means that no logo is all right."""
    k = F.col("k")
    start = F.make_date(F.lit(1994) + k, F.col("n_nationkey") % 12 + 1, F.lit(1))
    return (
        table(spark, sf_dir, "nation")
        .select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
        .select(
            F.col("n_nationkey").cast("int").alias("service_id"),
            F.when((F.col("n_nationkey") + k) % 3 == 0, "NO_LOGO").otherwise(F.concat(F.lit("SID"), F.col("n_nationkey").cast("string"), F.lit("-"), k.cast("string"), F.lit(".lgd"))).alias("file_name"),
            ((F.col("n_nationkey") + k) % 7 != 0).alias("exists"),
            ((F.col("n_nationkey") + 2 * k) % 5 != 0).alias("enabled"),
            start.cast("timestamp_ntz").alias("from"),
            F.date_add(start, 300).cast("timestamp_ntz").alias("to"),
        )
    )


def _timed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = F.when(F.col("id") % 50 != 0, F.col("ts_time"))
    return _jobs(spark, sf_dir).select("id", "service_id", unknown.alias("ts_time"))


def valid_logo_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.with_usable(_timed_jobs(spark, sf_dir), _logo_settings(spark, sf_dir), "service_id", "ts_time").select("id", "service_id")


def valid_logo_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = catalogue.usable_lists(_timed_jobs(spark, sf_dir), _logo_settings(spark, sf_dir), "id", "service_id", "ts_time", "NO_LOGO")
    return lists.select("id", F.array_join("files", ";").alias("files"), "allows_none")


# rule set, number, tag, part of the file name, genres (level1, level2), services, sizes; then profile and priority.
_RULE_ROWS = [
    ("basic", 1, "ECONOMY", None, None, None, ["SD", "OneSeg"], "small", 2),
    ("basic", 2, None, "red", None, None, None, "drama", 5),
    ("basic", 3, None, None, [(0, 3, -1), (0, 5, 1)], None, None, "sports", 4),
    ("basic", 4, None, None, None, [1, 4, 9], ["FullHD"], "wide", 3),
    ("basic", 5, "SMALL", "bolt", None, None, None, "bolts", 1),
    ("strict", 1, "PROMO", "ring", None, None, ["HD1440"], "rings", 3),
    ("strict", 2, None, None, None, [2], None, "service two", 2),
    ("all", 1, None, None, None, None, None, "default", 1),
]


def _rules(spark: SparkSession) -> DataFrame:
    rows = [
        (s, n, tag is not None, tag, name is not None, name, genres is not None, genres or [], services is not None, services or [], sizes is not None, sizes or [], profile, priority)
        for s, n, tag, name, genres, services, sizes, profile, priority in _RULE_ROWS
    ]
    return spark.createDataFrame(rows, rules.RULES)


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    genre = F.struct(F.lit(0).alias("space"), (key % 7).cast("int").alias("level1"), (key % 3).cast("int").alias("level2"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.array(F.col("p_type")).alias("tags"),
        F.col("p_name").alias("file_name"),
        F.when(key % 4 != 0, F.array(genre)).otherwise(F.array().cast("array<struct<space:int,level1:int,level2:int>>")).alias("genres"),
        F.coalesce(F.regexp_extract("p_brand", "#([0-9]+)", 1).try_cast("int"), F.lit(-1)).alias("service_id"),
        (F.col("p_size") * 40).alias("width"),
    )


def rule_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _recordings(spark, sf_dir).withColumn("rule_set", F.lit("basic"))
    return rules.assign(items, _rules(spark)).select("id", "profile", "priority")


def profile_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in (f"{AUTO}Basic", f"{AUTO}strict", f"{AUTO}gone", "Small", "nothing", f"{AUTO}all")])
    items = _recordings(spark, sf_dir).withColumn("requested", F.element_at(names, (F.col("id") % 6 + 1).cast("int")))
    profiles = spark.createDataFrame([(x,) for x in ("SMALL", "drama", "Sports", "wide", "default", "rings")], "profile_name string")
    return rules.resolve(items, _rules(spark), profiles).select("id", "requested", "profile", "priority", "fail_reason")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting jobs with what they ask for and what it costs beside what their group uses; nations are the groups."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.floor(F.sum("l_quantity")).cast("int").alias("q"), F.count("*").cast("int").alias("n"))
    jobs = _jobs(spark, sf_dir).filter(F.col("state") == "Queue").join(sums, F.col("id") == F.col("l_orderkey"))
    cpu, hdd, gpu = F.col("q") % 101, F.col("n") * 10 % 101, (F.col("q") + F.col("n")) % 51
    asked = jobs.select("id", "service_id", "priority", cpu.alias("cpu"), hdd.alias("hdd"), gpu.alias("gpu"))
    node = F.col("service_id")
    used = [node * 3 % 60, node * 5 % 60]
    gpu_most, gpu_used = F.array(F.lit(100), F.lit(80), F.lit(60)), F.array(node * 7 % 90, node * 11 % 80, node * 2 % 60)
    value = scheduling.cost([F.col("cpu"), F.col("hdd"), F.col("gpu")], used, gpu_most, gpu_used)
    return asked.select(
        "service_id", scheduling.packed(F.col("cpu"), F.col("hdd"), F.col("gpu")).alias("resource_key"), "priority", F.col("id").alias("position"), value.alias("cost"), "id", "cpu", "hdd", "gpu"
    ).withColumn("gpu_index", scheduling.freest(gpu_most, gpu_used))


def schedule_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.next_jobs(_requests(spark, sf_dir), ["service_id"]).select("service_id", "id", "tier", "priority", "cost", "resource_key")


def schedule_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which the heads of all resource keys would be looked at."""
    heads = scheduling.heads(_requests(spark, sf_dir), ["service_id"])
    order = Window.partitionBy("service_id").orderBy(scheduling.tier(F.col("priority")), "cost", F.desc("priority"), "position")
    return heads.select("service_id", "id", "resource_key", F.row_number().over(order).alias("turn"))


def gpu_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = scheduling.admitted(stored(_requests(spark, sf_dir)), ["service_id"])
    return waiting.select("id", "service_id", "gpu_index", "cost", "admitted")


def schedule_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next job of each service without regard to resources, and how many jobs no longer stand where their priority and resources put them."""
    jobs = _requests(spark, sf_dir).withColumn("asked", F.col("priority") * 2 - 4)
    moved = scheduling.is_misplaced(F.col("id") % 5 + 1, F.col("resource_key") - F.col("id") % 2, scheduling.clamped(F.col("asked")), F.col("resource_key"))
    counts = jobs.groupBy("service_id").agg(F.count_if(moved).alias("misplaced"))
    return scheduling.next_in_order(jobs.withColumn("priority", scheduling.clamped(F.col("asked"))), ["service_id"]).select("service_id", "id", "priority", "resource_key").join(counts, "service_id")


def sibling_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalogue.sibling_outcome(_jobs(spark, sf_dir), "source")
    return out.select("id", "source", "any_active", "any_complete", "any_failed", "none_canceled")


def mru_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.most_recent(table(spark, sf_dir, "events").filter("user_id is not null"), ["user_id"], "event_type", "ts", 3).select("user_id", "event_type", "rank")


def multi_channel_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 4).alias("pid"), "l_linenumber", "l_partkey", "l_suppkey")
    out = catalogue.channel_numbers(rows, "l_orderkey", "pid", ["l_linenumber", "l_partkey", "l_suppkey"])
    suffix = F.when(F.col("number") > 0, F.concat(F.lit("-multi"), F.col("number").cast("string"))).otherwise("")
    return out.select("l_orderkey", "pid", F.col("number").cast("int").alias("number"), suffix.alias("suffix"))


def queue_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's jobs numbered from 0, then the one at a third of the list moved to its end; sources of even number ask for a place beyond it, which is refused."""
    by = Window.partitionBy("source")
    position = (F.row_number().over(by.orderBy("id")) - 1).cast("long")
    jobs = _jobs(spark, sf_dir).select("source", F.col("id").alias("item"), position.alias("position"), F.count("*").over(by).alias("n"))
    to = F.when(F.col("source") % 2 == 0, F.col("n")).otherwise(F.col("n") - 1)
    return jobs.select("source", "item", scheduling.shifted(F.col("position"), F.floor(F.col("n") / 3), to, F.col("n")).alias("position"))


def queue_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a table of moves, one for each source that wants any: its latest job goes to the front."""
    jobs = _jobs(spark, sf_dir).select("source", F.col("id").alias("item"), (F.row_number().over(Window.partitionBy("source").orderBy("id")) - 1).cast("long").alias("position"))
    jobs = stored(jobs)
    moves = jobs.groupBy("source").agg(F.max("item").alias("item")).filter("source % 3 > 0").withColumn("to", F.lit(0).cast("long"))
    return scheduling.moved(jobs, ["source"], moves)


def free_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).cast("long").alias("slot")).filter("slot % 3 <> 1")
    return scheduling.lowest_free(used, ["l_orderkey"], "slot")


def cross_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job for each of a source's outputs: the three ways of writing them are opened out of an array."""
    outputs = F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(d).alias("dst")) for p, d in (("main", "/out/a"), ("mobile", "/out/b"), ("archive", "/out/c"))])
    jobs = _jobs(spark, sf_dir).filter(F.col("state") == "Queue")
    return jobs.select("id", F.explode(outputs).alias("o")).select("id", "o.profile", F.concat("o.dst", F.lit("/"), F.col("id").cast("string")).alias("path"))


_JOBS = """jobs AS (
  SELECT o_orderkey AS id, o_custkey AS source,
    CASE WHEN o_orderstatus = 'O' THEN 'Queue' WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Encoding' ELSE 'LogoPending' END
      WHEN o_orderkey % 5 = 0 THEN 'Failed' WHEN o_orderkey % 5 = 1 THEN 'PreFailed' WHEN o_orderkey % 5 = 2 THEN 'Canceled' ELSE 'Complete' END AS state,
    cast(left(o_orderpriority, 1) AS INT) AS priority, o_orderkey % 9 * 240 AS width, o_orderkey % 5 * 270 AS height, o_orderdate AS ts_time, o_orderpriority AS profile_name,
    concat('rec_', o_orderkey, '.ts') AS file_name, cast(o_orderkey % 25 AS INT) AS service_id
  FROM orders)"""
# What a list shows, each text spelt out as the service's own list does.
_SHOWN = (
    _JOBS
    + """
, timed AS (
  SELECT *, CASE WHEN state IN ('Encoding', 'Complete', 'Failed', 'Canceled') THEN ts_time END AS start, CASE WHEN id % 5 > 0 THEN id % 5000 * 60 ELSE 0 END AS seconds FROM jobs)
, shown AS (
  SELECT *, CASE WHEN seconds <> 0 THEN start + to_seconds(seconds) END AS finish, state = 'PreFailed' AND id % 3 = 0 AS is_too_small,
    CASE WHEN id % 4 > 0 THEN concat('genre', id % 11) ELSE '' END AS genre_text, concat('S', service_id) AS service_name,
    CASE state WHEN 'Queue' THEN '待ち' WHEN 'Encoding' THEN concat(CASE id % 5 WHEN 4 THEN 'CM解析中→' WHEN 3 THEN 'DRCSチェック中→' ELSE 'エンコード中→' END, id % 4 + 1)
      WHEN 'Failed' THEN '失敗' WHEN 'PreFailed' THEN '失敗' WHEN 'LogoPending' THEN 'ペンディング' WHEN 'Canceled' THEN 'キャンセル' ELSE '完了' END AS state_text,
    ['通常', '自動追加', 'テスト', 'DRCSチェック', 'CM解析'][id % 5 + 1] AS mode_text FROM timed)"""
)
_ACTIVE = "state IN ('Encoding', 'LogoPending', 'Queue')"
_SETTINGS = (
    _JOBS
    + """
, settings AS (
  SELECT n_nationkey AS service_id, CASE WHEN (n_nationkey + k) % 3 = 0 THEN 'NO_LOGO' ELSE concat('SID', n_nationkey, '-', k, '.lgd') END AS file_name,
    (n_nationkey + k) % 7 <> 0 AND (n_nationkey + 2 * k) % 5 <> 0 AS usable, make_date(1994 + k, n_nationkey % 12 + 1, 1) AS a, make_date(1994 + k, n_nationkey % 12 + 1, 1) + 300 AS b
  FROM nation, range(6) t(k))
, timed AS (SELECT id, service_id, CASE WHEN id % 50 <> 0 THEN ts_time END AS t FROM jobs)"""
)
_RECORDINGS = """recordings AS (
  SELECT p_partkey AS id, p_type AS tag, p_name AS file_name, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 7 END AS g1, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 3 END AS g2,
    coalesce(try_cast(regexp_extract(p_brand, '#([0-9]+)', 1) AS INT), -1) AS service_id,
    CASE WHEN p_size * 40 > 1440 THEN 'FullHD' WHEN p_size * 40 > 720 THEN 'HD1440' WHEN p_size * 40 > 320 THEN 'SD' ELSE 'OneSeg' END AS size FROM part)
, matched AS (
  SELECT *, CASE WHEN tag = 'ECONOMY' AND size IN ('SD', 'OneSeg') THEN 1 WHEN contains(file_name, 'red') THEN 2 WHEN g1 = 3 OR (g1 = 5 AND g2 = 1) THEN 3
      WHEN service_id IN (1, 4, 9) AND size = 'FullHD' THEN 4 WHEN tag = 'SMALL' AND contains(file_name, 'bolt') THEN 5 END AS basic,
    CASE WHEN tag = 'PROMO' AND contains(file_name, 'ring') AND size = 'HD1440' THEN 1 WHEN service_id = 2 THEN 2 END AS strict FROM recordings)
, named AS (
  SELECT *, ['small', 'drama', 'sports', 'wide', 'bolts'][basic] AS basic_profile, coalesce([2, 5, 4, 3, 1][basic], 0) AS basic_priority,
    ['rings', 'service two'][strict] AS strict_profile, coalesce([3, 2][strict], 0) AS strict_priority FROM matched)"""
_REQUESTS = (
    _JOBS
    + """
, sums AS (SELECT l_orderkey, cast(floor(sum(l_quantity)) AS INT) AS q, cast(count(*) AS INT) AS n FROM lineitem GROUP BY l_orderkey)
, asked AS (SELECT id, service_id, priority, q % 101 AS cpu, n * 10 % 101 AS hdd, (q + n) % 51 AS gpu FROM jobs JOIN sums ON id = l_orderkey WHERE state = 'Queue')
, rooms AS (
  SELECT *, service_id * 7 % 90 AS u0, service_id * 11 % 80 AS u1, service_id * 2 % 60 AS u2 FROM asked)
, chosen AS (SELECT *, CASE WHEN 100 - u0 >= 80 - u1 AND 100 - u0 >= 60 - u2 THEN 0 WHEN 80 - u1 >= 60 - u2 THEN 1 ELSE 2 END AS gpu_index FROM rooms)
, requests AS (
  SELECT *, cpu * 65536 + hdd * 256 + gpu AS resource_key,
    greatest(service_id * 3 % 60 + cpu - 100, service_id * 5 % 60 + hdd - 100, CASE gpu_index WHEN 0 THEN u0 + gpu - 100 WHEN 1 THEN u1 + gpu - 80 ELSE u2 + gpu - 60 END) AS cost,
    CASE WHEN priority >= 5 THEN 0 WHEN priority >= 2 THEN 1 ELSE 2 END AS tier FROM chosen)
, heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service_id, resource_key ORDER BY priority DESC, id) AS k FROM requests) WHERE k = 1)
, tier_heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service_id, tier, resource_key ORDER BY priority DESC, id) AS k FROM requests) WHERE k = 1)"""
)
_LISTS = (
    _JOBS
    + """
, lists AS (SELECT source, id AS item, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY source) AS n FROM jobs WINDOW w AS (PARTITION BY source ORDER BY id))"""
)

QUERIES = {
    f.__name__: f
    for f in (
        queue_view, queue_active_progress, exclude_active, service_lookup, valid_logo_semi, valid_logo_all, rule_assignment, profile_resolution, schedule_next, schedule_order, gpu_headroom,
        queue_display, queue_reload, cleared_queue, condition_services, schedule_off, sibling_outcome, mru_history, multi_channel_seq, queue_move, queue_moves, free_index, cross_outputs,
    )
}
ORACLE_SQL = {
    "queue_view": f"""WITH {_SHOWN} SELECT id, state, priority, start, finish, file_name FROM shown
WHERE NOT is_too_small AND greatest(0, least(4, priority - 1)) IN (0, 1, 2) AND state IN ('Encoding', 'Canceled', 'Failed', 'PreFailed')
  AND NOT finish < TIMESTAMP '1995-01-01' AND NOT coalesce(start > TIMESTAMP '1999-06-30', false)
  AND (contains(file_name, '7') OR contains(service_name, '7') OR contains(profile_name, '7') OR contains(genre_text, '7') OR contains(state_text, '7') OR contains(mode_text, '7'))""",
    "queue_active_progress": f"""WITH {_JOBS}, c AS (
  SELECT priority, count(*) FILTER (state <> 'LogoPending' AND state <> 'PreFailed') AS total, count(*) FILTER (state = 'Queue' OR state = 'Encoding') AS remaining FROM jobs GROUP BY priority)
SELECT *, round((total - remaining + 0.1::DOUBLE) / (total + 0.1::DOUBLE), 9) AS progress FROM c""",
    "exclude_active": f"WITH {_JOBS} SELECT c_custkey AS source, c_name AS path FROM customer WHERE c_custkey NOT IN (SELECT source FROM jobs WHERE {_ACTIVE} AND source IS NOT NULL)",
    "service_lookup": """SELECT s_suppkey, coalesce((SELECT n_name FROM nation WHERE n_nationkey // 2 = s_nationkey AND s_nationkey <> 0 ORDER BY n_nationkey LIMIT 1), '不明') AS service_name FROM supplier""",
    "valid_logo_semi": f"WITH {_SETTINGS} SELECT id, service_id FROM timed WHERE EXISTS (SELECT 1 FROM settings s WHERE s.service_id = timed.service_id AND usable AND (t IS NULL OR t BETWEEN a AND b))",
    "valid_logo_all": f"""WITH {_SETTINGS} SELECT timed.id, coalesce(string_agg(CASE WHEN file_name <> 'NO_LOGO' THEN file_name END, ';' ORDER BY file_name), '') AS files, coalesce(bool_or(file_name = 'NO_LOGO'), false) AS allows_none
FROM timed LEFT JOIN settings s ON s.service_id = timed.service_id AND usable AND (t IS NULL OR t BETWEEN a AND b) GROUP BY timed.id""",
    "rule_assignment": f"WITH {_RECORDINGS} SELECT id, basic_profile AS profile, basic_priority AS priority FROM named",
    "profile_resolution": f"""WITH {_RECORDINGS} SELECT id, ['{AUTO}Basic', '{AUTO}strict', '{AUTO}gone', 'Small', 'nothing', '{AUTO}all'][id % 6 + 1] AS requested,
  CASE id % 6 WHEN 0 THEN CASE basic_profile WHEN 'small' THEN 'SMALL' WHEN 'sports' THEN 'Sports' WHEN 'bolts' THEN NULL ELSE basic_profile END WHEN 1 THEN CASE WHEN strict_profile = 'rings' THEN 'rings' END WHEN 3 THEN 'SMALL' WHEN 5 THEN 'default' END AS profile,
  CASE id % 6 WHEN 0 THEN basic_priority WHEN 1 THEN strict_priority WHEN 5 THEN 1 ELSE 0 END AS priority,
  CASE id % 6 WHEN 0 THEN CASE WHEN basic IS NULL THEN 'no rule holds' WHEN basic = 5 THEN 'no such profile' ELSE '' END
    WHEN 1 THEN CASE WHEN strict IS NULL THEN 'no rule holds' WHEN strict = 2 THEN 'no such profile' ELSE '' END WHEN 2 THEN 'no such rule set' WHEN 4 THEN 'no such profile' ELSE '' END AS fail_reason FROM named""",
    "schedule_next": f"""WITH {_REQUESTS} SELECT service_id, id, tier, priority, cost, resource_key FROM (
  SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY tier, cost, priority DESC, id) AS turn FROM tier_heads) WHERE turn = 1""",
    "schedule_order": f"WITH {_REQUESTS} SELECT service_id, id, resource_key, row_number() OVER (PARTITION BY service_id ORDER BY tier, cost, priority DESC, id) AS turn FROM heads",
    "gpu_headroom": f"WITH {_REQUESTS} SELECT id, service_id, gpu_index, cost, cost <= 0 AND cost <= min(cost) OVER (PARTITION BY service_id) AS admitted FROM requests",
    "sibling_outcome": f"""WITH {_JOBS} SELECT id, source, bool_or({_ACTIVE}) OVER w AS any_active, bool_or(state = 'Complete') OVER w AS any_complete,
  bool_or(state IN ('Failed', 'PreFailed')) OVER w AS any_failed, bool_and(state <> 'Canceled') OVER w AS none_canceled FROM jobs WINDOW w AS (PARTITION BY source)""",
    "mru_history": """SELECT user_id, event_type, rank FROM (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) AS rank FROM events WHERE user_id IS NOT NULL GROUP BY user_id, event_type) WHERE rank <= 3""",
    "multi_channel_seq": """WITH firsts AS (SELECT * FROM (
  SELECT l_orderkey, l_partkey % 4 AS pid, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 4 ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1)
, n AS (SELECT l_orderkey, pid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS number FROM firsts)
SELECT l_orderkey, pid, number, CASE WHEN number > 0 THEN concat('-multi', number) ELSE '' END AS suffix FROM n""",
    "queue_move": f"""WITH {_LISTS} SELECT source, item, row_number() OVER (PARTITION BY source ORDER BY source % 2 = 1 AND position = n // 3, position) - 1 AS position FROM lists""",
    "queue_moves": f"""WITH {_LISTS} SELECT source, item, row_number() OVER (PARTITION BY source ORDER BY NOT (source % 3 > 0 AND position = n - 1), position) - 1 AS position FROM lists""",
    "queue_display": f"""WITH {_SHOWN} SELECT id, state IN ('Failed', 'PreFailed') AS is_error, is_too_small, coalesce(date_diff('second', start, TIMESTAMP '2001-01-01 12:00:00'), 0) AS elapsed_s, finish, genre_text,
  concat(width, 'x', height) AS size_text, state_text, mode_text, concat(service_name, '(', service_id, ')') AS service_text, strftime(ts_time, '%Y年%m月%d日') AS time_text, concat('/out/', id % 6) AS out_dir,
  id % 5 < 2 AS is_batch, id % 5 > 2 AS is_check, id % 5 = 2 AS is_test, width <= 320 OR height <= 260 AS is_one_seg, id % 5 = 0 AND id % 3 <> 0 AND id % 2 = 0 AS separate_hash FROM shown""",
    "queue_reload": f"""WITH {_SHOWN} SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) AS number, CASE WHEN state IN ('Encoding', 'Queue') THEN 'LogoPending' ELSE state END AS state,
  CASE WHEN state NOT IN ('Encoding', 'Queue') THEN start END AS start, CASE WHEN state NOT IN ('Encoding', 'Queue') THEN seconds END AS seconds, state IN ('Complete', 'PreFailed') AS cleared FROM shown""",
    "cleared_queue": f"""WITH {_JOBS}, c AS (SELECT source, id, state IN ('Complete', 'PreFailed') AS cleared FROM jobs)
SELECT source, id, cleared, CASE WHEN NOT cleared THEN (SELECT count(*) FROM c o WHERE o.source = c.source AND NOT o.cleared AND o.id < c.id) END AS position FROM c""",
    "condition_services": """SELECT n_nationkey * 2 AS service_id, n_nationkey * 2 < 15 AS known FROM nation WHERE n_nationkey * 2 >= 15 OR n_nationkey % 3 > 0""",
    "schedule_off": f"""WITH {_REQUESTS}, o AS (SELECT service_id, id, resource_key, greatest(1, least(5, priority * 2 - 4)) AS priority FROM requests)
, m AS (SELECT service_id, count(*) FILTER (id % 5 + 1 <> priority OR id % 2 <> 0) AS misplaced FROM o GROUP BY service_id)
SELECT service_id, id, priority, resource_key, misplaced FROM (SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY priority DESC, id) AS k FROM o) JOIN m USING (service_id) WHERE k = 1""",
    "free_index": """WITH used AS (SELECT DISTINCT l_orderkey, l_linenumber - 1 AS slot FROM lineitem WHERE (l_linenumber - 1) % 3 <> 1)
SELECT k.l_orderkey, min(s) AS free FROM (SELECT DISTINCT l_orderkey FROM used) k, range(20) t(s) WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.l_orderkey = k.l_orderkey AND u.slot = s) GROUP BY k.l_orderkey""",
    "cross_outputs": f"""WITH {_JOBS} SELECT id, profile, concat(dst, '/', id) AS path FROM jobs, (VALUES ('main', '/out/a'), ('mobile', '/out/b'), ('archive', '/out/c')) o(profile, dst) WHERE state = 'Queue'""",
}

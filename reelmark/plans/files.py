"""Queries over files: tables are written as the files that a recorder's folders hold, then listed, read, digested and watched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmark.operators import hooks, series, texts
from reelmark.plans.frames import _SECTIONS
from reelmark.sources import formats, storage
from reelmark.sources.tables import frame_scores, table
from reelmark.streaming import updates


def _recordings(spark: SparkSession, sf_dir: str, folder: str, suffix: str = ".TS") -> None:
    """A file for each type of event, a line for each event."""
    rows = table(spark, sf_dir, "events").filter("event_type is not null").select("event_type", F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "props").alias("line"))
    storage.write_named(rows, "event_type", "line", folder, suffix)


def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings and logs in a folder; those whose names end and begin as asked for, whatever the case of the end."""
    folder = storage.shared_folder(spark)
    _recordings(spark, sf_dir, folder)
    _recordings(spark, sf_dir, folder, ".log")
    found = storage.folder_files(spark, folder, [".ts", ".m2t"])
    starts = storage.folder_files(spark, folder, [".log"], prefix="s")
    return found.union(starts).select("name", "length")


def drop_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dropped folder gives the recordings right in it, a dropped file itself; of these the names that a later list finds again."""
    folder = storage.shared_folder(spark)
    _recordings(spark, sf_dir, folder)
    _recordings(spark, sf_dir, f"{folder}/below")
    single = spark.createDataFrame([(f"{folder}/below/click.TS",)], "path string")
    dropped = storage.dropped_files(spark, [folder], single, "ts")
    known = storage.existing(spark, dropped.withColumn("path", F.regexp_replace("path", "^(file:)?/+", "file:/")), folder)
    counted = dropped.agg(F.count("*").alias("dropped"))
    result = storage.first_result(spark, folder, ".ts").select(F.regexp_extract("path", "([^/]*)$", 1).alias("first"))
    return counted.join(known.agg(F.count("*").alias("known")), F.lit(True)).join(result, F.lit(True))


def xml_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended to an XML log in two goes and read back."""
    folder = storage.shared_folder(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    for k in range(2):
        storage.append_xml_log(orders.filter(F.pmod("o_orderkey", F.lit(2)) == k), folder, "LogItem")
    read = storage.read_xml_log(spark, folder, "LogItem", "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    return read.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("items"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("price"))


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of recordings appended to a manifest, read back and held against the recordings as they were written."""
    folder, manifest = storage.shared_folder(spark), storage.shared_folder(spark)
    _recordings(spark, sf_dir, folder)
    storage.append_manifest(storage.file_digests(spark, folder), manifest)
    lines = storage.text_lines(spark, manifest).withColumn("m", F.lit(0))
    entries = texts.manifest_entries(lines.withColumn("k", F.struct("path", "block", "number")), "m", "k", "line").select("name", "digest")
    whole = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.sha2("content", 512).alias("own"), "length")
    return whole.join(entries, "name", "left").select("name", "length", F.coalesce(F.col("own") == F.col("digest"), F.lit(False)).alias("same"))


def manifest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of documents appended to a manifest in two goes, as a data source, and read back by ranges of bytes."""
    formats.register(spark)
    folder = storage.shared_folder(spark)
    docs = table(spark, sf_dir, "documents").filter("text is not null and doc_id is not null")
    rows = docs.select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), F.concat(F.sha2("text", 256), F.sha2("text", 256)).alias("digest"))
    for k in range(2):
        rows.filter(F.pmod("doc_id", F.lit(2)) == k).select("name", "digest").write.format("hash_manifest").mode("append").save(folder)
    return spark.read.format("hash_manifest").option("rangeBytes", 1 << 16).load(folder).select("name", "digest")


def section_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of all series as a list of lines, written and read back as a data source."""
    formats.register(spark)
    folder = storage.shared_folder(spark)
    found = series.sections(series.frame_labels(frame_scores(spark, sf_dir)))
    ends = F.array(*[F.struct(F.col(f"{x}_best").alias("best"), F.lit(x == "s").alias("is_start"), F.col(f"{x}_start").alias("start"), F.col(f"{x}_end").alias("end")) for x in "se"])
    found.select(F.explode(ends).alias("e")).select("e.*").write.format("section_list").mode("append").save(folder)
    return spark.read.format("section_list").load(folder).groupBy("is_start", "start", "end", "best").agg(F.count("*").alias("lines"))


def glyph_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glyph map written as lines, with what is no entry among them, and read back: the first entry of a glyph counts."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.upper(F.md5((F.col("p_partkey") % 300).cast("string"))).alias("glyph"), "p_name")
    first = Window.partitionBy("glyph").orderBy("p_partkey")
    lines = parts.withColumn("k", F.row_number().over(first)).select("k", F.when(F.col("k") == 3, F.concat(F.lit("x"), "glyph")).otherwise(F.col("glyph")).alias("glyph"), "p_name")
    folder = storage.shared_folder(spark)
    lines.filter("k <= 2 or k = 3").repartition("glyph").sortWithinPartitions("k").select(F.concat_ws("=", "glyph", "p_name").alias("value")).write.text(folder)
    return storage.glyph_map(spark, folder)


def candidate_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written to a folder for each candidate mark and read back."""
    scores = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).alias("logo"), "l_orderkey", "l_linenumber", "l_discount")
    folder = storage.shared_folder(spark)
    storage.write_by_candidate(scores, folder, "logo")
    read = spark.read.schema("l_orderkey long, l_linenumber int, l_discount double, logo int").csv(folder)
    return read.groupBy("logo").agg(F.count("*").alias("frames"), F.sum("l_orderkey").alias("keys"), F.round(F.sum("l_discount"), 4).alias("score"))


def comment_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as one document of comments."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null and conv_id is not null and turn is not null")
    packets = storage.comment_packet(turns.select("conv_id", "turn", F.concat(F.lit("<chat>"), F.length("text").cast("string"), F.lit("</chat>")).alias("line")), "conv_id", "turn", "line")
    return packets.select("conv_id", F.md5("packet").alias("packet_md5"), F.length("packet").alias("chars"))


def folder_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a watcher finds in three looks at a folder: all files but one, then that one as well, one gone and one of other contents, then nothing."""
    folder, state = storage.shared_folder(spark), storage.shared_folder(spark)
    events = table(spark, sf_dir, "events").filter("event_type is not null").select("event_type", F.col("event_id").cast("string").alias("line"))
    storage.write_named(events.filter("event_type <> 'view'"), "event_type", "line", folder, ".ts")
    found = [updates.look(spark, folder, [".ts"], state, 0)]
    storage.write_named(events.filter("event_type = 'view'"), "event_type", "line", folder, ".ts")
    storage.write_named(events.filter("event_type = 'error'").withColumn("line", F.concat("line", F.lit("!"))), "event_type", "line", folder, ".ts")
    storage.removed(spark, f"{folder}/signup.ts")
    found += [updates.look(spark, folder, [".ts"], state, k) for k in (1, 1, 2)]
    whole = spark.read.parquet(f"{state}/changes")
    return whole.select("number", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "change")


def _commands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users as jobs, events as commands of their scripts."""
    e = table(spark, sf_dir, "events").filter("user_id is not null and event_id is not null")
    n = F.col("event_id")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    command = pick((hooks.ADD_TAG, hooks.SET_OUT_DIR, hooks.SET_PRIORITY, hooks.GET_OUT_FILES, hooks.CANCEL), F.floor(n * 7 / 3))
    arg = F.when(n % 17 == 0, F.lit("")).when(command == hooks.ADD_TAG, F.concat(F.lit("t"), (n % 7).cast("string"))).when(command == hooks.SET_OUT_DIR, F.concat(F.lit("D:\\out"), (n % 5).cast("string"), F.lit("\\"))).otherwise((n % 8).cast("string"))
    commands = e.select(F.col("user_id").alias("job"), n.alias("seq"), pick((hooks.ON_ADD, hooks.PRE_ENCODE, hooks.POST_ENCODE), F.floor(n / 5)).alias("phase"), command.alias("command"), arg.alias("arg"))
    key = F.col("job").cast("string")
    jobs = e.select(F.col("user_id").alias("job")).distinct().select(
        "job", F.array(F.lit("t3")).alias("tags"), F.concat(F.lit("C:\\dst\\rec_"), key, F.lit(".mp4")).alias("dst_path"), F.lit(3).alias("priority"), F.lit("Queue").alias("state"),
        F.array(F.concat(F.lit("a"), key), F.concat(F.lit("b"), key)).alias("out_files"),
    )
    return jobs, commands


def hook_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after all commands of their scripts."""
    done = hooks.commanded(*_commands(spark, sf_dir), "job")
    return done.select("job", F.array_join("tags", ";").alias("tags"), "dst_path", "priority", "state", F.size("replies").alias("replies"))


def hook_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each command was answered."""
    done = hooks.commanded(*_commands(spark, sf_dir), "job")
    return done.select("job", F.explode("replies").alias("r")).select("job", "r.seq", "r.reply")


QUERIES = {f.__name__: f for f in (folder_scan, drop_expansion, xml_log, file_manifest, manifest_source, section_source, glyph_file, candidate_dump, comment_packets, folder_changes, hook_results, hook_replies)}

_LINES = "lines AS (SELECT event_type, concat_ws(',', event_id, user_id, props) AS line FROM events WHERE event_type IS NOT NULL)"
_COMMANDS = r"""commands AS (
  SELECT user_id AS job, event_id AS seq, ['OnAdd', 'PreEncode', 'PostEncode'][event_id // 5 % 3 + 1] AS phase, ['AddTag', 'SetOutDir', 'SetPriority', 'GetOutFiles', 'CancelItem'][event_id * 7 // 3 % 5 + 1] AS command
  FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL)
, given AS (
  SELECT *, CASE WHEN seq % 17 = 0 THEN '' WHEN command = 'AddTag' THEN concat('t', seq % 7) WHEN command = 'SetOutDir' THEN concat('D:\out', seq % 5, '\') ELSE cast(seq % 8 AS VARCHAR) END AS arg FROM commands)
, tags AS (
  SELECT job, tag, min(seq) AS seq FROM (SELECT job, arg AS tag, seq FROM given WHERE command = 'AddTag' AND arg <> '' UNION ALL SELECT DISTINCT job, 't3', -1 FROM given) GROUP BY job, tag)"""
ORACLE_SQL = {
    "folder_scan": f"""WITH {_LINES}, sizes AS (SELECT event_type, sum(strlen(line) + 1)::BIGINT AS length FROM lines GROUP BY event_type)
SELECT concat(event_type, '.TS') AS name, length FROM sizes UNION ALL SELECT concat(event_type, '.log'), length FROM sizes WHERE starts_with(event_type, 's')""",
    "drop_expansion": f"WITH {_LINES} SELECT count(DISTINCT event_type) + 1 AS dropped, count(DISTINCT event_type) + 1 AS known, concat(min(event_type), '.TS') AS first FROM lines",
    "xml_log": "SELECT o_orderstatus, o_orderpriority, count(*) AS items, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY ALL",
    "file_manifest": f"WITH {_LINES} SELECT concat(event_type, '.TS') AS name, sum(strlen(line) + 1)::BIGINT AS length, true AS same FROM lines GROUP BY event_type",
    "manifest_source": "SELECT concat('doc ', doc_id) AS name, concat(sha256(text), sha256(text)) AS digest FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL",
    "section_source": f"""WITH {_SECTIONS} SELECT is_start, start, "end", best, count(*) AS lines FROM (
  SELECT true AS is_start, s_start AS start, s_end AS "end", s_best AS best FROM sections UNION ALL SELECT false, e_start, e_end, e_best FROM sections) GROUP BY ALL""",
    "glyph_file": """SELECT upper(md5(cast(p_partkey % 300 AS VARCHAR))) AS glyph, arg_min(p_name, p_partkey) AS text FROM part GROUP BY 1""",
    "candidate_dump": "SELECT (l_suppkey % 8)::INTEGER AS logo, count(*) AS frames, sum(l_orderkey)::BIGINT AS keys, round(sum(l_discount), 4) AS score FROM lineitem GROUP BY 1",
    "comment_packets": """WITH p AS (
  SELECT conv_id, concat('<?xml version=''1.0'' encoding=''UTF-8''?>', chr(10), '<packet>', chr(10), string_agg(concat('<chat>', length(text), '</chat>'), chr(10) ORDER BY turn, concat('<chat>', length(text), '</chat>')), chr(10), '</packet>') AS packet
  FROM conversations WHERE text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id)
SELECT conv_id, md5(packet) AS packet_md5, length(packet) AS chars FROM p""",
    "folder_changes": """WITH t AS (SELECT DISTINCT event_type AS e FROM events WHERE event_type IS NOT NULL)
SELECT 0 AS number, concat(e, '.ts') AS name, 'add' AS change FROM t WHERE e <> 'view' UNION ALL SELECT 1, concat(e, '.ts'), CASE e WHEN 'view' THEN 'add' WHEN 'signup' THEN 'remove' ELSE 'change' END FROM t WHERE e IN ('view', 'signup', 'error')""",
    "hook_results": f"""WITH {_COMMANDS}
SELECT g.job, any_value(t.tags) AS tags, concat(coalesce(arg_max(rtrim(arg, '\\'), seq) FILTER (command = 'SetOutDir' AND phase <> 'PostEncode' AND arg <> ''), 'C:\\dst'), '\\rec_', g.job, '.mp4') AS dst_path,
  coalesce(arg_max(try_cast(arg AS INTEGER), seq) FILTER (command = 'SetPriority' AND phase = 'OnAdd' AND try_cast(arg AS INTEGER) BETWEEN 1 AND 5), 3) AS priority,
  CASE WHEN bool_or(command = 'CancelItem' AND phase <> 'PostEncode') THEN 'Canceled' ELSE 'Queue' END AS state, count(*) AS replies
FROM given g JOIN (SELECT job, string_agg(tag, ';' ORDER BY seq) AS tags FROM tags GROUP BY job) t ON t.job = g.job GROUP BY g.job""",
    "hook_replies": f"""WITH {_COMMANDS}
SELECT job, seq, CASE command WHEN 'AddTag' THEN (SELECT string_agg(tag, ';' ORDER BY t.seq) FROM tags t WHERE t.job = g.job AND t.seq <= g.seq)
  WHEN 'SetOutDir' THEN CASE WHEN phase = 'PostEncode' THEN '{hooks.NO_DIR_AFTER}' WHEN arg = '' THEN '{hooks.NO_DIR}' ELSE '{hooks.DONE}' END
  WHEN 'SetPriority' THEN CASE WHEN phase <> 'OnAdd' THEN '{hooks.ONLY_ON_ADD}' WHEN coalesce(try_cast(arg AS INTEGER) BETWEEN 1 AND 5, false) THEN '{hooks.DONE}' ELSE '{hooks.OUT_OF_RANGE}' END
  WHEN 'GetOutFiles' THEN CASE WHEN phase <> 'PostEncode' THEN '{hooks.NOT_ENCODED}' ELSE concat('a', job, ';b', job) END
  ELSE CASE WHEN phase = 'PostEncode' THEN '{hooks.NO_CANCEL}' ELSE '{hooks.DONE}' END END AS reply FROM given g""",
}

"""Queries that run a stream to its end, and the string decoder; the events are cut into files that arrive one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.functions import arib
from reelmark.operators import texts
from reelmark.sources.storage import shared_folder, stored
from reelmark.sources.tables import table
from reelmark.streaming import jobs, updates

OPS = ("add", "reject", "ready", "unready", "start", "done", "fail", "cancel", "retry", "ready", "start")
FEED = "user_id long, seq long, op string, event_type string, value double"


def _feed(spark: SparkSession, sf_dir: str, parts: int = 3, files: int = 4) -> DataFrame:
    """The events as arrivals in the order of their numbers: each part is written after the one before, in some files, which make a batch."""
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "remove").otherwise("update")
    events = table(spark, sf_dir, "events").filter("user_id is not null and event_id is not null")
    folder = shared_folder(spark)
    rows = events.select("user_id", F.col("event_id").alias("seq"), op.alias("op"), "event_type", "value")
    low, high = rows.agg(F.coalesce(F.min("seq"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
    _in_parts(rows, low, high, folder, parts, files)
    return updates.files(spark, folder, FEED, files)


def _in_parts(rows: DataFrame, low: int, high: int, folder: str, parts: int, files: int) -> None:
    """Parts of the range of seq, the first written first: a reader of so many files at a time takes one part after the other."""
    part = F.floor((F.col("seq") - low) * parts / F.lit(high + 1 - low)).cast("int")
    held = stored(rows.withColumn("part", F.least(part, F.lit(parts - 1))))
    for k in range(parts):
        held.filter(F.col("part") == k).drop("part").repartition(files).write.mode("append").parquet(folder)


def stream_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that a feed leaves, kept by a stream in complete mode."""
    latest = updates.latest_rows(_feed(spark, sf_dir), "user_id", "seq")
    return updates.run_to_end(latest, "complete", "latest").filter("op <> 'remove'").select("user_id", "event_type", "value")


def stream_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of the latest events of all users, the highest value first, kept in order by a stream."""
    view = updates.live_view(_feed(spark, sf_dir), "user_id", "seq", F.col("op") == "remove", [F.col("value").desc_nulls_last(), F.col("user_id")], "sorted")
    return view.select("position", "user_id", "event_type", "value")


def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state that each user's steps lead to, by a stateful operator in update mode; event numbers stand for steps."""
    op = F.element_at(F.array(*map(F.lit, OPS)), (F.col("seq") * 7 % 31 % len(OPS) + 1).cast("int"))
    feed = _feed(spark, sf_dir).select(F.col("user_id").alias("item"), "seq", op.alias("op"))
    changed = updates.run_to_end(updates.item_states(feed), "update", "states")
    return changed.groupBy("item").agg(F.max_by(F.struct("state", "changes"), "batch").alias("last")).select("item", "last.state", "last.changes")


#: One event in so many is a change of settings.
SETTING_EVERY = 400
QUEUE_OPS = ("add", "start", "done", "fail", "cancel", "retry", "hash", "remove", "start", "add", "done")


def stream_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue that jobs and settings leave, by a stateful operator over both. Users are jobs, event numbers steps; some events set services, marks and profiles."""
    events = table(spark, sf_dir, "events").filter("user_id is not null and event_id is not null")
    j, item = F.floor(F.col("event_id") / SETTING_EVERY), F.col("user_id")
    is_setting = F.col("event_id") % SETTING_EVERY == 0
    op = F.element_at(F.array(*map(F.lit, QUEUE_OPS)), (F.col("event_id") * 7 % 31 % len(QUEUE_OPS) + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, jobs.SETTINGS)), (j % 3 + 1).cast("int"))
    whose = F.when(j % 3 == 2, F.floor(j / 3) % 4).otherwise(F.floor(j / 3) % 6)
    a = F.when(j % 3 == 1, j % 10).otherwise((F.floor(j / 7) % 4 > 0).cast("long"))
    b = F.when(j % 3 == 1, j % 10 + j % 7).otherwise(j % 2)
    rows = events.select(
        F.col("event_id").alias("seq"), F.when(is_setting, whose).otherwise(item).alias("item"), F.when(is_setting, kind).otherwise(op).alias("op"), (item % 7 - 1).alias("service"), (item % 4).alias("profile"),
        (item % 10).alias("day"), (item % 11 == 0).alias("check"), (item % 3 == 0).alias("needs_hash"), (item % 13 == 0).alias("broken"), a.cast("long").alias("a"), b.cast("long").alias("b"),
    )
    folder = shared_folder(spark)
    low, high = rows.agg(F.coalesce(F.min("seq"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
    _in_parts(rows, low, high, folder, 3, 4)
    changed = updates.run_to_end(jobs.queue_states(updates.files(spark, folder, jobs.FEED, 4)), "update", "queue")
    last = changed.groupBy("item").agg(F.max_by(F.struct("state", "reason", "changes"), "batch").alias("last")).select("item", "last.state", "last.reason", "last.changes")
    return last.filter("state <> ''")


def stream_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each glyph, counted by a stream over reports; repeated reports count once."""
    feed = _feed(spark, sf_dir).filter("event_type is not null")
    reports = feed.select((F.col("user_id") % 40).alias("glyph"), F.col("event_type").alias("path"), (F.col("seq") % 7).alias("seconds")).dropDuplicates(["glyph", "path", "seconds"])
    return updates.run_to_end(reports.groupBy("glyph").agg(F.count("*").alias("sources"), F.min("path").alias("first_path")), "complete", "glyphs").select("glyph", "sources", "first_path")


def stream_glyph_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each glyph by day, counted by a stream that keeps two days at most: repeated reports of a day count once, a day goes out when it is two days past."""
    events = table(spark, sf_dir, "events").filter("user_id is not null and event_id is not null and event_type is not null and ts is not null")
    rows = events.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 40).alias("glyph"), F.col("event_type").alias("path"), (F.col("event_id") % 7).alias("seconds"))
    folder = shared_folder(spark)
    low, high = rows.agg(F.coalesce(F.min("seq"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
    _in_parts(rows, low, high, folder, 3, 4)
    feed = updates.files(spark, folder, "seq long, ts timestamp, glyph long, path string, seconds long", 4)
    reports = feed.withWatermark("ts", "2 days").withColumn("day", F.window("ts", "1 day")).dropDuplicates(["day", "glyph", "path", "seconds"])
    counted = reports.groupBy("day", "glyph").agg(F.count("*").alias("sources"), F.min("path").alias("first_path"))
    return updates.run_to_end(counted, "append", "days").select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "glyph", "sources", "first_path")


def glyph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in one batch."""
    events = table(spark, sf_dir, "events").filter("user_id is not null and event_id is not null and event_type is not null")
    return texts.glyph_sources(events.select((F.col("user_id") % 40).alias("glyph"), F.col("event_type").alias("path"), (F.col("event_id") % 7).alias("seconds")))


def arib_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts written as broadcast strings and read back: alphanumerics behind a locking shift with sizes and colours, then kanji, hiragana
    and katakana by the part's number, a glyph that the map knows and one that it doesn't, and a repeated character."""
    words = F.split("p_name", " ")
    key = F.col("p_partkey")
    code = lambda first, n: F.unhex(F.hex((first + key % n).cast("int")))
    # Back to kanji, two of row 16; G2 is hiragana on the right half; a single shift for one of katakana; DRCS-1 to G0; a repeat of three; ASCII.
    tail = F.concat(
        F.unhex(F.lit("0F30")), code(0x21, 80), code(0xA2, 60), F.unhex(F.lit("1D")), code(0x22, 60), F.unhex(F.lit("1B28204121")), F.unhex(F.lit("22")), F.unhex(F.lit("1B284A984341"))
    )
    data = F.concat(F.unhex(F.lit("0E89")), F.encode(words[0], "utf-8"), F.unhex(F.lit("2082")), F.encode(F.coalesce(F.get(words, 1), F.lit("")), "utf-8"), tail)
    runs = table(spark, sf_dir, "part").select("p_partkey", arib.decoded(data, glyphs={"121": "☆"}).alias("runs"))
    return runs.select("p_partkey", F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("text"), F.size("runs").alias("runs"), F.array_join(F.transform("runs", lambda r: r["colour"]), ",").alias("colours"))


_GLYPHS = "SELECT glyph, count(*) AS sources, min(path) AS first_path FROM (SELECT DISTINCT user_id % 40 AS glyph, event_type AS path, event_id % 7 AS seconds FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL) GROUP BY glyph"

QUERIES = {f.__name__: f for f in (stream_updates, stream_sorted, stream_states, stream_queue, stream_glyphs, stream_glyph_days, glyph_counts, arib_decode)}
# The steps are walked one by one, all users side by side.
_WALK = f"""WITH RECURSIVE steps AS (
  SELECT user_id AS item, [{", ".join(f"'{o}'" for o in OPS)}][event_id * 7 % 31 % {len(OPS)} + 1] AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k
  FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL)
, moves(a, op, b) AS (VALUES ('', 'add', 'LogoPending'), ('', 'reject', 'PreFailed'), ('LogoPending', 'ready', 'Queue'), ('LogoPending', 'cancel', 'Canceled'), ('Queue', 'start', 'Encoding'), ('Queue', 'unready', 'LogoPending'),
  ('Queue', 'cancel', 'Canceled'), ('Queue', 'retry', 'LogoPending'), ('Encoding', 'done', 'Complete'), ('Encoding', 'fail', 'Failed'), ('Encoding', 'cancel', 'Canceled'), ('Complete', 'retry', 'LogoPending'),
  ('Failed', 'retry', 'LogoPending'), ('Canceled', 'retry', 'LogoPending'))
, walk AS (
  SELECT DISTINCT item, 0::BIGINT AS k, '' AS state, 0::BIGINT AS changes FROM steps
  UNION ALL SELECT w.item, s.k, coalesce(m.b, w.state), w.changes + if(m.b IS NULL, 0, 1) FROM walk w JOIN steps s ON s.item = w.item AND s.k = w.k + 1 LEFT JOIN moves m ON m.a = w.state AND m.op = s.op)
SELECT item, arg_max(state, k) AS state, arg_max(changes, k) AS changes FROM walk GROUP BY item"""

# Every job walks through its own steps and all settings; what is set as of each is looked up beforehand.
_QUEUE = f"""WITH RECURSIVE raw AS (SELECT event_id AS seq, user_id AS item, event_id // {SETTING_EVERY} AS j, event_id % {SETTING_EVERY} = 0 AS setting FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL)
, settings AS (
  SELECT seq, j % 3 AS kind, CASE WHEN j % 3 = 2 THEN j // 3 % 4 ELSE j // 3 % 6 END AS whose, CASE WHEN j % 3 = 1 THEN j % 10 ELSE CASE WHEN j // 7 % 4 > 0 THEN 1 ELSE 0 END END AS a,
    CASE WHEN j % 3 = 1 THEN j % 10 + j % 7 ELSE j % 2 END AS b FROM raw WHERE setting)
, spans AS (SELECT *, lead(seq, 1, 9223372036854775807) OVER (PARTITION BY kind, whose ORDER BY seq) AS next FROM settings)
, jobs AS (SELECT DISTINCT item, item % 7 - 1 AS service, item % 4 AS profile, item % 10 AS day, item % 11 = 0 AS checks, item % 3 = 0 AS needs, item % 13 = 0 AS broken FROM raw WHERE NOT setting)
, merged AS (
  SELECT item, seq, [{", ".join(f"'{o}'" for o in QUEUE_OPS)}][seq * 7 % 31 % {len(QUEUE_OPS)} + 1] AS op FROM raw WHERE NOT setting
  UNION ALL SELECT item, seq, 'setting' FROM jobs, settings)
, facts AS (
  SELECT m.*, j.* EXCLUDE (item), row_number() OVER (PARTITION BY m.item ORDER BY m.seq) AS k, coalesce(s.a, 0) = 1 AS known, coalesce(u.a <= j.day AND j.day <= u.b, false) AS usable, coalesce(p.a, 0) = 1 AS there, coalesce(p.b, 1) = 0 AS chapters
  FROM merged m JOIN jobs j USING (item)
  LEFT JOIN spans s ON s.kind = 0 AND s.whose = j.service AND m.seq >= s.seq AND m.seq < s.next
  LEFT JOIN spans u ON u.kind = 1 AND u.whose = j.service AND m.seq >= u.seq AND m.seq < u.next
  LEFT JOIN spans p ON p.kind = 2 AND p.whose = j.profile AND m.seq >= p.seq AND m.seq < p.next)
, walk(item, k, state, reason, decided, chapter, hashed, changes) AS (
  SELECT item, 0::BIGINT, '', '', false, false, false, 0::BIGINT FROM jobs
  UNION ALL
  SELECT item, k, CASE WHEN NOT looks OR held = 4 THEN s1 WHEN held > 0 THEN 'LogoPending' ELSE 'Queue' END,
    CASE WHEN NOT looks OR held IN (3.5, 4) THEN r1 WHEN held = 1 THEN '{jobs.REASONS[1]}' WHEN held = 2 THEN '{jobs.REASONS[2]}' WHEN held = 3 THEN '{jobs.REASONS[3]}' WHEN s1 = 'LogoPending' THEN '' ELSE r1 END,
    d2, c2, h1, changes + CASE WHEN CASE WHEN NOT looks OR held = 4 THEN s1 WHEN held > 0 THEN 'LogoPending' ELSE 'Queue' END <> s0 THEN 1 ELSE 0 END
  FROM (
    SELECT *, CASE WHEN checks THEN 0 WHEN NOT d2 THEN 4 WHEN service = -1 THEN 1 WHEN NOT known THEN 2 WHEN c2 AND NOT usable THEN 3 WHEN needs AND NOT h1 THEN 3.5 ELSE 0 END AS held
    FROM (
      SELECT *, d1 OR looks AND NOT checks AND there AS d2, CASE WHEN looks AND NOT checks AND NOT d1 AND there THEN chapters ELSE c1 END AS c2
      FROM (
        SELECT *, s1 IN ('LogoPending', 'Queue') AND (op IN ('setting', 'hash', 'retry') OR op = 'add' AND s0 = '') AND NOT (op = 'retry' AND s0 = '') AS looks
        FROM (
          SELECT f.*, w.state AS s0, w.changes,
            CASE WHEN op = 'add' AND w.state = '' THEN if(broken, 'PreFailed', 'LogoPending') WHEN op = 'retry' AND w.state IN ('LogoPending', 'Queue', 'Complete', 'Failed', 'Canceled') THEN 'LogoPending'
              WHEN op = 'start' AND w.state = 'Queue' THEN 'Encoding' WHEN op = 'done' AND w.state = 'Encoding' THEN 'Complete' WHEN op = 'fail' AND w.state = 'Encoding' THEN 'Failed'
              WHEN op = 'cancel' AND w.state IN ('LogoPending', 'Queue', 'Encoding') THEN 'Canceled' WHEN op = 'remove' THEN '' ELSE w.state END AS s1,
            CASE WHEN op = 'add' AND w.state = '' THEN '' ELSE w.reason END AS r1, w.decided AND NOT (op = 'add' AND w.state = '') AND NOT (op = 'retry' AND w.state IN ('LogoPending', 'Queue', 'Complete', 'Failed', 'Canceled')) AS d1,
            w.chapter AS c1, (w.hashed AND NOT (op = 'add' AND w.state = '')) OR op = 'hash' AND w.state <> '' AS h1
          FROM walk w JOIN facts f ON f.item = w.item AND f.k = w.k + 1)))))
SELECT item, arg_max(state, k) AS state, arg_max(reason, k) AS reason, arg_max(changes, k) AS changes FROM walk GROUP BY item HAVING arg_max(state, k) <> ''"""

ORACLE_SQL = {
    "stream_queue": _QUEUE,
    "stream_states": _WALK,
    "stream_updates": """SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE user_id IS NOT NULL) WHERE k = 1 AND event_type <> 'error'""",
    "stream_sorted": """SELECT row_number() OVER (ORDER BY value DESC NULLS LAST, user_id) - 1 AS position, user_id, event_type, value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE user_id IS NOT NULL) WHERE k = 1 AND event_type <> 'error'""",
    "stream_glyphs": _GLYPHS,
    "stream_glyph_days": """WITH d AS (SELECT DISTINCT date_trunc('day', ts) AS day, user_id % 40 AS glyph, event_type AS path, event_id % 7 AS seconds FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL)
SELECT strftime(day, '%Y-%m-%d') AS day, glyph, count(*) AS sources, min(path) AS first_path FROM d WHERE day + INTERVAL 3 DAY <= (SELECT max(ts) FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL) GROUP BY ALL""",
    "glyph_counts": _GLYPHS,
    # Kanji 1 to 80 of the sixteenth row by their place in the standard's own order; both kana alphabets are rows of code points.
    "arib_decode": """WITH k AS (SELECT p_partkey, p_name, p_partkey % 80 AS a, p_partkey % 60 AS b FROM part)
SELECT p_partkey, concat(p_name, '亜唖娃阿哀愛挨姶逢葵茜穐悪握渥旭葦芦鯵梓圧斡扱宛姐虻飴絢綾鮎或粟袷安庵按暗案闇鞍杏以伊位依偉囲夷委威尉惟意慰易椅為畏異移維緯胃萎衣謂違遺医井亥域育郁磯一壱溢逸稲茨'[(a + 1)::INT],
  chr((12354 + b)::INT), chr((12450 + b)::INT), '☆□AAA') AS text, 2 AS runs, 'white,green' AS colours FROM k""",
}

"""Queries over job logs, catalogue changes and dimensions; line items with their orders stand in for log rows, events for counters and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.functions import genre
from reelmark.operators import changes, joblog
from reelmark.sources.tables import table

ERROR_NAMES = ("decode-packet-failed", "unknown-pts", "no-drcs-map", "h264-pts-mismatch", "something-else", "non-continuous-pts")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_custkey")
    joined = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    seconds = F.floor("l_quantity") * 60
    return joined.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        "l_partkey",
        "l_suppkey",
        (F.col("o_orderstatus") != "F").alias("success"),
        (F.col("l_linenumber") - 1).alias("incident"),
        F.col("l_shipdate").alias("start"),
        (F.col("l_shipdate") + F.make_dt_interval(secs=(F.col("l_partkey") % 5000).cast("decimal(18,6)"))).alias("finish"),
        seconds.cast("double").alias("src_s"),
        (seconds * (1 - F.col("l_discount"))).alias("out_s"),
        F.floor(F.col("l_extendedprice") * 10000).alias("src_size"),
        F.floor(F.col("l_extendedprice") * 7000).alias("int_size"),
        F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 4000).alias("out_size"),
        F.when(F.col("l_tax") > 0.02, F.array(F.concat(F.lit("logo"), (F.col("l_suppkey") % 9).cast("string")))).otherwise(F.array().cast("array<string>")).alias("logo_files"),
        (F.col("l_partkey") % 9).cast("int").alias("output_mask"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 25).cast("string")).alias("service_name"),
        (F.col("l_suppkey") % 25).cast("int").alias("service_id"),
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_orderdate")).alias("ts_time"),
        F.array("l_returnflag", "l_linestatus").alias("tags"),
        F.when(F.col("l_linenumber") == 3, F.concat(F.lit("r"), (F.col("l_partkey") % 7).cast("string"))).alias("reason"),
        F.concat(F.lit("/rec/"), (F.col("l_suppkey") % 9).cast("string"), F.lit("/"), F.col("l_partkey").cast("string"), F.lit(".ts")).alias("src_path"),
        F.when(F.col("l_linenumber") != 5, F.slice(F.array(*[F.concat(F.lit("/out/"), F.col("l_partkey").cast("string"), F.lit(e)) for e in ("", "-1", "-2")]), 1, (F.col("l_linenumber") % 4).cast("int"))).alias("out_path"),
        *[(F.col("l_partkey") % (k + 2) == 0).alias(x) for k, x in enumerate(("chapter", "nicojk", "trim_avs"))],
        F.when(
            F.col("l_linenumber") != 4,
            F.struct(
                (F.col("l_partkey") % 1000).alias("totalsrcframes"),
                (F.col("l_partkey") % 900).alias("totaloutframes"),
                (F.col("l_partkey") % 800).alias("totaloutuniqueframes"),
                (F.col("l_suppkey") % 64 / 16).alias("notincludedper"),
                (F.col("l_suppkey") % 32 / 8).alias("avgdiff"),
                (F.col("l_suppkey") % 64 / 4).alias("maxdiff"),
                (F.col("l_partkey") % 512 / 2).alias("maxdiffpos"),
            ),
        ).alias("audio_diff"),
    )


_LOG_KEY = ["id", "line", "l_partkey", "l_suppkey"]


def log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joblog.figures(_log(spark, sf_dir))
    return out.select(*_LOG_KEY, "encode_s", "result", "not_included", "src_mib", "out_mib", "int_rate", "out_rate", "speed", "src_mbps", "out_mbps", "logo", "output", "service", "recorded", "tag_text")


def log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each service and result; sums of whole numbers, so that the order of rows doesn't matter."""
    out = joblog.figures(_log(spark, sf_dir)).groupBy("service", "result").agg(F.count("*").alias("jobs"), F.sum("src_size").alias("src_size"), F.sum("out_size").alias("out_size"), F.sum(F.col("encode_s").cast("long")).alias("encode_s"))
    return out.withColumn("rate", F.round(joblog.per_cent(F.col("out_size"), F.col("src_size")), 2))


def csv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a log export with all its fields, as they are written without quotes; a file of them is sorted by start, newest first."""
    rows = _log(spark, sf_dir)
    return rows.select(*_LOG_KEY, "start", F.concat_ws(",", *joblog.csv_fields(rows)).alias("csv"))


def log_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, flags and sound of each log row, and a check log's kind, result and day beside it."""
    out = joblog.labelled(_log(spark, sf_dir))
    kind = F.element_at(F.array(F.lit("CM"), F.lit("DRCS"), F.lit("other")), (F.col("l_partkey") % 3 + 1).cast("int"))
    return out.select(
        *_LOG_KEY, "src_dir", "src_name", "out_dir", F.array_join("out_names", ";").alias("out_names"), "out_num", "chapter_glyph", "nicojk_glyph", "trim_avs_glyph", "src_frames", "out_frames", "sound_not_included",
        "avg_diff", "max_diff", "max_diff_pos", joblog.check_text(kind).alias("check_kind"), joblog.result_mark(F.col("success"), F.lit(0)).alias("ok"), joblog.day_text(F.col("ts_time")).alias("day"),
    )


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters out of the events' documents: the name by k modulo six, the count k modulo five."""
    k = F.from_json("props", "k int")["k"]
    names = F.array(*map(F.lit, ERROR_NAMES))
    return table(spark, sf_dir, "events").select("user_id", "event_type", k.alias("k")).filter("k is not null").select("user_id", "event_type", F.element_at(names, F.col("k") % 6 + 1).alias("name"), (F.col("k") % 5).alias("count"))


def error_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = joblog.error_buckets(_errors(spark, sf_dir), ["user_id"])
    return counts.select("user_id", *joblog.BUCKETS, joblog.error_summary([F.col(b) for b in joblog.BUCKETS]).alias("summary"))


def zip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages beside their counts by position, one row each, of every event type."""
    counts = joblog.error_buckets(_errors(spark, sf_dir), ["event_type"])
    pairs = F.arrays_zip(F.array(*map(F.lit, joblog.BUCKETS)).alias("bucket"), F.array(*joblog.BUCKETS).alias("n"))
    return counts.select("event_type", F.posexplode(pairs).alias("place", "pair")).select("event_type", "place", F.col("pair.bucket").alias("bucket"), F.col("pair.n").alias("n"))


def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result documents made of events and read back: paths with subtitles, counters, sizes."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.coalesce(F.from_json("props", "k int")["k"], F.lit(0)).alias("k"))
    name = lambda text: F.concat(F.lit(text), F.col("event_id").cast("string"))
    subs = F.when(F.col("k") % 2 == 0, F.array(F.concat(name("s"), F.lit(".ass")))).otherwise(F.array().cast("array<string>"))
    document = F.to_json(
        F.struct(
            F.array(F.struct(name("o").alias("path"), subs.alias("subs")), F.struct(name("p").alias("path"), F.array().cast("array<string>").alias("subs"))).alias("outfiles"),
            F.array(F.lit(""), F.col("event_type")).alias("logofiles"),
            F.create_map(F.lit("unknown-pts"), F.col("k") % 4, F.lit("no-drcs-map"), F.col("k") % 3).alias("error"),
            (F.col("event_id") * 1000).alias("srcfilesize"),
            (F.col("event_id") * 400).alias("outfilesize"),
        )
    )
    out = joblog.from_result(e.select("event_id", document.alias("document")), "document")
    return out.select("event_id", F.array_join("out_path", ";").alias("out_path"), F.array_join("logo_files", ";").alias("logo_files"), "incident", "src_size", "out_size")


def catalogue_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in two states: some missing from each, prices raised for every thirteenth; names differ in case only."""
    part = table(spark, sf_dir, "part").withColumn("name", F.concat(F.lit("Part-"), F.col("p_partkey").cast("string")))
    old = part.filter("p_partkey % 7 <> 0").select("name", "p_retailprice", "p_size")
    price = F.when(F.col("p_partkey") % 13 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    new = part.filter("p_partkey % 11 <> 0").select(F.upper("name").alias("name"), price.alias("p_retailprice"), "p_size")
    return changes.snapshot_changes(old, new, "name", ["p_retailprice", "p_size"], ignore_case=True).select(F.lower("name").alias("name"), "change")


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "remove").otherwise("update")
    return table(spark, sf_dir, "events").filter("user_id is not null").select("user_id", F.struct("ts", "event_id").alias("seq"), op.alias("op"), "event_type", "value")


def apply_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.apply_updates(_feed(spark, sf_dir), "user_id", "seq", ["event_type", "value"])


def merge_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("event_type"), F.col("c_acctbal").alias("value"))
    return changes.merge(customers, _feed(spark, sf_dir), "user_id", "seq", ["event_type", "value"])


def genre_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' keys as nibbles of a genre, some of them extended, with the names that broadcasts give them."""
    key = F.col("c_custkey")
    nibble = lambda x: x.cast("int")
    first, second = nibble(key % 16), nibble(F.floor(key / 16) % F.when(key % 16 == genre.EXTENDED, 3).otherwise(16))
    own = genre.from_nibbles(first, second, nibble(F.floor(key / 48) % 5), nibble(F.floor(key / 7) % 16))
    codes = table(spark, sf_dir, "customer").select("c_custkey", own.alias("g"))
    return genre.with_names(codes.select("c_custkey", "g.*"), F.broadcast(genre.dimension(spark))).select("c_custkey", "space", "level1", "level2", "label")


def genre_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many customers' genres each known main genre and each of its parts includes."""
    key = F.col("c_custkey")
    items = table(spark, sf_dir, "customer").select(F.struct(F.lit(0).alias("space"), (key % 16).cast("int").alias("level1"), (F.floor(key / 16) % 16).cast("int").alias("level2")).alias("item"))
    known = genre.dimension(spark)
    groups = known.select("space", "level1", "level2").union(known.select("space", "level1", F.lit(-1)).distinct()).select(F.struct("space", "level1", "level2").alias("grp"))
    # Few genres, and their items counted before they meet.
    counted = items.groupBy("item").agg(F.count("*").alias("n"))
    met = F.broadcast(groups).join(counted, (F.col("grp.level1") == F.col("item.level1")) & genre.includes(F.col("grp"), F.col("item")))
    return met.groupBy("grp.space", "grp.level1", "grp.level2").agg(F.sum("n").alias("customers"))


_LOG = """log AS (
  SELECT l_orderkey AS id, l_linenumber AS line, l_partkey, l_suppkey, o_orderstatus <> 'F' AS success, l_linenumber - 1 AS incident, l_shipdate AS start, l_partkey % 5000 AS encode_s,
    floor(l_quantity) * 60 AS src_s, floor(l_quantity) * 60 * (1 - l_discount) AS out_s, cast(floor(l_extendedprice * 10000) AS BIGINT) AS src_size, cast(floor(l_extendedprice * 7000) AS BIGINT) AS int_size,
    cast(floor(l_extendedprice * (1 - l_discount) * 4000) AS BIGINT) AS out_size, CASE WHEN l_tax > 0.02::DOUBLE THEN concat('logo', l_suppkey % 9) ELSE 'なし' END AS logo, l_partkey % 9 AS mask,
    CASE WHEN l_linenumber <> 5 THEN least(3, l_linenumber % 4) END AS n,
    concat('S', l_suppkey % 25, '(', l_suppkey % 25, ')') AS service, l_suppkey % 25 AS service_id, CASE WHEN o_custkey % 10 <> 0 THEN o_orderdate END AS ts_time, concat(l_returnflag, ' ', l_linestatus) AS tag_text,
    CASE WHEN o_orderstatus = 'F' THEN '×' WHEN l_linenumber > 1 THEN '△' ELSE '〇' END AS result
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_DAY = "coalesce(year(ts_time) || '年' || month(ts_time) || '月' || day(ts_time) || '日', '不明')"
_ERRORS = f"""errors AS (
  SELECT user_id, event_type, [{", ".join(f"'{n}'" for n in ERROR_NAMES)}][k % 6 + 1] AS name, k % 5 AS n FROM (
    SELECT user_id, event_type, cast(json_extract(props, '$.k') AS INT) AS k FROM events) WHERE k IS NOT NULL)"""
_BUCKETS = """sum(CASE WHEN name IN ('decode-packet-failed', 'h264-pts-mismatch', 'h264-unexpected-field') THEN n ELSE 0 END) AS decode,
  sum(CASE WHEN name IN ('unknown-pts', 'non-continuous-pts') THEN n ELSE 0 END) AS time, sum(CASE WHEN name = 'no-drcs-map' THEN n ELSE 0 END) AS glyph, sum(CASE WHEN name = 'something-else' THEN n ELSE 0 END) AS other"""
_FEED = "SELECT *, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'remove' ELSE 'update' END AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE user_id IS NOT NULL"

_GENRES = f"genres(space, level1, level2, main, sub) AS (VALUES {', '.join(str(x) for x in genre.named())})"

QUERIES = {f.__name__: f for f in (log_metrics, log_labels, log_totals, csv_projection, error_buckets, zip_counts, result_documents, catalogue_diff, apply_updates, merge_updates, genre_lookup, genre_filter)}
ORACLE_SQL = {
    "log_metrics": f"""WITH {_LOG} SELECT id, line, l_partkey, l_suppkey, encode_s::DOUBLE AS encode_s, result, round(CASE WHEN src_s <> 0 THEN (src_s - out_s) / src_s * 100 END, 2) AS not_included,
  round(src_size / 1048576, 2) AS src_mib, round(out_size / 1048576, 2) AS out_mib, round(CASE WHEN src_size <> 0 THEN int_size / src_size * 100 END, 2) AS int_rate,
  round(CASE WHEN src_size <> 0 THEN out_size / src_size * 100 END, 2) AS out_rate, round(cast(CASE WHEN encode_s > 0 THEN src_s / encode_s END AS DECIMAL(18, 9)), 2)::DOUBLE AS speed,
  round(CASE WHEN src_s > 0 THEN src_size / (src_s * 131072) END, 3) AS src_mbps, round(CASE WHEN out_s > 0 THEN out_size / (out_s * 131072) END, 3) AS out_mbps, logo,
  coalesce(['通常', 'CMをカット', '通常+CMカット', 'CMのみ', '通常+CM', '本編とCMを分離', '通常+本編+CM'][mask], '通常') AS output, service, {_DAY} AS recorded, tag_text FROM log""",
    "log_labels": f"""WITH {_LOG} SELECT id, line, l_partkey, l_suppkey, concat('/rec/', l_suppkey % 9) AS src_dir, concat(l_partkey, '.ts') AS src_name,
  CASE WHEN n > 0 THEN '/out' ELSE '-' END AS out_dir, CASE WHEN n IS NOT NULL THEN array_to_string(list_transform(range(n), lambda k: concat(l_partkey, ['', '-1', '-2'][k + 1])), ';') END AS out_names,
  coalesce(n::VARCHAR, '-') AS out_num, if(l_partkey % 2 = 0, '○', '☓') AS chapter_glyph, if(l_partkey % 3 = 0, '○', '☓') AS nicojk_glyph, if(l_partkey % 4 = 0, '○', '☓') AS trim_avs_glyph,
  if(line <> 4, l_partkey % 1000, NULL) AS src_frames, if(line <> 4, l_partkey % 900, NULL) AS out_frames, if(line <> 4, round(l_suppkey % 64 / 16, 3), NULL) AS sound_not_included,
  if(line <> 4, round(l_suppkey % 32 / 8, 2), NULL) AS avg_diff, if(line <> 4, round(l_suppkey % 64 / 4, 2), NULL) AS max_diff, if(line <> 4, round(l_partkey % 512 / 2, 2), NULL) AS max_diff_pos,
  ['CM解析', 'DRCSチェック', '不明'][l_partkey % 3 + 1] AS check_kind, if(success, '〇', '×') AS ok, {_DAY} AS day FROM log""",
    "log_totals": f"""WITH {_LOG} SELECT service, result, count(*) AS jobs, sum(src_size) AS src_size, sum(out_size) AS out_size, sum(encode_s) AS encode_s,
  round(CASE WHEN sum(src_size) <> 0 THEN sum(out_size) / sum(src_size) * 100 END, 2) AS rate FROM log GROUP BY service, result""",
    "csv_projection": f"""WITH {_LOG} SELECT id, line, l_partkey, l_suppkey, start, array_to_string([result, if(line = 3, concat('r', l_partkey % 7), ''), concat('/rec/', l_suppkey % 9, '/', l_partkey, '.ts'),
  coalesce(array_to_string(list_transform(range(n), lambda k: concat('/out/', l_partkey, ['', '-1', '-2'][k + 1])), ':'), '-'), coalesce(n, 0)::VARCHAR,
  strftime(start, '%Y/%m/%d %H:%M:%S'), strftime(start + to_seconds(encode_s), '%Y/%m/%d %H:%M:%S'), encode_s::DOUBLE::VARCHAR, src_s::VARCHAR, out_s::VARCHAR, (line - 1)::VARCHAR, src_size::VARCHAR, int_size::VARCHAR, out_size::VARCHAR,
  printf('%.2f', out_size / src_size * 100),
  if(line <> 4, l_partkey % 1000, 0)::VARCHAR, if(line <> 4, l_partkey % 900, 0)::VARCHAR, if(line <> 4, l_partkey % 800, 0)::VARCHAR, if(line <> 4, (l_suppkey % 64 / 16)::VARCHAR, '0'), if(line <> 4, (l_suppkey % 32 / 8)::VARCHAR, '0'),
  if(line <> 4, (l_suppkey % 64 / 4)::VARCHAR, '0'), if(line <> 4, (l_partkey % 512 / 2)::VARCHAR, '0')], ',') AS csv FROM log""",
    "error_buckets": f"""WITH {_ERRORS}, b AS (SELECT user_id, {_BUCKETS} FROM errors GROUP BY user_id)
SELECT *, concat_ws(',', CASE WHEN decode > 0 THEN concat('デコードエラー ', decode, '件') END, CASE WHEN time > 0 THEN concat('時間処理エラー ', time, '件') END,
  CASE WHEN glyph > 0 THEN concat('DRCSマッピングのない文字 ', glyph, '件') END, CASE WHEN other > 0 THEN concat('その他のエラー ', other, '件') END) AS summary FROM b""",
    "zip_counts": f"""WITH {_ERRORS}, b AS (SELECT event_type, {_BUCKETS} FROM errors GROUP BY event_type)
SELECT event_type, p AS place, ['decode', 'time', 'glyph', 'other'][p + 1] AS bucket, [decode, time, glyph, other][p + 1] AS n FROM b, range(4) t(p)""",
    "result_documents": """WITH e AS (SELECT event_id, event_type, coalesce(cast(json_extract(props, '$.k') AS INT), 0) AS k FROM events)
SELECT event_id, concat('o', event_id, CASE WHEN k % 2 = 0 THEN concat(';s', event_id, '.ass') ELSE '' END, ';p', event_id) AS out_path, coalesce(event_type, '') AS logo_files, k % 4 + k % 3 AS incident,
  event_id * 1000 AS src_size, event_id * 400 AS out_size FROM e""",
    "catalogue_diff": """SELECT concat('part-', p_partkey) AS name, CASE WHEN p_partkey % 7 = 0 THEN 'add' WHEN p_partkey % 11 = 0 THEN 'remove' ELSE 'change' END AS change FROM part
WHERE (p_partkey % 7 = 0) <> (p_partkey % 11 = 0) OR (p_partkey % 13 = 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0)""",
    "apply_updates": f"SELECT user_id, event_type, value FROM ({_FEED}) WHERE k = 1 AND op <> 'remove'",
    "merge_updates": f"""SELECT user_id, event_type, value FROM ({_FEED}) WHERE k = 1 AND op <> 'remove'
UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)""",
    "genre_lookup": f"""WITH {_GENRES}
, n AS (SELECT c_custkey, c_custkey % 16 AS a, c_custkey // 16 % CASE WHEN c_custkey % 16 = 14 THEN 3 ELSE 16 END AS b, c_custkey // 48 % 5 AS c, c_custkey // 7 % 16 AS d FROM customer)
, c AS (SELECT c_custkey, CASE WHEN a = 14 THEN b + 1 ELSE 0 END AS space, CASE WHEN a = 14 THEN c ELSE a END AS level1, CASE WHEN a = 14 THEN d ELSE b END AS level2 FROM n)
SELECT c_custkey, space, level1, level2, CASE WHEN main IS NOT NULL THEN concat(main, ' - ', sub) ELSE concat('不明な', CASE space WHEN 0 THEN 'ARIB' WHEN 2 THEN 'CS' ELSE concat('事業者定義(', space - 1, ')') END, 'ジャンル(', level1, '-', level2, ')') END AS label
FROM c LEFT JOIN genres USING (space, level1, level2)""",
    "genre_filter": f"""WITH {_GENRES}, groups AS (SELECT space, level1, level2 FROM genres UNION SELECT space, level1, -1 FROM genres)
SELECT space, g.level1, g.level2, count(*) AS customers FROM groups g JOIN customer ON space = 0 AND g.level1 = c_custkey % 16 AND g.level2 IN (-1, c_custkey // 16 % 16) GROUP BY ALL""",
}

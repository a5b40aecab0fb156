"""Queries over names, times and text; documents, pages and conversations stand in for manifests, paths, logs and comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmark.functions import names, times
from reelmark.operators import rules, scheduling, series, texts
from reelmark.sources.storage import stored
from reelmark.sources.tables import frame_scores, table


def hash_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each source, a line for each document; names repeat, so the first line of one counts. Items of the same names are held against it."""
    # Texts are read and hashed once; what follows are digests.
    docs = stored(table(spark, sf_dir, "documents").filter("source is not null").select("doc_id", "source", F.sha2("text", 256).alias("own")))
    name = F.concat(F.lit("f"), (F.col("doc_id") % 40).cast("string"))
    line = F.when(F.col("doc_id") % 17 == 3, "short").otherwise(F.concat("own", "own", F.lit("  "), name))
    entries = texts.manifest_entries(docs.filter("own is not null").select("source", "doc_id", line.alias("line")), "source", "doc_id", "line")
    items = docs.select("doc_id", "source", F.concat(F.lit("f"), (F.col("doc_id") % 45).cast("string")).alias("name"), "own")
    found = items.join(entries, ["source", "name"], "left")
    state = F.when(F.col("digest").isNull(), "not listed").when(F.substring("digest", 1, 64) == F.col("own"), "same").otherwise("differs")
    return found.select("doc_id", "name", state.alias("state"))


def name_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped names, suffixes, swapped and folded digests and exit codes of parts."""
    part = table(spark, sf_dir, "part")
    raw = F.concat("p_name", F.lit(":"), "p_brand", F.lit("/\\?<"), "p_type", F.lit('>|*"'))
    code = F.col("p_partkey") * 7919 - 70000
    return part.select(
        "p_partkey",
        names.escaped(raw, True).alias("full"),
        names.escaped(raw, False).alias("partly"),
        names.suffix((F.col("p_partkey") * 7 % 30000).cast("int")).alias("suffix"),
        names.nibbles_swapped(F.md5("p_name")).alias("swapped"),
        names.folded_md5(F.col("p_name")).alias("folded"),
        names.is_hex(F.col("p_brand")).alias("brand_is_hex"),
        names.exit_code(code).alias("exit_code"),
    )


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.coalesce("url", F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", names.directory(path).alias("dir"), names.base_name(path).alias("base"), names.stem(path).alias("stem"), names.extension(path).alias("ext"))


def tail_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    number = F.when(key % 3 > 0, F.concat(F.lit("-"), (key % 3).cast("string"))).otherwise("")
    ending = F.element_at(F.array(*map(F.lit, (".mp4", ".ass", ".srt", ".ts.txt", ""))), (key % 5 + 1).cast("int"))
    tail = F.concat(number, F.when(key % 7 == 0, "_div2").otherwise(""), F.when(key % 2 == 0, "-cm").otherwise(""), F.when(key % 11 == 0, "-nicojk-720S").otherwise(""), ending)
    letters = F.element_at(F.array(*map(F.lit, ("vcs", "w", "all", "", "dtx"))), (key % 5 + 1).cast("int"))
    kind = names.tail_kind(F.col("tail"))
    return table(spark, sf_dir, "part").select("p_partkey", tail.alias("tail"), letters.alias("letters")).select(
        "p_partkey", "tail", kind.alias("kind"), names.wanted_kinds(F.col("letters")).alias("mask"), F.coalesce(kind.bitwiseAND(names.wanted_kinds(F.col("letters"))) != 0, F.lit(False)).alias("wanted")
    )


def time_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recordings: parsed start, slot requests for a length by value, next full hour, whether their hour pauses, durations."""
    mask = F.array(*[F.lit(h % 5 != 2) for h in range(24)])
    start = times.parsed(F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMddHHmmss")).otherwise(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")))
    end = F.col("start") + F.floor(F.col("value") * 60).cast("long")
    rows = table(spark, sf_dir, "events").filter("value is not null").select("event_id", "ts", "value", start.alias("start"))
    rows = rows.withColumn("requests", times.slot_requests(F.col("start"), end))
    return rows.select(
        "event_id",
        "start",
        F.size("requests").alias("requests"),
        F.coalesce(F.aggregate("requests", F.lit(0).cast("long"), lambda t, r: t + r["n"]), F.lit(0)).alias("slots"),
        F.get("requests", F.lit(0))["slot"].alias("first_slot"),
        F.date_format(times.next_hour(F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("next_hour"),
        times.paused(mask, F.col("ts")).alias("paused"),
        times.duration_text(F.col("value") * 1000).alias("duration"),
    )


def comment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as comments of channels, one for twenty conversations: those from a channel's first date up to, not with, its last one, in order."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null")
    comments = turns.select(F.floor(F.col("conv_id") / 20).alias("channel"), (F.col("conv_id") + F.col("turn") * 3).alias("date"), F.col("conv_id").alias("thread"), F.col("turn").alias("no"), F.concat("role", F.lit("\r\n"), "text").alias("xml"))
    channel = Window.partitionBy("channel")
    bounded = comments.filter("xml is not null").withColumns({"start": F.min("date").over(channel), "end": F.max("date").over(channel)})
    return texts.merged_comments(bounded, ["channel"], F.col("start"), F.col("end")).select("channel", "number", F.md5("line").alias("line_md5"), F.length("line").alias("chars"))


def regex_log_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyph reports written after the text of every third document, each a log line of its whole text, and read back: sources of each glyph."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    glyph = F.upper(F.substring(F.md5((F.col("doc_id") % 50).cast("string")), 1, 32))
    report = F.concat(
        F.lit("[字幕] 映像時刻"), (F.col("doc_id") % 60).cast("string"), F.lit("分"), (F.col("doc_id") % 60).cast("string"), F.lit("秒付近にマッピングのないDRCS外字があります。追加してください -> C:\\drcs/"), glyph, F.lit(".bmp")
    )
    line = F.when(F.col("doc_id") % 3 == 0, F.concat("text", report)).otherwise(F.col("text"))
    logs = docs.select(F.concat(F.lit("log"), (F.col("doc_id") % 7).cast("string")).alias("path"), F.replace(line, F.lit("\n"), F.lit(" ")).alias("line"))
    return texts.glyph_sources(texts.glyph_reports(logs, "path", "line"))


def glyph_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as glyphs, some with an image, some with a mapping, which may be empty; line items of large quantity as reports of them."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("glyph"), "p_brand", "p_name")
    images = part.filter("glyph % 3 <> 0").select("glyph", F.col("p_brand").alias("image"))
    mapping = part.filter("glyph % 4 <> 0").select("glyph", F.when(F.col("glyph") % 5 == 0, "").otherwise(F.col("p_name")).alias("text"))
    reports = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("glyph"), F.col("l_shipdate").cast("string").alias("path"), F.col("l_orderkey").alias("seconds"))
    return texts.glyph_catalogue(images, mapping, texts.glyph_sources(reports))


def console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as console output whose commas return the carriage and whose bars step back."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.translate("text", ",|", "\r\b").alias("text"))
    return texts.console_lines(docs, "doc_id", "text").select("doc_id", "number", F.md5("line").alias("line_md5"))


def console_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rolling console of 500 lines still shows of the documents of each hundred numbers, written one after another; without a number a document has no place."""
    docs = table(spark, sf_dir, "documents").filter("text is not null and doc_id is not null")
    outputs = docs.groupBy(F.floor(F.col("doc_id") / 100).alias("output")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("parts"))
    whole = outputs.select("output", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    return texts.console_lines(whole, "output", "text", 500).select("output", "number", F.md5("line").alias("line_md5"))


def section_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals written as lines and read back from them."""
    lines = texts.section_lines(series.sections(series.frame_labels(frame_scores(spark, sf_dir))))
    return texts.section_rows(lines, "line").select("series_id", "line", "is_start", "best", "start", "end")


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of orders and of line items: in either, in orders only, and both bags one after the other, counted by the key's remainder."""
    orders, items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    count = lambda df, kind: df.groupBy((F.col("key") % 10).alias("digit")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "digit", "n")
    only = orders.join(items, "key", "left_anti")
    return count(orders.union(items).distinct(), "either").unionByName(count(only, "orders only")).unionByName(count(orders.unionAll(items), "bag"))


def bit_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed resources and back, flags as masks, grouped numbers, snapped intervals and broadcast addresses of orders."""
    key = F.col("o_orderkey")
    asked = [(key % 101).cast("int"), (key % 97).cast("int"), (key % 53).cast("int")]
    packed = scheduling.packed(*asked)
    flags = F.array(*[(key % (k + 2)) == 0 for k in range(6)])
    shown = F.concat_ws(":", *[x.cast("string") for x in asked])
    numbers = names.grouped_numbers(F.concat(shown, F.lit("\r\n"), shown, F.when(key % 5 == 0, "\n 9 ").otherwise("\n\n")), 3, 2)
    ip = F.concat_ws(".", F.lit("10"), (key % 256).cast("string"), (key % 13).cast("string"), F.lit("7"))
    start, length = names.snapped((key % 999).cast("int"), (key % 77).cast("int"))
    one, two, three = scheduling.unpacked(F.col("packed"))
    return table(spark, sf_dir, "orders").select("o_orderkey", packed.alias("packed"), names.flag_mask(flags).alias("mask"), F.size(numbers).alias("groups"), F.array_join(F.get(numbers, 1), "-").alias("second_group"), names.broadcast_address(ip, F.lit("255.255.240.0")).alias("broadcast"), start.alias("snap_start"), length.alias("snap_length")).withColumn(
        "unpacked", F.concat_ws("/", one.cast("string"), two.cast("string"), three.cast("string"))
    )


def profile_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of recordings, titles and ages of their last update."""
    from reelmark.operators.joblog import age_text

    orders = table(spark, sf_dir, "orders")
    width = (F.col("o_orderkey") % 2000).cast("int")
    event = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("ev/"), F.col("o_custkey").cast("string"), F.lit("?"))).otherwise("")
    title = names.recording_title(F.col("o_orderdate"), event, F.lit("TV:1"), F.concat(F.lit("rec_"), F.col("o_orderkey").cast("string"), F.lit(".ts")))
    return orders.select("o_orderkey", rules.size_bucket(width).alias("size"), title.alias("title"), age_text((F.col("o_orderkey") * F.col("o_orderkey") % 400000).cast("double")).alias("age"))


def comment_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as XML elements and their attributes read back by path."""
    turns = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null")
    element = F.format_string("<chat thread='%d' no='%d' date='%d'>x</chat>", "conv_id", "turn", F.col("conv_id") * 60 + F.col("turn"))
    read = lambda name: F.xpath_long(F.col("xml"), F.lit(f"/chat/@{name}"))
    return turns.select(element.alias("xml")).select(read("thread").alias("thread"), read("no").alias("no"), read("date").alias("date"))


def checked_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer whether all, none or some of its orders are urgent, and how much they come to in whole units."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    groups = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and(urgent).alias("every"), F.bool_or(urgent).alias("any"), F.sum(F.floor("o_totalprice")).alias("total"))
    return groups.select("o_custkey", F.when(F.col("every"), "all").when(F.col("any"), "mixed").otherwise("none").alias("checked"), "total")


def disk_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of all destinations and of the folders in the settings, each once."""
    roots = F.array(F.lit("C:\\"), F.lit("D:\\"), F.lit("E:\\"))
    paths = table(spark, sf_dir, "orders").select(F.concat(F.element_at(roots, (F.col("o_orderkey") % 3 + 1).cast("int")), F.lit("rec\\"), "o_orderstatus").alias("path"))
    known = spark.createDataFrame([("D:\\work",), ("F:\\bin;G:\\out",)], "path string").select(F.explode(F.split("path", ";")).alias("path"))
    return paths.union(known).select(F.regexp_extract("path", r"^([A-Z]:\\)", 1).alias("root")).distinct()


_MD5_WORD = "(('0x' || substr(h, {a}, 2) || substr(h, {b}, 2) || substr(h, {c}, 2) || substr(h, {d}, 2))::BIGINT)"
_FOLDED = "xor(xor({}, {}), xor({}, {}))".format(*[_MD5_WORD.format(a=8 * k + 7, b=8 * k + 5, c=8 * k + 3, d=8 * k + 1) for k in range(4)])
_TAIL_RE = r"(-([0-9]+))?(_div([0-9]+))?(-cm)?(-nicojk-[0-9]+[ST])?(\..+)"

# Of each key the surviving lines in order (k of c): a line that follows a return or step back replaces the one before it.
_CONSOLE = """, x AS (SELECT key, regexp_extract_all(text, '[^\\n\\r\\x08]*[\\n\\r\\x08]|[^\\n\\r\\x08]+$') AS pieces FROM t)
, p AS (SELECT key, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM x)
, f AS (SELECT key, k, regexp_replace(piece, '[\\n\\r\\x08]', '') AS line, coalesce(regexp_matches(lag(piece) OVER (PARTITION BY key ORDER BY k), '[\\r\\x08]$'), false) AS replaces FROM p)
, s AS (SELECT *, coalesce(lead(replaces) OVER (PARTITION BY key ORDER BY k), false) AS gone FROM f WHERE line <> '')
, n AS (SELECT key, line, row_number() OVER (PARTITION BY key ORDER BY k) AS k, count(*) OVER (PARTITION BY key) AS c FROM s WHERE NOT gone)"""

QUERIES = {f.__name__: f for f in (hash_manifest, name_codes, path_parts, tail_class, time_slots, comment_merge, regex_log_extract, glyph_catalogue, console_lines, console_window, section_text, set_ops, bit_masks, profile_routing, comment_attributes, checked_states, disk_roots)}


def _section_sql() -> str:
    from reelmark.plans.frames import _SECTIONS

    return f"""WITH {_SECTIONS}
SELECT series_id, printf('%6d S 0 ALL %6d %6d', s_best, s_start, s_end) AS line, true AS is_start, s_best AS best, s_start AS start, s_end AS "end" FROM sections
UNION ALL SELECT series_id, printf('%6d E 0 ALL %6d %6d', e_best, e_start, e_end), false, e_best, e_start, e_end FROM sections WHERE e_best >= 0 AND e_start >= 0"""


ORACLE_SQL = {
    "hash_manifest": """WITH lines AS (
  SELECT source, doc_id, doc_id % 17 = 3 AS short, concat('f', doc_id % 40) AS name, sha256(text) AS digest, doc_id = max(doc_id) OVER (PARTITION BY source) AS is_last FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)
, entries AS (SELECT source, name, arg_min(digest, doc_id) AS digest FROM lines WHERE NOT short GROUP BY source, name)
SELECT d.doc_id, concat('f', d.doc_id % 45) AS name, CASE WHEN e.digest IS NULL THEN 'not listed' WHEN e.digest = sha256(d.text) THEN 'same' ELSE 'differs' END AS state
FROM documents d LEFT JOIN entries e ON e.source = d.source AND e.name = concat('f', d.doc_id % 45) WHERE d.source IS NOT NULL""",
    "name_codes": f"""WITH raw AS (SELECT *, concat(p_name, ':', p_brand, '/\\?<', p_type, '>|*"') AS r, md5(p_name) AS h, p_partkey * 7 % 30000 AS n, p_partkey * 7919 - 70000 AS code FROM part)
SELECT p_partkey, translate(r, '/:*?"<>|\\', '／：＊？”＜＞｜￥') AS "full", translate(r, '/:*?"<>|', '／：＊？”＜＞｜') AS partly,
  CASE WHEN n = 0 THEN '' ELSE concat('-', array_to_string(list_reverse(list_transform([k for k in range(4) if 27 ** k <= n], lambda k: chr((65 + n // (27 ** k)::BIGINT % 27 - if(n // (27 ** k)::BIGINT < 27, 1, 0))::INT))), '')) END AS suffix,
  regexp_replace(h, '(.)(.)', '\\2\\1', 'g') AS swapped, {_FOLDED} AS folded, regexp_full_match(p_brand, '[0-9A-Fa-f]+') AS brand_is_hex,
  CASE WHEN abs(code) < 65536 THEN code::VARCHAR ELSE concat('0x', lower(to_hex(CASE WHEN code < 0 THEN code + 4294967296 ELSE code END))) END AS exit_code FROM raw""",
    "path_parts": r"""WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages), b AS (SELECT *, regexp_extract(u, '([^/\\]*)$', 1) AS base FROM p)
SELECT page_id, regexp_extract(u, '^(.*)[/\\][^/\\]*$', 1) AS dir, base, regexp_replace(base, '\.[^.]*$', '') AS stem, lower(regexp_extract(base, '(\.[^.]*)$', 1)) AS ext FROM b""",
    "tail_class": rf"""WITH t AS (
  SELECT p_partkey, concat(CASE WHEN p_partkey % 3 > 0 THEN concat('-', p_partkey % 3) ELSE '' END, CASE WHEN p_partkey % 7 = 0 THEN '_div2' ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN '-cm' ELSE '' END,
    CASE WHEN p_partkey % 11 = 0 THEN '-nicojk-720S' ELSE '' END, ['.mp4', '.ass', '.srt', '.ts.txt', ''][p_partkey % 5 + 1]) AS tail, [7, 8, 255, 255, 48][p_partkey % 5 + 1] AS mask FROM part)
, k AS (SELECT *, CASE WHEN regexp_matches(tail, '{_TAIL_RE}') THEN (CASE WHEN regexp_extract(tail, '{_TAIL_RE}', 7) IN ('.ass', '.srt') THEN 4 WHEN regexp_extract(tail, '{_TAIL_RE}', 5) <> '' THEN 2 ELSE 1 END)
    * CASE WHEN coalesce(try_cast(regexp_extract(tail, '{_TAIL_RE}', 2) AS INT), 0) = 0 THEN 1 ELSE 8 END END AS kind FROM t)
SELECT p_partkey, tail, kind, mask, coalesce((kind & mask) <> 0, false) AS wanted FROM k""",
    "time_slots": """WITH e AS (SELECT *, cast(floor(epoch(ts)) AS BIGINT) AS start, cast(floor(value * 60) AS BIGINT) AS len FROM events WHERE value IS NOT NULL)
, s AS (SELECT *, start // 300 AS a, cast(floor((start + len + 299) / 300) AS BIGINT) AS b FROM e)
SELECT event_id, start, CASE WHEN b > a THEN (b - a + 7) // 8 ELSE 0 END AS requests, greatest(b - a, 0) AS slots, CASE WHEN b > a THEN a END AS first_slot,
  strftime(date_trunc('hour', ts + INTERVAL 60 MINUTE), '%Y-%m-%d %H:%M:%S') AS next_hour, hour(ts) % 5 = 2 AS paused,
  format('{}時間{:02d}分{:02d}秒', cast(floor(value * 1000) AS BIGINT) // 3600, cast(floor(value * 1000) AS BIGINT) // 60 % 60, cast(floor(value * 1000) AS BIGINT) % 60) AS duration FROM s""",
    "comment_merge": """WITH c AS (SELECT cast(floor(conv_id / 20) AS BIGINT) AS channel, conv_id + turn * 3 AS date, conv_id AS thread, turn AS no, concat(role, chr(13), chr(10), text) AS xml FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)
, l AS (SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY date, thread, no, xml) AS number, replace(replace(xml, chr(13), '&#13;'), chr(10), '&#10;') AS line FROM c WHERE date < (SELECT max(date) FROM c o WHERE o.channel = c.channel))
SELECT channel, number, md5(line) AS line_md5, length(line) AS chars FROM l""",
    "regex_log_extract": """WITH r AS (SELECT DISTINCT upper(md5((doc_id % 50)::VARCHAR)) AS glyph, concat('log', doc_id % 7) AS path, doc_id % 60 * 61 AS seconds FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0)
SELECT glyph, count(*) AS sources, min(path) AS first_path FROM r GROUP BY glyph""",
    "console_lines": f"""WITH t AS (SELECT doc_id AS key, translate(text, ',|', chr(13) || chr(8)) AS text FROM documents WHERE text IS NOT NULL)
{_CONSOLE}
SELECT key AS doc_id, k - 1 AS number, md5(line) AS line_md5 FROM n""",
    "glyph_catalogue": """WITH r AS (SELECT l_partkey AS glyph, count(DISTINCT (l_shipdate, l_orderkey)) AS sources FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey)
SELECT p_partkey AS glyph, if(p_partkey % 3 <> 0, p_brand, NULL) AS image, CASE WHEN p_partkey % 4 <> 0 THEN if(p_partkey % 5 = 0, '', p_name) END AS text, coalesce(sources, 0) AS sources,
  p_partkey % 4 = 0 OR p_partkey % 5 = 0 OR p_name = '' AS unmapped FROM part LEFT JOIN r ON glyph = p_partkey WHERE p_partkey % 3 <> 0 OR p_partkey % 4 <> 0""",
    "console_window": f"""WITH t AS (SELECT doc_id // 100 AS key, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL)
{_CONSOLE}
, w AS (SELECT *, cast(ceil(greatest(0, c - 501) / 100) AS BIGINT) * 100 AS gone FROM n)
SELECT key AS output, k - gone - 1 AS number, md5(line) AS line_md5 FROM w WHERE k > gone""",
    "section_text": _section_sql(),
    "set_ops": """SELECT 'either' AS kind, key % 10 AS digit, count(*) AS n FROM (SELECT o_orderkey AS key FROM orders UNION SELECT l_orderkey FROM lineitem) GROUP BY ALL
UNION ALL SELECT 'orders only', o_orderkey % 10, count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY ALL
UNION ALL SELECT 'bag', key % 10, count(*) FROM (SELECT o_orderkey AS key FROM orders UNION ALL SELECT l_orderkey FROM lineitem) GROUP BY ALL""",
    "bit_masks": """WITH o AS (SELECT o_orderkey, o_orderkey % 101 AS a, o_orderkey % 97 AS b, o_orderkey % 53 AS c FROM orders)
SELECT o_orderkey, a * 65536 + b * 256 + c AS packed, (SELECT sum(CASE WHEN o_orderkey % (k + 2) = 0 THEN 2 ** k ELSE 0 END)::BIGINT FROM range(6) t(k)) AS mask, CASE WHEN o_orderkey % 5 <> 0 THEN 2 END AS groups, CASE WHEN o_orderkey % 5 <> 0 THEN concat(a, '-', b, '-', c) END AS second_group,
  concat('10.', o_orderkey % 256, '.15.255') AS broadcast, o_orderkey % 999 // 2 * 2 AS snap_start, (o_orderkey % 77 + 1) // 2 * 2 AS snap_length, concat(a, '/', b, '/', c) AS unpacked FROM o""",
    "comment_attributes": "SELECT conv_id AS thread, turn AS no, conv_id * 60 + turn AS date FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL",
    "checked_states": """SELECT o_custkey, CASE WHEN bool_and(o_orderpriority = '1-URGENT') THEN 'all' WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'mixed' ELSE 'none' END AS checked, sum(cast(floor(o_totalprice) AS BIGINT)) AS total FROM orders GROUP BY o_custkey""",
    "disk_roots": """SELECT DISTINCT ['C:\\', 'D:\\', 'E:\\'][o_orderkey % 3 + 1] AS root FROM orders UNION SELECT unnest(['D:\\', 'F:\\', 'G:\\'])""",
    "profile_routing": """WITH o AS (SELECT *, o_orderkey % 2000 AS w, o_orderkey * o_orderkey % 400000 AS s FROM orders)
SELECT o_orderkey, CASE WHEN w > 1440 THEN 'FullHD' WHEN w > 720 THEN 'HD1440' WHEN w > 320 THEN 'SD' ELSE 'OneSeg' END AS size,
  CASE WHEN o_orderkey % 4 <> 0 AND o_orderdate > TIMESTAMP '2000-01-01' THEN concat(strftime(o_orderdate, '%Y%m%d%H%M'), '_ev／', o_custkey, '？ _TV：1.ts') ELSE concat('rec_', o_orderkey, '.ts') END AS title,
  CASE WHEN s <= 60 THEN concat(s, ' s') WHEN s <= 3600 THEN concat(s // 60, ' min') WHEN s <= 86400 THEN concat(s // 3600, ' h') ELSE concat(s // 86400, ' d') END AS age FROM o""",
}

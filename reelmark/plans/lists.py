"""Queries over documents of open form, client lists and named filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.functions import documents
from reelmark.functions.arrays import total
from reelmark.operators import filters, lists, pixels, texts
from reelmark.plans.pixels import HEIGHT, WIDTH, pictures
from reelmark.sources.tables import table

#: The number of the update that was noticed last.
NOTICED = 1000


def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents whose members depend on their type: names, what is defined, values at paths, and what is left without a member."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    more = F.when(kind == "click", F.concat(F.lit(',"pos":{"at":['), k, F.lit(",7]}"))).when(kind == "error", ',"text":null').otherwise("")
    d = e.filter("props is not null").select("event_id", F.concat(F.lit('{"k":'), k, more, F.lit("}")).alias("d"))
    doc = F.col("d")
    return d.select(
        "event_id",
        F.array_join(documents.member_names(doc), ",").alias("names"),
        documents.is_defined(doc, "text").alias("has_text"),
        documents.member(doc, "$.pos.at[0]", "long").alias("at"),
        documents.without(doc, "pos").alias("rest"),
    )


def sorted_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders sorted by their price, after two clicks on it: the highest first."""
    once = lists.toggled(None, "o_totalprice")
    return lists.sorted_view(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), lists.toggled(once, "o_totalprice"))


def confirm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a customer's finished orders would be asked about."""
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".ts")).alias("name"))
    return lists.confirmation(done, ["o_custkey"], "o_orderkey", "name")


def packet_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.packet_sizes(table(spark, sf_dir, "conversations"), ["conv_id"], F.col("text"))


def glyph_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs with an image whose sources changed since an update. Event numbers are updates, users glyphs, types paths; glyphs of parts have images."""
    events = table(spark, sf_dir, "events").filter("user_id is not null and event_type is not null")
    reports = events.select((F.col("user_id") % 400).alias("glyph"), F.col("event_type").alias("path"), (F.col("event_id") % 7).alias("seconds"), "event_id")
    return texts.updated_glyphs(table(spark, sf_dir, "part").select((F.col("p_partkey") % 350).alias("glyph")), reports, "event_id", NOTICED)


def filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures through a main filter, the erasing of a plain mark, and a post filter, all chosen by name."""
    known = filters.Filters()
    known.add(f"{filters.MAIN}smooth", lambda f: f.withColumn("v", pixels.smoothed_down(F.col("v"), WIDTH, HEIGHT, 2)))
    known.add(f"{filters.MAIN}none", lambda f: f)
    known.add(f"{filters.POST}invert", lambda f: f.withColumn("v", F.transform("v", lambda v: 255 - v)))
    erase = lambda f: f.withColumn("v", F.transform("v", lambda v: pixels.restored(v, F.lit(1.25), F.lit(-0.125), 255.0, F.lit(1.0))))
    out = known.run(pictures(spark, sf_dir), known.names(filters.MAIN)[-1], known.names(filters.POST)[0], erase)
    return out.select("vec_id", total(F.transform("v", lambda v: v.cast("double"))).alias("total"), F.array_max("v").alias("most"))


QUERIES = {f.__name__: f for f in (json_members, sorted_view, confirm_text, packet_sizes, glyph_delta, filter_chain)}
_V = "list_transform(embedding, lambda e: greatest(0.0::DOUBLE, least(255.0::DOUBLE, floor((e::DOUBLE + 0.5) * 256))))"
ORACLE_SQL = {
    "json_members": """WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events WHERE props IS NOT NULL)
SELECT event_id, CASE event_type WHEN 'click' THEN 'k,pos' WHEN 'error' THEN 'k,text' ELSE 'k' END AS names, event_type = 'error' AS has_text, CASE WHEN event_type = 'click' THEN k::BIGINT END AS at,
  '{"k":' || k || CASE WHEN event_type = 'error' THEN ',"text":null' ELSE '' END || '}' AS rest FROM e""",
    "sorted_view": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC",
    "confirm_text": """SELECT o_custkey, string_agg('o' || o_orderkey || '.ts', chr(13) || chr(10) ORDER BY o_orderkey) FILTER (k <= 10) || CASE WHEN count(*) > 10 THEN chr(13) || chr(10) || chr(13) || chr(10) || '他' || (count(*) - 10) || '個' ELSE '' END AS text
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F') GROUP BY o_custkey""",
    "packet_sizes": "SELECT conv_id, coalesce(sum(strlen(text)), 0) AS plain, coalesce(sum(strlen(text)), 0) + 4 * count(*) AS chunked FROM conversations GROUP BY conv_id",
    "glyph_delta": f"""SELECT glyph, count(*) AS sources, max(since) AS last_update FROM (
  SELECT user_id % 400 AS glyph, event_type, event_id % 7 AS seconds, min(event_id) AS since FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL)
WHERE glyph IN (SELECT p_partkey % 350 FROM part) GROUP BY glyph HAVING max(since) >= {NOTICED}""",
    "filter_chain": f"""WITH raw AS (SELECT vec_id, i, ({_V})[i + 1] AS v FROM embeddings, range({WIDTH * HEIGHT}) t(i) WHERE embedding IS NOT NULL)
, smooth AS (SELECT vec_id, CASE WHEN i < {WIDTH} OR i >= {WIDTH * (HEIGHT - 1)} THEN v ELSE (lag(v) OVER w + 2 * v + lead(v) OVER w + 2) / 4 END AS v FROM raw WINDOW w AS (PARTITION BY vec_id, i % {WIDTH} ORDER BY i))
SELECT vec_id, sum(o) AS total, max(o) AS most FROM (SELECT vec_id, 255 - floor(greatest(0.0, least(255.0, v * 1.25::DOUBLE - 0.125::DOUBLE * 255 + 0.5))) AS o FROM smooth) GROUP BY vec_id""",
}

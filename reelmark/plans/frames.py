"""Queries over frame series; events stand in for frames, one series per user, at 30 frames a second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.operators import series
from reelmark.sources.tables import frame_scores, table


def logo_frame_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = series.frame_labels(frame_scores(spark, sf_dir))
    return labels.select("series_id", "n", F.round("score", 6).alias("score"), "label")


def logo_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.sections(series.frame_labels(frame_scores(spark, sf_dir)))


def section_to_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = frame_scores(spark, sf_dir)
    return series.section_labels(frames, series.sections(series.frame_labels(frames)))


def fade_constancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = frame_scores(spark, sf_dir)
    labels = series.frame_labels(frames).select("series_id", "n", "label")
    level = F.floor((F.col("corr0") + F.col("corr1") + 1) * 5).cast("int")
    kinds = series.fade_kind(frames.select("series_id", "n", level.alias("level"))).select("series_id", "n", "level", "abrupt")
    fixed = series.clamped_constancy(labels, 16 >> 1)
    return fixed.join(kinds, ["series_id", "n"]).select("series_id", "n", "fixed", F.when(F.col("fixed").isNull(), F.col("abrupt")).alias("abrupt"), "level")


def field_fades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fades of both fields of each frame: their levels lie beside the frame's, by its number."""
    frames = frame_scores(spark, sf_dir)
    level = F.floor((F.col("corr0") + F.col("corr1") + 1) * 5).cast("int")
    near = lambda step: F.greatest(F.lit(0), F.least(F.lit(10), F.col("level") + (F.col("n") % step).cast("int") - 1))
    levels = frames.select("series_id", "n", level.alias("level")).withColumns({"top": near(3), "bottom": near(4)})
    kinds = series.fade_kind(levels.select("series_id", "n", "level"))
    return series.fades(frames, series.analysed(levels), kinds)


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("user_id is not null and event_type is not null and value is not null")
    raw = (F.col("value") - 50.0) / 50.0
    evaluated = events.select(F.col("user_id").alias("series_id"), F.col("event_type").alias("logo"), raw.alias("corr0"), (raw / 4).alias("corr1"))
    best = series.best_candidate(series.candidate_scores(evaluated))
    return best.select("series_id", "logo", F.round("score", 6).alias("score"), F.round("ratio", 6).alias("ratio"))


def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("user_id is not null and event_type is not null and value is not null")
    raw = (F.col("value") - 50.0) / 50.0
    evaluated = events.select(F.lit(0).cast("long").alias("series_id"), F.col("event_type").alias("logo"), raw.alias("corr0"), (raw / 4).alias("corr1"))
    return series.candidate_scores(evaluated).select("logo", "detected", "frames", F.round("score", 6).alias("score"))


_FRAMES = """frames AS (
  SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n,
    greatest(0.0::DOUBLE, (coalesce(value, 50.0) - 50.0) / 50.0) AS corr0, least(0.0::DOUBLE, (coalesce(value, 50.0) - 50.0) / 50.0) AS corr1
  FROM events WHERE user_id IS NOT NULL)"""
_LABELS = (
    _FRAMES
    + """
, counted AS (SELECT series_id, n, corr0 + corr1 AS raw, max(n) OVER (PARTITION BY series_id) AS last_n FROM frames)
, padded AS (
  SELECT series_id, raw, last_n, unnest(range(CASE WHEN n = 0 THEN -15 ELSE n END, CASE WHEN n = last_n THEN n + 16 ELSE n + 1 END)) AS n FROM counted)
, smooth AS (
  SELECT series_id, n, last_n,
    least(max(raw) OVER (PARTITION BY series_id ORDER BY n ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING),
          max(raw) OVER (PARTITION BY series_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING)) AS mm,
    round(avg(raw) OVER (PARTITION BY series_id ORDER BY n ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING), 9) AS av,
    quantile_disc(raw, 0.5) OVER (PARTITION BY series_id ORDER BY n ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS score
  FROM padded)
, seen AS (
  SELECT series_id, n, score, CASE WHEN a = b THEN a ELSE 1 END AS seen FROM (
    SELECT *, CASE WHEN abs(mm) < 0.5 THEN 1 WHEN mm < 0 THEN 0 ELSE 2 END AS a, CASE WHEN abs(av) < 0.2 THEN 1 WHEN av < 0 THEN 0 ELSE 2 END AS b
    FROM smooth WHERE n >= 0 AND n <= last_n))
, labels AS (
  SELECT series_id, n, score, CASE WHEN p = q THEN p ELSE seen END AS label FROM (
    SELECT *, coalesce(last_value(nullif(seen, 1) IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS p,
      coalesce(first_value(nullif(seen, 1) IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS q
    FROM seen))"""
)
# The searches are written as correlated subqueries, as a procedure would run them, unlike the running windows of the query.
_SECTIONS = (
    _LABELS
    + """
, latched AS (
  SELECT series_id, n, score, count(*) OVER (PARTITION BY series_id) AS total,
    coalesce(last_value(nullif(label, 1) IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st
  FROM labels)
, edges AS (
  SELECT * FROM (SELECT *, coalesce(lag(st) OVER (PARTITION BY series_id ORDER BY n), 0) AS was FROM latched) WHERE st <> was)
, opened AS (
  SELECT series_id, total, n AS s0, coalesce(lead(n) OVER w, total) AS e0, coalesce(lag(n) OVER w, 0) AS it, st FROM edges WINDOW w AS (PARTITION BY series_id ORDER BY n))
, s1 AS (
  SELECT o.*, CASE WHEN (SELECT score FROM latched f WHERE f.series_id = o.series_id AND f.n = o.s0) >= 0.2
      THEN coalesce((SELECT max(f.n) + 1 FROM latched f WHERE f.series_id = o.series_id AND f.n < o.s0 AND f.score < 0.2), 0)
      ELSE coalesce((SELECT min(f.n) FROM latched f WHERE f.series_id = o.series_id AND f.n >= o.s0 AND f.score >= 0.2), o.total) END AS s_end
  FROM opened o WHERE st = 2)
, s2 AS (
  SELECT o.*, CASE WHEN e0 = total THEN total
      WHEN (SELECT score FROM latched f WHERE f.series_id = o.series_id AND f.n = o.e0) <= -0.2
      THEN coalesce((SELECT max(f.n) + 1 FROM latched f WHERE f.series_id = o.series_id AND f.n >= o.s_end AND f.n < o.e0 AND f.score > -0.2), o.s_end)
      ELSE coalesce((SELECT min(f.n) FROM latched f WHERE f.series_id = o.series_id AND f.n >= o.e0 AND f.score <= -0.2), o.total) END AS e_end
  FROM s1 o)
, s3 AS (
  SELECT o.*, coalesce((SELECT max(f.n) + 1 FROM latched f WHERE f.series_id = o.series_id AND f.n >= o.it AND f.n < o.s_end AND f.score <= -0.2), o.it) AS s_start,
    coalesce((SELECT max(f.n) + 1 FROM latched f WHERE f.series_id = o.series_id AND f.n >= o.s_end AND f.n < o.e_end AND f.score >= 0.2), o.s_end) AS e_from
  FROM s2 o)
, sections AS (
  SELECT o.series_id, coalesce((SELECT min(f.n) FROM latched f WHERE f.series_id = o.series_id AND f.n >= o.s_start AND f.n < o.s_end AND f.score > 0), o.s_end) AS s_best,
    s_start, s_end,
    coalesce((SELECT max(f.n) + 1 FROM latched f WHERE f.series_id = o.series_id AND f.n >= o.e_from AND f.n < o.e_end AND f.score > 0), o.e_from) - 1 AS e_best,
    e_from - 1 AS e_start, e_end - 1 AS e_end
  FROM s3 o WHERE s_end <> e_end)"""
)
_CANDIDATES = """
, summary AS (
  SELECT series_id, logo, count(*) FILTER (corr0 > 0.2 AND abs(corr1) < 0.2) AS detected, count(*) AS frames,
    sum(abs(corr1)) FILTER (corr0 > 0.2 AND abs(corr1) < 0.2) AS cost FROM evaluated GROUP BY series_id, logo)
, scored AS (SELECT *, CASE WHEN detected > 0 THEN cost / detected * (frames / detected) END AS score FROM summary)"""

QUERIES = {f.__name__: f for f in (logo_frame_labels, logo_sections, section_to_frames, fade_constancy, field_fades, best_candidate, candidate_summary)}
ORACLE_SQL = {
    "logo_frame_labels": f"WITH {_LABELS} SELECT series_id, n, round(score, 6) AS score, label FROM labels",
    "logo_sections": f"WITH {_SECTIONS} SELECT * FROM sections",
    "section_to_frames": f"""WITH {_SECTIONS}
, numbered AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY s_start, s_end) AS k FROM sections)
, parts AS (
  SELECT series_id, k * 3 AS turn, s_start AS a, s_end AS b, 1 AS label FROM numbered
  UNION ALL SELECT series_id, k * 3 + 1, s_end, e_start, 2 FROM numbered UNION ALL SELECT series_id, k * 3 + 2, e_start + 1, e_end, 1 FROM numbered)
SELECT f.series_id, f.n, coalesce(arg_max(p.label, p.turn), 0) AS label
FROM frames f LEFT JOIN parts p ON p.series_id = f.series_id AND f.n BETWEEN p.a AND p.b GROUP BY f.series_id, f.n""",
    "fade_constancy": f"""WITH {_LABELS}
, fixed AS (
  SELECT series_id, n, CASE WHEN min(label) OVER w = max(label) OVER w THEN CASE WHEN label = 2 THEN 1 ELSE 0 END END AS fixed
  FROM labels WINDOW w AS (PARTITION BY series_id ORDER BY n ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING))
, levels AS (SELECT series_id, n, cast(floor((corr0 + corr1 + 1) * 5) AS INT) AS level FROM frames)
, near AS (
  SELECT l.series_id, l.n, any_value(l.level) AS level, round(avg(o.level) FILTER (k < 0) / 10, 9) AS bef, round(avg(o.level) FILTER (k > 0) / 10, 9) AS aft
  FROM (SELECT *, max(n) OVER (PARTITION BY series_id) AS last_n FROM levels) l, range(-4, 5) r(k), levels o
  WHERE k <> 0 AND o.series_id = l.series_id AND o.n = greatest(0, least(l.last_n, l.n + k)) GROUP BY l.series_id, l.n)
SELECT series_id, n, fixed, CASE WHEN fixed IS NULL THEN (bef < 0.3 AND aft > 0.7) OR (bef > 0.7 AND aft < 0.3) END AS abrupt, level FROM fixed JOIN near USING (series_id, n)""",
    "field_fades": f"""WITH {_FRAMES}
, levels AS (SELECT series_id, n, cast(floor((corr0 + corr1 + 1) * 5) AS INT) AS level, max(n) OVER (PARTITION BY series_id) AS last_n FROM frames)
, near AS (
  SELECT l.series_id, l.n, any_value(l.level) AS level, round(avg(o.level) FILTER (k < 0) / 10, 9) AS bef, round(avg(o.level) FILTER (k > 0) / 10, 9) AS aft
  FROM levels l, range(-4, 5) r(k), levels o WHERE k <> 0 AND o.series_id = l.series_id AND o.n = greatest(0, least(l.last_n, l.n + k)) GROUP BY l.series_id, l.n)
, abrupt AS (SELECT *, (bef < 0.3 AND aft > 0.7) OR (bef > 0.7 AND aft < 0.3) AS is_abrupt FROM near)
SELECT series_id, n, CASE WHEN is_abrupt THEN greatest(0, least(10, level + n % 3 - 1)) ELSE level END / 10 AS fade_top,
  CASE WHEN is_abrupt THEN greatest(0, least(10, level + n % 4 - 1)) ELSE level END / 10 AS fade_bottom FROM abrupt""",
    "best_candidate": f"""WITH evaluated AS (
  SELECT user_id AS series_id, event_type AS logo, (value - 50.0) / 50.0 AS corr0, (value - 50.0) / 50.0 / 4 AS corr1
  FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL){_CANDIDATES}
SELECT series_id, logo, round(score, 6) AS score, round(detected / frames, 6) AS ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score IS NULL, score, logo) AS k FROM scored) WHERE k = 1""",
    "candidate_summary": f"""WITH evaluated AS (
  SELECT 0 AS series_id, event_type AS logo, (value - 50.0) / 50.0 AS corr0, (value - 50.0) / 50.0 / 4 AS corr1
  FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL){_CANDIDATES}
SELECT logo, detected, frames, round(score, 6) AS score FROM scored""",
}

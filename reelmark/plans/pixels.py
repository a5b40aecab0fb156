"""Queries over pixel samples; embeddings stand in for 8 x 8 pictures, line items for pairs of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.operators import pixels, series
from reelmark.sources.tables import table

WIDTH = HEIGHT = 8
MASK_RATIO = 0.35


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, v): samples of 0 to 255."""
    grey = F.transform("embedding", lambda e: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((e.cast("double") + 0.5) * 256))))
    return table(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", "label", grey.cast("array<double>").alias("v"))


def symmetric_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("f"), (F.col("l_extendedprice") / 1000).alias("b"))
    return pixels.symmetric_fit(points, ["l_suppkey"]).select("l_suppkey", "n", F.round("a", 5).alias("a"), F.round("b", 4).alias("b"))


def middle_half_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor("l_quantity").cast("long").alias("v"))
    return pixels.middle_half_mean(samples, ["l_orderkey"], 24)


def border_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as border samples of three planes of their order's frame."""
    samples = table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor("l_quantity").alias("y"), F.round(F.col("l_discount") * 100).alias("u"), F.round(F.col("l_tax") * 100).alias("v"))
    return pixels.uniform_planes(samples, ["l_orderkey"], ["y", "u", "v"], 6)


def field_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fields of each picture, and the colour fields of one that starts at an odd row: number and sum of their samples."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    fields = {f"{name}{bottom}": pixels.field_of(F.col("v"), WIDTH, bottom, offset) for name, offset in (("luma", 0), ("colour", 5)) for bottom in (0, 1)}
    return pictures(spark, sf_dir).select("vec_id", F.size(fields["luma0"]).alias("size"), *[total(a).alias(name) for name, a in fields.items()])


def spatial_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    smooth = pictures(spark, sf_dir).select("vec_id", F.posexplode(pixels.smoothed_down(F.col("v"), WIDTH, HEIGHT)).alias("i", "v"))
    return smooth.select("vec_id", (F.col("i") % WIDTH).alias("x"), F.floor(F.col("i") / WIDTH).cast("int").alias("y"), "v")


def fade_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label how often which of 20 fades fits best, and whether that is the most frequent one (the lowest on ties). What is left after a fade is the sum of every 20th sample."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    left = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: total(F.filter("v", lambda v, i: i % 20 == k)))
    best = pictures(spark, sf_dir).select("label", series.first_minimum(left).alias("fade"))
    counts = best.groupBy("label", "fade").agg(F.count("*").alias("frames"))
    modes = counts.groupBy("label").agg(F.max_by("fade", F.struct("frames", -F.col("fade"))).alias("mode"))
    return counts.join(modes, "label").select("label", "fade", "frames", (F.col("fade") == F.col("mode")).alias("is_mode"))


def top_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    variance = pixels.local_variances(F.col("v"), WIDTH, HEIGHT)
    ranked = pictures(spark, sf_dir).select("vec_id", variance.alias("s")).select("vec_id", "s", F.posexplode(pixels.top_pixels(F.col("s"), MASK_RATIO, WIDTH * HEIGHT)).alias("rank", "pixel"))
    return ranked.select("vec_id", "rank", "pixel", F.round(F.element_at("s", F.col("pixel") + 1), 3).alias("variance"))


def local_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture against a centred ramp as kernel: sum of clipped scores over the inner pixels, strong ones at full weight."""
    kernel = F.array(*[F.lit(float(k % 5 - 2)) for k in range(25)])
    inner = [i for i in range(WIDTH * HEIGHT) if 2 <= i % WIDTH < WIDTH - 2 and 2 <= i // WIDTH < HEIGHT - 2]
    scores = F.transform(F.array(*map(F.lit, inner)), lambda i: pixels.correlation(kernel, pixels.neighbourhood(F.col("v"), i, WIDTH)) / 500)
    weighted = F.transform(scores, lambda s: pixels.correlation_score(s, F.least(F.lit(1.0), F.abs(s) / 0.2)))
    return pictures(spark, sf_dir).select("vec_id", F.round(F.aggregate(weighted, F.lit(0.0), lambda t, x: t + x), 6).alias("score"))


def affine_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = pictures(spark, sf_dir).select("vec_id", F.posexplode("v").alias("i", "v"))
    a, b = 1 + F.col("i") % 4 / F.lit(16.0), -(F.col("i") % 3) / F.lit(32.0)
    out = samples.select("vec_id", "i", pixels.restored(F.col("v"), a, b, 255.0, (F.col("i") % 5) / F.lit(4.0)).alias("v"), pixels.cover_distance(a, b).alias("d"))
    return out.groupBy("vec_id").agg(F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.sum("d") * 1000, 6).alias("distance"))


_PICTURES = f"""pictures AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: greatest(0.0::DOUBLE, least(255.0::DOUBLE, floor((e::DOUBLE + 0.5) * 256)))) AS v FROM embeddings WHERE embedding IS NOT NULL)
, pixels AS (SELECT vec_id, label, i, i % {WIDTH} AS x, i // {WIDTH} AS y, v[i + 1] AS v FROM pictures, range({WIDTH * HEIGHT}) t(i))"""
_INNER = f"a.x BETWEEN 2 AND {WIDTH - 3} AND a.y BETWEEN 2 AND {HEIGHT - 3}"
_NEAR = "p.vec_id = a.vec_id AND p.x BETWEEN a.x - 2 AND a.x + 2 AND p.y BETWEEN a.y - 2 AND a.y + 2"

QUERIES = {f.__name__: f for f in (symmetric_fit, middle_half_mean, border_planes, field_split, spatial_smooth, fade_mode, top_pixels, local_correlation, affine_restore)}
ORACLE_SQL = {
    "symmetric_fit": """SELECT l_suppkey, n, round(a, 5) AS a, round(b, 4) AS b FROM (
  SELECT l_suppkey, count(*) AS n, (regr_slope(b, f) + 1 / nullif(regr_slope(f, b), 0)) / 2 AS a,
    (regr_intercept(b, f) - regr_intercept(f, b) / nullif(regr_slope(f, b), 0)) / 2 AS b
  FROM (SELECT l_suppkey, l_quantity AS f, l_extendedprice / 1000 AS b FROM lineitem) GROUP BY l_suppkey) WHERE a IS NOT NULL AND a <> 0 AND NOT isnan(a) AND NOT isnan(b)""",
    "middle_half_mean": """WITH ranked AS (
  SELECT l_orderkey, cast(floor(l_quantity) AS BIGINT) AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_quantity)) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
, s AS (
  SELECT l_orderkey, n, max(v) - min(v) AS spread, sum(v) FILTER (k >= n // 4 AND k < n - n // 4) AS total, count(*) FILTER (k >= n // 4 AND k < n - n // 4) AS taken FROM ranked GROUP BY l_orderkey, n)
SELECT l_orderkey, n, spread, spread <= 24 AS uniform, cast(trunc((total + taken // 2) / taken) AS BIGINT) AS middle FROM s""",
    "border_planes": """SELECT l_orderkey, max(floor(l_quantity)) - min(floor(l_quantity)) <= 6 AND max(round(l_discount * 100)) - min(round(l_discount * 100)) <= 6
  AND max(round(l_tax * 100)) - min(round(l_tax * 100)) <= 6 AS uniform FROM lineitem GROUP BY l_orderkey""",
    "field_split": f"""WITH {_PICTURES} SELECT vec_id, count(*) FILTER (y % 2 = 0) AS size, sum(v) FILTER (y % 2 = 0) AS luma0, sum(v) FILTER (y % 2 = 1) AS luma1,
  sum(v) FILTER (y % 2 = 1) AS colour0, sum(v) FILTER (y % 2 = 0) AS colour1 FROM pixels GROUP BY vec_id""",
    "spatial_smooth": f"""WITH {_PICTURES}
SELECT vec_id, x, y, CASE WHEN y = 0 OR y = {HEIGHT - 1} THEN v ELSE (lag(v) OVER w + 2 * v + lead(v) OVER w) / 4 END AS v FROM pixels WINDOW w AS (PARTITION BY vec_id, x ORDER BY y)""",
    "fade_mode": f"""WITH {_PICTURES}
, rests AS (SELECT vec_id, label, i % 20 AS fade, sum(v) AS v FROM pixels GROUP BY ALL)
, best AS (SELECT vec_id, label, arg_min(fade, v * 1000 + fade) AS fade FROM rests GROUP BY vec_id, label)
, counts AS (SELECT label, fade, count(*) AS frames FROM best GROUP BY label, fade)
SELECT label, fade, frames, row_number() OVER (PARTITION BY label ORDER BY frames DESC, fade) = 1 AS is_mode FROM counts""",
    "top_pixels": f"""WITH {_PICTURES}
, spread AS (
  SELECT a.vec_id, a.i, CASE WHEN {_INNER} THEN (SELECT round(sum(p.v * p.v) - sum(p.v) * sum(p.v) / 25, 9) FROM pixels p WHERE {_NEAR}) ELSE 0.0 END AS s FROM pixels a)
SELECT vec_id, k - 1 AS rank, i AS pixel, round(s, 3) AS variance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i DESC) AS k FROM spread) WHERE k <= {int(WIDTH * HEIGHT * MASK_RATIO)}""",
    "local_correlation": f"""WITH {_PICTURES}
, means AS (SELECT a.vec_id, a.i, a.x, a.y, avg(p.v) AS m FROM pixels a JOIN pixels p ON {_NEAR} WHERE {_INNER} GROUP BY ALL)
, scores AS (SELECT a.vec_id, a.i, sum((p.x - a.x) * (p.v - a.m)) / 500 AS s FROM means a JOIN pixels p ON {_NEAR} GROUP BY ALL)
SELECT vec_id, round(sum(greatest(-1.0, least(1.0, s)) * least(1.0, abs(s) / 0.2)), 6) AS score FROM scores GROUP BY vec_id""",
    "affine_restore": f"""WITH {_PICTURES}
, lines AS (SELECT *, 1 + i % 4 / 16.0::DOUBLE AS a, -(i % 3) / 32.0::DOUBLE AS b, (i % 5) / 4.0::DOUBLE AS f FROM pixels)
SELECT vec_id, sum(o) AS total, min(o) AS least, max(o) AS most, round(sum((a - 1) * (a - 1) / 3 + (a - 1) * b + b * b) * 1000, 6) AS distance
FROM (SELECT *, cast(floor(greatest(0.0, least(255.0, f * (a * v + b * 255) + (1 - f) * v + 0.5))) AS INT) AS o FROM lines) GROUP BY vec_id""",
}

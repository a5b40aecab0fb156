"""Queries over recordings with a mark that comes and goes: it is scanned, every frame is analysed, and it is taken off again.

Embeddings are frames of 8 x 12 samples and two colour planes of 4 x 6, their components noise on a plain background; five stations are
recordings. Of forty frames the mark is absent, fades in over four, stays, and leaves with one frame that shows it in its bottom field only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmark.operators import erasing, marks, scan, series
from reelmark.plans import frames as frame_plans
from reelmark.plans.marks import _FIT, _NEAR, MOST_FRAMES, STATIONS, _fades, _inner, _prepared, _smoothed, _strength
from reelmark.sources.storage import stored
from reelmark.sources.tables import table

SHAPE = scan.Shape(8, 12)
#: Samples of a plain border lie no further apart; what a series' windows take for a second.
THRESHOLD, RATE = 5, 6
#: Frames whose planes a task works on.
TASK_PLANES = 4096
#: A picture begins here, so that the top field of colour planes has the odd rows.
IMAGE_Y = 2
# Of each plane: its width, the inner part that the mark covers, its lines at a pixel, the background, and which component is a pixel's noise.
_W, _H = SHAPE.width, SHAPE.height
_CW, _CH = SHAPE.planes()["u"]


def _lines(name: str, i: Column) -> tuple[Column, Column]:
    if name == "y":
        return 1 + i * 7 % 16 / F.lit(32.0), -(i * 5 % 8) / F.lit(64.0)
    k = 3 if name == "u" else 5
    return 1 + i * k % 4 / F.lit(32.0), -(i * k % 3) / F.lit(64.0)


def _backgrounds(key: Column) -> dict[str, Column]:
    return {"y": key * 37 % 200 + 16, "u": key * 53 % 150 + 40, "v": key * 71 % 140 + 50}


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, n, py, pu, pv)"""
    rows = table(spark, sf_dir, "embeddings").filter("embedding is not null and vec_id is not null and label is not null")
    order = Window.partitionBy("series_id").orderBy("vec_id")
    numbered = rows.select((F.col("label") % STATIONS).cast("long").alias("series_id"), "vec_id", "embedding").withColumn("n", (F.row_number().over(order) - 1).cast("long"))
    # Numbered by series, of which there are few; planes are made in as many tasks as there is work for.
    numbered = numbered.repartition(series.tasks_of(rows, TASK_PLANES), "series_id", "n")
    c = F.col("n") % 40

    def plane(name: str, width: int, height: int, step: int, start: int) -> Column:
        def sample(i: Column) -> Column:
            row, x = F.floor(i / width), i % width
            inside = (x >= 1) & (x < width - 1) & (row >= 1) & (row < height - 1)
            shown = F.when(~inside | (c < 10), 0.0).when(c < 14, (c - 9) / F.lit(5.0)).when(c < 30, 1.0).when((c == 30) & (row % 2 == 1), 1.0).otherwise(0.0)
            a, b = _lines(name, i)
            plain = _backgrounds(F.col("vec_id"))[name].cast("double")
            noise = F.element_at("embedding", ((i * step + start) % 64 + 1).cast("int")).cast("double")
            return F.floor((1 - shown) * plain + shown * ((plain - b * 255) / a) + noise * 6 + 0.5).cast("double")

        return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), sample)

    planes = [plane("y", _W, _H, 1, 0).alias("py"), plane("u", _CW, _CH, 2, 7).alias("pu"), plane("v", _CW, _CH, 3, 11).alias("pv")]
    return numbered.select("series_id", "n", *planes)


def _given_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that the recordings were made with, as a mark's file would hold them, for each series."""
    ids = table(spark, sf_dir, "embeddings").filter("label is not null").select((F.col("label") % STATIONS).cast("long").alias("series_id")).distinct()

    def lines(name: str, width: int, height: int, k: int) -> Column:
        inside = lambda i: (i % width >= 1) & (i % width < width - 1) & (i >= width) & (i < (height - 1) * width)
        return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.when(inside(i), _lines(name, i)[k]).otherwise(1.0 - k))

    return ids.select("series_id", *[lines(name, *size, k).alias(f"{c}_{name}") for name, size in SHAPE.planes().items() for k, c in enumerate("ab")])


def mark_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all planes of each recording's mark after three fits."""
    found = scan.scanned(recordings(spark, sf_dir), ["series_id"], "n", SHAPE, THRESHOLD, MOST_FRAMES)
    numbered = lambda k, p: F.transform(F.arrays_zip(F.col(f"a_{p}").alias("a"), F.col(f"b_{p}").alias("b")), lambda x, i: F.struct(F.lit(k).alias("plane"), i.alias("pixel"), x["a"].alias("a"), x["b"].alias("b")))
    opened = found.select("series_id", F.explode(F.concat(*[numbered(k, p) for k, p in enumerate("yuv")])).alias("l")).select("series_id", "l.*")
    return opened.select("series_id", "plane", "pixel", F.round("a", 4).alias("a"), (F.round("b", 4) + 0.0).alias("b"))


def frame_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every frame and both its fields the fade that leaves least of the mark."""
    return erasing.levels(erasing.analysis(recordings(spark, sf_dir), _given_mark(spark, sf_dir), SHAPE))


def erased_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame with its mark taken off: by how much in each field, and its samples weighed by their places."""
    frames, found = stored(recordings(spark, sf_dir)), _given_mark(spark, sf_dir)
    own = stored(erasing.levels(erasing.analysis(frames, found, SHAPE)))
    shown = marks.evaluated(frames.select("series_id", "n", F.col("py").alias("v")), scan.luma(found, ["series_id"]).withColumn("mark", F.lit(0)), ["series_id"], _W, _H, erasing.RATIO)
    sections = series.sections(series.frame_labels(shown.select("series_id", "n", "corr0", "corr1"), RATE))
    out = erasing.erased(frames, found, erasing.fades(own, sections), SHAPE, IMAGE_Y)
    weighed = lambda c: F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda t, v: t + v)
    return out.select("series_id", "n", "fade_top", "fade_bottom", *[weighed(f"p{p}").alias(p) for p in "yuv"])


QUERIES = {f.__name__: f for f in (mark_scan, frame_levels, erased_frames)}

_LINES = {"y": ("1 + i * 7 % 16 / 32", "-(i * 5 % 8) / 64"), "u": ("1 + i * 3 % 4 / 32", "-(i * 3 % 3) / 64"), "v": ("1 + i * 5 % 4 / 32", "-(i * 5 % 3) / 64")}
_PLANES = {"y": (0, _W, _H, 1, 0, "vec_id * 37 % 200 + 16"), "u": (1, _CW, _CH, 2, 7, "vec_id * 53 % 150 + 40"), "v": (2, _CW, _CH, 3, 11, "vec_id * 71 % 140 + 50")}


def _plane_sql(name: str) -> str:
    plane, w, h, step, start, back = _PLANES[name]
    a, b = _LINES[name]
    inside = f"i % {w} BETWEEN 1 AND {w - 2} AND i // {w} BETWEEN 1 AND {h - 2}"
    shown = f"CASE WHEN NOT ({inside}) OR n % 40 < 10 THEN 0 WHEN n % 40 < 14 THEN (n % 40 - 9) / 5 WHEN n % 40 < 30 OR n % 40 = 30 AND i // {w} % 2 = 1 THEN 1 ELSE 0 END::DOUBLE"
    return f"""SELECT key, frame, plane, w, h, i, floor((1 - s) * back + s * ((back - b * 255) / a) + e * 6 + 0.5) AS y FROM (
    SELECT key, n AS frame, {plane} AS plane, {w} AS w, {h} AS h, i, {shown} AS s, ({back})::DOUBLE AS back, ({a})::DOUBLE AS a, ({b})::DOUBLE AS b, embedding[(i * {step} + {start}) % 64 + 1]::DOUBLE AS e FROM rows, range({w * h}) t(i))"""


_RECORDINGS = f"""rows AS (
  SELECT label % {STATIONS} AS key, row_number() OVER (PARTITION BY label % {STATIONS} ORDER BY vec_id) - 1 AS n, vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL)
, samples AS ({" UNION ALL ".join(map(_plane_sql, _PLANES))})"""
_SCANNED = f"""{_RECORDINGS}
, edges AS (
  SELECT key, frame, plane, max(y) - min(y) AS spread, list_sort(list(y)) AS s FROM samples WHERE i < w OR i >= w * (h - 1) OR i % w IN (0, w - 1) GROUP BY key, frame, plane)
, backs AS (
  SELECT key, frame, plane, trunc((list_sum(s[len(s) // 4 + 1:len(s) - len(s) // 4]) + (len(s) - 2 * (len(s) // 4)) // 2) / (len(s) - 2 * (len(s) // 4))) AS back FROM edges)
, flat AS (SELECT key, frame FROM edges GROUP BY key, frame HAVING max(spread) <= {THRESHOLD})
, taken AS (SELECT key, frame FROM flat QUALIFY row_number() OVER (PARTITION BY key ORDER BY frame) <= {MOST_FRAMES})
, scan AS (SELECT s.*, back FROM samples s JOIN taken USING (key, frame) JOIN backs USING (key, frame, plane))
, luma AS (SELECT key, frame, i, y FROM scan WHERE plane = 0)
, {_smoothed("plain", "luma", "key, frame", {"y": 2}, _H)}
, m0 AS (SELECT key, plane, i, {_FIT} FROM (SELECT key, plane, i, y AS f, back AS b FROM scan) GROUP BY key, plane, i)"""


def _pass_sql(p: str, before: str, after: str) -> str:
    luma = f"{p}luma AS (SELECT key, i, a, b FROM {before} WHERE plane = 0)"
    return f"""{luma}, {_fades(p, f"{p}luma", _H)},
{p}raw AS (SELECT key, plane, i, {_FIT} FROM (SELECT key, plane, i, y AS f, back AS b FROM scan JOIN {p}fades USING (key, frame) WHERE fade > 8) GROUP BY key, plane, i),
{p}far AS (
  SELECT y.key, y.i, y.i // {_W} // 2 * {_CW} + y.i % {_W} // 2 AS j, round(1000 * sum((c.a - 1) * (c.a - 1) / 3 + (c.a - 1) * c.b + c.b * c.b), 9) < {scan.FAINT} AS faint
  FROM {p}raw y JOIN {p}raw c ON c.key = y.key AND c.i = CASE WHEN c.plane = 0 THEN y.i ELSE y.i // {_W} // 2 * {_CW} + y.i % {_W} // 2 END WHERE y.plane = 0 GROUP BY y.key, y.i),
{after} AS (
  SELECT r.key, r.plane, r.i, CASE WHEN g.i IS NULL THEN a ELSE 1 END AS a, CASE WHEN g.i IS NULL THEN b ELSE 0 END AS b
  FROM {p}raw r LEFT JOIN (SELECT DISTINCT key, 0 AS plane, i FROM {p}far WHERE faint UNION SELECT DISTINCT key, p, j FROM {p}far, (VALUES (1), (2)) v(p) WHERE faint) g USING (key, plane, i))"""


def _mark_sql(name: str) -> str:
    plane, w, h, *_ = _PLANES[name]
    a, b = _LINES[name]
    inside = f"i % {w} BETWEEN 1 AND {w - 2} AND i // {w} BETWEEN 1 AND {h - 2}"
    return f"SELECT key, {plane} AS plane, i, CASE WHEN {inside} THEN {a} ELSE 1 END::DOUBLE AS a, CASE WHEN {inside} THEN {b} ELSE 0 END::DOUBLE AS b FROM (SELECT DISTINCT key FROM rows), range({w * h}) t(i)"


def _least_sql(p: str, source: str, pictures: str, height: int) -> str:
    """{p}least(key, frame, fade): of pictures(key, frame, i, y) held against a mark source(key, i, a, b) of so many rows."""
    return f"""{_prepared(p, source, int(_W * height * erasing.RATIO), height)},
{p}tried AS (SELECT key, frame * 100 + k AS frame, i, k * 0.1::DOUBLE * (a * y + b * 255) + (1 - k * 0.1::DOUBLE) * y AS y FROM {pictures} JOIN {source} USING (key, i), range({erasing.FADES}) t(k)),
{_strength(p, f"{p}left", f"{p}tried")},
{p}least AS (SELECT key, frame // 100 AS frame, arg_min(frame % 100, (round(abs(l.score / b.score), 6), frame % 100)) AS fade FROM {p}left l JOIN (SELECT key, score FROM {p}black) b USING (key) GROUP BY ALL)"""


def _field_sql(name: str, source: str, keys: str, columns: str, bottom: int) -> str:
    return f"{name} AS (SELECT {keys}, i // {2 * _W} * {_W} + i % {_W} AS i, {columns} FROM {source} WHERE i // {_W} % 2 = {bottom})"


_LEVELS = f"""{_NEAR}, {_RECORDINGS}
, mark AS ({" UNION ALL ".join(map(_mark_sql, _PLANES))})
, lines AS (SELECT key, i, a, b FROM mark WHERE plane = 0)
, luma AS (SELECT key, frame, i, y FROM samples WHERE plane = 0)
, {_smoothed("soft", "lines", "key", {"a": 0, "b": 0}, _H)}
, {_smoothed("plain", "luma", "key, frame", {"y": 2}, _H)}
, {_field_sql("top_lines", "lines", "key", "a, b", 0)}, {_field_sql("bottom_lines", "lines", "key", "a, b", 1)}
, {_field_sql("top_frames", "luma", "key, frame", "y", 0)}, {_field_sql("bottom_frames", "luma", "key, frame", "y", 1)}
, {_least_sql("f_", "soft", "plain", _H)}
, {_least_sql("t_", "top_lines", "top_frames", _H // 2)}
, {_least_sql("b_", "bottom_lines", "bottom_frames", _H // 2)}
, levels AS (SELECT key AS series_id, frame AS n, f.fade AS level, t.fade AS top, b.fade AS bottom FROM f_least f JOIN t_least t USING (key, frame) JOIN b_least b USING (key, frame))"""

_HALF = erasing.FADE_LENGTH // 2
_A, _M = (series.half_window(RATE, seconds) for seconds in (series.AVERAGE_SECONDS, series.MEDIAN_SECONDS))
_SECTIONS = (
    frame_plans._SECTIONS.replace(frame_plans._FRAMES, "")
    .replace("THEN -15 ELSE n", f"THEN -{max(_A, _M)} ELSE n")
    .replace("THEN n + 16 ELSE", f"THEN n + {max(_A, _M) + 1} ELSE")
    .replace("15 PRECEDING", f"{_A} PRECEDING")
    .replace("15 FOLLOWING", f"{_A} FOLLOWING")
    .replace("8 PRECEDING", f"{_M} PRECEDING")
    .replace("8 FOLLOWING", f"{_M} FOLLOWING")
)
_FIXED = """
, numbered AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY s_start, s_end) AS turn FROM sections)
, parts AS (
  SELECT series_id, turn * 3 AS turn, s_start AS a, s_end AS b, 1 AS label FROM numbered
  UNION ALL SELECT series_id, turn * 3 + 1, s_end, e_start, 2 FROM numbered UNION ALL SELECT series_id, turn * 3 + 2, e_start + 1, e_end, 1 FROM numbered)
, marked AS (
  SELECT f.series_id, f.n, coalesce(arg_max(p.label, p.turn), 0) AS label FROM frames f LEFT JOIN parts p ON p.series_id = f.series_id AND f.n BETWEEN p.a AND p.b GROUP BY f.series_id, f.n)"""
ORACLE_SQL = {
    "mark_scan": f"""WITH {_NEAR}, {_SCANNED}, {_pass_sql("p_", "m0", "m1")}, {_pass_sql("q_", "m1", "m2")}
SELECT key AS series_id, plane, i AS pixel, round(a, 4) AS a, round(b, 4) + 0.0 AS b FROM m2 WHERE key NOT IN (SELECT key FROM q_raw WHERE a IS NULL OR a = 0)""",
    "frame_levels": f"WITH {_LEVELS} SELECT * FROM levels",
    "erased_frames": f"""WITH {_LEVELS}
, frames AS (
  SELECT l.key AS series_id, frame // 100 AS n, greatest(0.0::DOUBLE, max(l.score / b.score) FILTER (frame % 100 = 0)) AS corr0, least(0.0::DOUBLE, max(l.score / b.score) FILTER (frame % 100 = 10)) AS corr1
  FROM f_left l JOIN (SELECT key, score FROM f_black) b USING (key) GROUP BY ALL){_SECTIONS}{_FIXED}
, fixed AS (
  SELECT series_id, n, CASE WHEN min(label) OVER w = max(label) OVER w THEN CASE WHEN label = 2 THEN 1 ELSE 0 END END AS fixed
  FROM marked WINDOW w AS (PARTITION BY series_id ORDER BY n ROWS BETWEEN {_HALF} PRECEDING AND {_HALF} FOLLOWING))
, ended AS (SELECT *, max(n) OVER (PARTITION BY series_id) AS last_n FROM levels)
, kinds AS (
  SELECT l.series_id, l.n, round(avg(o.level) FILTER (k < 0) / 10, 9) AS bef, round(avg(o.level) FILTER (k > 0) / 10, 9) AS aft
  FROM ended l, range(-4, 5) r(k), ended o WHERE k <> 0 AND o.series_id = l.series_id AND o.n = greatest(0, least(l.last_n, l.n + k)) GROUP BY l.series_id, l.n)
, fades AS (
  SELECT series_id, n, coalesce(fixed, CASE WHEN sudden THEN top ELSE level END / 10)::DOUBLE AS fade_top, coalesce(fixed, CASE WHEN sudden THEN bottom ELSE level END / 10)::DOUBLE AS fade_bottom
  FROM (SELECT *, (bef < 0.3 AND aft > 0.7) OR (bef > 0.7 AND aft < 0.3) AS sudden FROM levels JOIN kinds USING (series_id, n) JOIN fixed USING (series_id, n)))
, cleared AS (
  SELECT series_id, n, plane, i, fade_top, fade_bottom, floor(greatest(0.0, least(255.0, f * (a * y + b * 255) + (1 - f) * y + 0.5))) AS v FROM (
    SELECT *, CASE WHEN i // w % 2 = CASE WHEN plane = 0 THEN 0 ELSE {IMAGE_Y // 2 % 2} END THEN fade_top ELSE fade_bottom END AS f
    FROM samples s JOIN fades d ON d.series_id = s.key AND d.n = s.frame JOIN (SELECT key AS k, plane AS p, i AS j, a, b FROM mark) m ON m.k = s.key AND m.p = s.plane AND m.j = s.i))
SELECT series_id, n, any_value(fade_top) AS fade_top, any_value(fade_bottom) AS fade_bottom, cast(sum(v * (i + 1)) FILTER (plane = 0) AS BIGINT) AS y, cast(sum(v * (i + 1)) FILTER (plane = 1) AS BIGINT) AS u,
  cast(sum(v * (i + 1)) FILTER (plane = 2) AS BIGINT) AS v FROM cleared GROUP BY series_id, n""",
}

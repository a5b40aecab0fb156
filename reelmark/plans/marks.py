"""Queries over marks; embeddings stand in for 8 x 8 frames and marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.operators import marks, pixels
from reelmark.plans.pixels import HEIGHT, MASK_RATIO, WIDTH
from reelmark.plans.pixels import pictures as pictures_of
from reelmark.sources.storage import read_marks, shared_folder, stored, write_marks
from reelmark.sources.tables import table

STATIONS = 5
AREA = WIDTH * HEIGHT
#: A scan takes this many valid frames of a station, those whose edge differs by no more than FLAT.
MOST_FRAMES, FLAT = 4000, 5
REFIT_RATIO = 0.1


def mark_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame against the marks of its station: the first picture of each label is a mark, which its samples turn into lines."""
    frames = pictures_of(spark, sf_dir).withColumn("station", F.col("label") % STATIONS)
    first = frames.groupBy("station", F.col("label").alias("mark")).agg(F.min_by("v", "vec_id").alias("v"))
    lines = first.select("station", "mark", F.transform("v", lambda v: 1 + v % 16 / 32).alias("a"), F.transform("v", lambda v: -(v % 8) / 64).alias("b"))
    found = marks.evaluated(frames.select("station", "vec_id", "v"), lines, ["station"], WIDTH, HEIGHT, MASK_RATIO)
    return found.select("vec_id", "mark", F.round("corr0", 5).alias("corr0"), F.round("corr1", 5).alias("corr1"))


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, vec_id, v, background): plain frames with some noise; two of three have the station's mark in the middle, in their samples."""
    key, e = F.col("vec_id"), F.col("embedding")
    background = (key * 37 % 200 + 16).cast("double")

    def sample(x, i):
        middle = (i % WIDTH >= 2) & (i % WIDTH < WIDTH - 2) & (i >= 2 * WIDTH) & (i < (HEIGHT - 2) * WIDTH) & (key % 3 != 0)
        a, b = 1 + i * 7 % 16 / F.lit(32.0), -(i * 5 % 8) / F.lit(64.0)
        return F.floor(F.when(middle, (background - b * 255) / a).otherwise(background) + x.cast("double") * 8 + 0.5).cast("double")

    rows = table(spark, sf_dir, "embeddings").filter("embedding is not null and vec_id is not null")
    frames = rows.select((F.col("label") % STATIONS).alias("station"), "vec_id", background.alias("background"), F.transform(e, sample).alias("v"))
    edge = F.filter("v", lambda v, i: (i < WIDTH) | (i >= WIDTH * (HEIGHT - 1)) | (i % WIDTH == 0) | (i % WIDTH == WIDTH - 1))
    flat = F.array_max(edge) - F.array_min(edge) <= FLAT
    return marks.first_valid(frames, ["station"], "vec_id", flat, MOST_FRAMES)


def mark_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each station's mark, fitted to the valid frames and twice again to those that show it."""
    found = marks.found_mark(_scan(spark, sf_dir), ["station"], WIDTH, HEIGHT, REFIT_RATIO)
    lines = found.select("station", F.posexplode(F.arrays_zip("a", "b")).alias("pixel", "line"))
    return lines.select("station", "pixel", F.round("line.a", 4).alias("a"), (F.round("line.b", 4) + 0.0).alias("b"))


def mark_fades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fade that leaves least of the first fitted mark in each valid frame."""
    frames = _scan(spark, sf_dir)
    first = stored(marks.fitted(frames, ["station"], AREA))
    return marks.best_fades(frames, first, ["station"], WIDTH, HEIGHT, REFIT_RATIO).select("station", "vec_id", "fade")


def faint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pixels with a line for each of three planes: those that hardly change any of them are left as they are."""
    c = F.col
    planes = [(1 + (c("l_quantity") % 5).cast("double") / 64, -c("l_discount") / 8), (1 + c("l_tax") / 4, -c("l_tax") / 8), (1 - c("l_tax") / 8, c("l_discount") / 16)]
    far, kept = pixels.without_faint([(a.cast("double"), b.cast("double")) for a, b in planes])
    own = [x.alias(f"{name}{k}") for k, plane in enumerate(kept) for name, x in zip("ab", plane, strict=True)]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", far.alias("distance"), *own)


def mark_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every picture written as a mark of one plane and read back: its header, and its lines weighed by their places."""
    lines = pictures_of(spark, sf_dir).select(
        F.col("vec_id").alias("mark"), F.col("label").alias("service_id"), *[F.lit(n).alias(c) for n, c in ((1440, "image_width"), (1080, "image_height"), (64, "left"), (32, "top"), (WIDTH, "width"))],
        F.lit("Y").alias("plane"), F.transform("v", lambda v: 1 + v / 256).alias("a"), F.transform("v", lambda v: -v / 512).alias("b"),
    )
    folder = f"{shared_folder(spark)}/marks"
    write_marks(lines, folder)
    weighed = lambda c: F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda t, v: t + v)
    return read_marks(spark, folder).select("mark", "service_id", "left", "top", "plane", F.size("a").alias("pixels"), weighed("a").alias("a"), weighed("b").alias("b"))


_NEAR = f"near AS (SELECT d, d % 5 - 2 + {WIDTH} * (d // 5 - 2) AS o FROM range(25) t(d))"


def _inner(i: str, height: int = HEIGHT) -> str:
    return f"{i} % {WIDTH} BETWEEN 2 AND {WIDTH - 3} AND {i} // {WIDTH} BETWEEN 2 AND {height - 3}"

def _smoothed(name: str, source: str, keys: str, columns: dict[str, int], height: int = HEIGHT) -> str:
    """name(keys, i, columns): each column of source smoothed along y with its bias."""
    of = ", ".join(f"CASE WHEN i < {WIDTH} OR i >= {WIDTH * (height - 1)} THEN {c} ELSE (lag({c}) OVER w + 2 * {c} + lead({c}) OVER w + {bias}) / 4 END AS {c}" for c, bias in columns.items())
    return f"{name} AS (SELECT {keys}, i, {of} FROM {source} WINDOW w AS (PARTITION BY {keys}, i % {WIDTH} ORDER BY i))"


def _prepared(p: str, source: str, count: int, height: int = HEIGHT) -> str:
    """{p}points(key, i, level, kernel..., scale, cap) of smoothed marks source(key, i, a, b), and {p}black(key, black)."""
    return f"""
{p}levels AS (SELECT key, c, i, CASE WHEN a > 0 THEN (c * 8 - b * 255) / a ELSE c * 8 END AS y FROM {source}, range(32) r(c)),
{p}spread AS (SELECT l.key, l.i, round(sum(n.y * n.y) - sum(n.y) * sum(n.y) / 25, 9) AS s FROM {p}levels l, near JOIN {p}levels n ON n.key = l.key AND n.c = l.c AND n.i = l.i + o WHERE l.c = 16 AND {_inner("l.i", height)} GROUP BY ALL),
{p}every AS (SELECT m.key, m.i, coalesce(s, 0.0) AS s FROM {source} m LEFT JOIN {p}spread s ON s.key = m.key AND s.i = m.i),
{p}chosen AS (SELECT key, i FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, i DESC) AS k FROM {p}every) WHERE k <= {count} AND {_inner("i", height)}),
{p}around AS (SELECT l.key, h.i, l.c, d, l.y FROM {p}chosen h, near JOIN {p}levels l ON l.key = h.key AND l.i = h.i + o),
{p}kernels AS (SELECT key, i, d, y - avg(y) OVER (PARTITION BY key, i) AS k FROM {p}around WHERE c = 0),
{p}answers AS (SELECT key, i, c, abs(sum(k * (y - m))) AS corr FROM (SELECT *, avg(y) OVER (PARTITION BY key, i, c) AS m FROM {p}around) JOIN {p}kernels USING (key, i, d) GROUP BY key, i, c),
{p}scales AS (SELECT key, i, c, CASE WHEN corr > 0 THEN 1 / corr ELSE 0 END AS scale, CASE WHEN least_corr > 0 THEN least(1.0::DOUBLE, corr / least_corr) ELSE 1 END AS cap
  FROM (SELECT *, sum(corr) OVER (PARTITION BY key) / ({count} * 32) * 0.2::DOUBLE AS least_corr FROM {p}answers)),
{p}dark AS (SELECT key, 0 AS frame, i, y FROM {p}levels WHERE c = 2),
{_strength(p, f"{p}black", f"{p}dark")}"""


def _strength(p: str, name: str, source: str) -> str:
    """name(key, frame, score) of pictures source(key, frame, i, y)."""
    return f"""{name} AS (
  SELECT key, frame, sum(greatest(-1.0, least(1.0, answer * scale)) * cap) AS score FROM (
    SELECT s.key, s.frame, h.i, sum(k.k * s.y) - sum(k.k) * avg(s.y) AS answer, cast(floor(greatest(0, least(255, round(avg(s.y), 6))) / 8) AS BIGINT) AS c
    FROM {p}chosen h JOIN {p}kernels k ON k.key = h.key AND k.i = h.i JOIN near n ON n.d = k.d JOIN {source} s ON s.key = h.key AND s.i = h.i + n.o GROUP BY ALL)
  JOIN {p}scales USING (key, i, c) GROUP BY key, frame)"""


_FIT = "(regr_slope(b, f) + 1 / regr_slope(f, b)) / 2 AS a, (regr_intercept(b, f) - regr_intercept(f, b) / regr_slope(f, b)) / 2 / 255 AS b"
_FRAMES = f"""raw AS (
  SELECT label % {STATIONS} AS key, vec_id AS frame, vec_id * 37 % 200 + 16 AS back, i, floor(
    CASE WHEN {_inner("i")} AND vec_id % 3 <> 0 THEN (vec_id * 37 % 200 + 16 + (i * 5 % 8) / 64 * 255) / (1 + i * 7 % 16 / 32) ELSE vec_id * 37 % 200 + 16 END + embedding[i + 1]::DOUBLE * 8 + 0.5) AS y
  FROM embeddings, range({AREA}) t(i) WHERE embedding IS NOT NULL),
flat AS (SELECT key, frame FROM raw WHERE i < {WIDTH} OR i >= {WIDTH * (HEIGHT - 1)} OR i % {WIDTH} IN (0, {WIDTH - 1}) GROUP BY key, frame HAVING max(y) - min(y) <= {FLAT}),
taken AS (SELECT key, frame FROM flat QUALIFY row_number() OVER (PARTITION BY key ORDER BY frame) <= {MOST_FRAMES}),
scan AS (SELECT * FROM raw JOIN taken USING (key, frame)),
{_smoothed("plain", "scan", "key, frame", {"y": 2})},
m0 AS (SELECT key, i, {_FIT} FROM (SELECT key, i, y AS f, back AS b FROM scan) GROUP BY key, i)"""


def _fades(p: str, marks_name: str, height: int = HEIGHT) -> str:
    """{p}fades(key, frame, fade) of the frames by a mark."""
    return f"""{_smoothed(f"{p}soft", marks_name, "key", {"a": 0, "b": 0}, height)},
{_prepared(p, f"{p}soft", int(WIDTH * height * REFIT_RATIO), height)},
{p}tried AS (SELECT key, frame * 100 + k AS frame, i, k * 0.1::DOUBLE * (a * y + b * 255) + (1 - k * 0.1::DOUBLE) * y AS y FROM plain JOIN {p}soft USING (key, i), range(20) t(k)),
{_strength(p, f"{p}left", f"{p}tried")},
{p}fades AS (SELECT key, frame // 100 AS frame, arg_min(frame % 100, (round(abs(l.score / b.score), 6), frame % 100)) AS fade FROM {p}left l JOIN (SELECT key, score FROM {p}black) b USING (key) GROUP BY ALL)"""


def _refit(p: str, name: str) -> str:
    return f"{name} AS (SELECT key, i, {_FIT} FROM (SELECT key, i, y AS f, back AS b FROM scan JOIN {p}fades USING (key, frame) WHERE fade > 8) GROUP BY key, i)"


QUERIES = {f.__name__: f for f in (mark_evaluation, mark_refit, mark_fades, faint_lines, mark_table)}
ORACLE_SQL = {
    "mark_table": f"""WITH raw AS (SELECT vec_id, label, i, greatest(0.0::DOUBLE, least(255.0::DOUBLE, floor((embedding[i + 1]::DOUBLE + 0.5) * 256))) AS v FROM embeddings, range({AREA}) t(i) WHERE embedding IS NOT NULL)
SELECT vec_id AS mark, label AS service_id, 64 AS left, 32 AS top, 'Y' AS plane, count(*) AS pixels, sum((1 + v / 256) * (i + 1)) AS a, sum(-v / 512 * (i + 1)) AS b FROM raw GROUP BY vec_id, label""",
    "mark_evaluation": f"""WITH {_NEAR},
raw AS (SELECT label % {STATIONS} AS station, label, vec_id, i, greatest(0.0::DOUBLE, least(255.0::DOUBLE, floor((embedding[i + 1]::DOUBLE + 0.5) * 256))) AS y FROM embeddings, range({AREA}) t(i) WHERE embedding IS NOT NULL),
lines AS (SELECT label AS key, station, i, 1 + y % 16 / 32 AS a, -(y % 8) / 64 AS b FROM raw WHERE vec_id IN (SELECT min(vec_id) FROM raw GROUP BY label)),
{_smoothed("soft", "lines", "key, station", {"a": 0, "b": 0})},
{_prepared("p_", "soft", int(AREA * MASK_RATIO))},
{_smoothed("plain", "raw", "station, vec_id", {"y": 2})},
shown AS (SELECT key, vec_id * 2 AS frame, i, y FROM plain JOIN soft USING (station, i) UNION ALL SELECT key, vec_id * 2 + 1, i, a * y + b * 255 FROM plain JOIN soft USING (station, i)),
{_strength("p_", "scores", "shown")}
SELECT s.frame // 2 AS vec_id, key AS mark, round(max(s.score / b.score) FILTER (s.frame % 2 = 0), 5) AS corr0, round(max(s.score / b.score) FILTER (s.frame % 2 = 1), 5) AS corr1
FROM scores s JOIN (SELECT key, score FROM p_black) b USING (key) GROUP BY ALL""",
    "mark_fades": f"WITH {_NEAR}, {_FRAMES}, {_fades('p_', 'm0')} SELECT key AS station, frame AS vec_id, fade FROM p_fades",
    "mark_refit": f"""WITH {_NEAR}, {_FRAMES}, {_fades("p_", "m0")}, {_refit("p_", "m1")}, {_fades("q_", "m1")}, {_refit("q_", "m2")}
SELECT key AS station, i AS pixel, round(a, 4) AS a, round(b, 4) + 0.0 AS b FROM m2""",
    "faint_lines": """WITH lines AS (
  SELECT l_orderkey, l_linenumber, 1 + (l_quantity % 5)::DOUBLE / 64 AS a0, -l_discount / 8 AS b0, 1 + l_tax / 4 AS a1, -l_tax / 8 AS b1, 1 - l_tax / 8 AS a2, l_discount / 16 AS b2 FROM lineitem)
, far AS (SELECT *, round(1000 * ((a0 - 1) * (a0 - 1) / 3 + (a0 - 1) * b0 + b0 * b0 + (a1 - 1) * (a1 - 1) / 3 + (a1 - 1) * b1 + b1 * b1 + (a2 - 1) * (a2 - 1) / 3 + (a2 - 1) * b2 + b2 * b2), 9) AS d FROM lines)
SELECT l_orderkey, l_linenumber, d AS distance, CASE WHEN d < 0.3 THEN 1 ELSE a0 END AS a0, CASE WHEN d < 0.3 THEN 0 ELSE b0 END AS b0, CASE WHEN d < 0.3 THEN 1 ELSE a1 END AS a1,
  CASE WHEN d < 0.3 THEN 0 ELSE b1 END AS b1, CASE WHEN d < 0.3 THEN 1 ELSE a2 END AS a2, CASE WHEN d < 0.3 THEN 0 ELSE b2 END AS b2 FROM far""",
}

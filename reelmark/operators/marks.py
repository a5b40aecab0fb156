"""Marks over pictures: what tells a mark, how clearly frames show it, and finding its lines again from the frames that show it.

A mark is a line for each pixel: under a sample v of it lies a * v + b * MOST. Pictures and marks are arrays in row order, so a mark is
prepared, and a frame held against it, within one row of a table; frames meet their candidates by a key that both have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmark.functions.arrays import bound, total
from reelmark.operators import pixels
from reelmark.operators.series import first_minimum
from reelmark.sources.storage import stored

MOST = 255.0
#: A mark is tried on backgrounds STEP apart; the one of BLACK sets how clearly it can show.
LEVELS, STEP, MIDDLE, BLACK = 32, 8, 16, 2
#: Points that answer to a mark by less than this part of the mean count for less.
WEAK = 0.2
#: Fades of a tenth each that a frame is tried with, and the least one of a frame that shows the mark.
FADES, SHOWN = 20, 9
#: So many marks are broadcast to their frames; more meet them by shuffling, and then one key's frames are in one task.
BROADCAST_MARKS = 64


def to_frames(marks: DataFrame, made: DataFrame) -> DataFrame:
    """made, a row for each of the marks, as the side of a join with their frames."""
    return F.broadcast(made) if marks.count() <= BROADCAST_MARKS else made


def covered(level: Column, a: Column, b: Column) -> Column:
    """A plain picture of one level under a mark; pixels without a slope stay."""
    return F.zip_with(a, b, lambda x, y: F.when(x > 0, (level - y * MOST) / x).otherwise(level))


def strength(values: Column, points: Column, width: int) -> Column:
    """How clearly a picture shows a mark: the sum over its points of what the neighbourhood answers, in parts of what it would on a background of that level."""

    def score(p: Column, near: Column, mean: Column) -> Column:
        level = F.floor(F.least(F.lit(MOST), F.greatest(F.lit(0.0), F.round(mean, 6))) / STEP).cast("int") + 1
        answer = total(F.zip_with(p["kernel"], near, lambda k, v: k * (v - mean)))
        return bound(F.element_at(p["scales"], level), lambda s: pixels.correlation_score(answer * s["scale"], s["cap"]))

    side = pixels.SIDE * pixels.SIDE
    def one(whole: Column, p: Column) -> Column:
        return bound(pixels.neighbourhood(whole, p["pixel"], width), lambda near: bound(total(near) / side, lambda mean: score(p, near, mean)))

    return bound(values, lambda whole: total(F.transform(points, lambda p: one(whole, p))))


def strengths(values: Column, a: Column, b: Column, points: Column, width: int, fades: Column) -> Column:
    """strength() of a picture with a mark taken off by each of `fades`.

    What is taken off grows in proportion to the fade, and so do a neighbourhood's mean and answer: both are worked out once for the picture
    and once for what a whole fade takes off.
    """
    side = pixels.SIDE * pixels.SIDE
    answer = lambda kernel, near: total(F.zip_with(kernel, near, lambda k, v: k * v))

    def part(p: Column, own: Column, off: Column) -> Column:
        return F.struct(answer(p["kernel"], own).alias("a0"), answer(p["kernel"], off).alias("a1"), (total(own) / side).alias("m0"), (total(off) / side).alias("m1"), p["scales"].alias("scales"))

    def parts(both: Column) -> Column:
        of = lambda p, k: pixels.neighbourhood(both[k], p["pixel"], width)
        return F.transform(points, lambda p: bound(of(p, "v"), lambda own: bound(of(p, "d"), lambda off: part(p, own, off))))

    def score(q: Column, fade: Column) -> Column:
        level = F.floor(F.least(F.lit(MOST), F.greatest(F.lit(0.0), F.round(q["m0"] + fade * q["m1"], 6))) / STEP).cast("int") + 1
        return bound(F.element_at(q["scales"], level), lambda s: pixels.correlation_score((q["a0"] + fade * q["a1"]) * s["scale"], s["cap"]))

    off = lambda v: F.transform(F.arrays_zip(v.alias("v"), a.alias("a"), b.alias("b")), lambda p: (p["a"] - 1) * p["v"] + p["b"] * MOST)
    both = bound(values, lambda v: F.struct(v.alias("v"), off(v).alias("d")))
    return bound(bound(both, parts), lambda all_parts: F.transform(fades, lambda fade: total(F.transform(all_parts, lambda q: score(q, fade)))))


def prepared(marks: DataFrame, width: int, height: int, ratio: float) -> DataFrame:
    """marks: a, b and keys. Adds points (pixel, kernel, scales) and black, what a black background answers.

    Points are the part `ratio` of all pixels whose neighbourhood varies most on a middle background, without those too near the edge;
    a kernel is the neighbourhood on black without its mean.
    """
    area = width * height
    count = min(area, int(area * ratio))
    side = pixels.SIDE * pixels.SIDE
    centred = lambda near: bound(total(near) / side, lambda mean: F.transform(near, lambda v: v - mean))

    def answers(levels: Column) -> Column:
        chosen = F.array_sort(F.filter(pixels.top_pixels(pixels.local_variances(levels[MIDDLE], width, height), ratio, area), lambda i: pixels.inside(i, width, height)))
        kernels = F.transform(chosen, lambda i: F.struct(i.alias("pixel"), bound(pixels.neighbourhood(levels[0], i, width), centred).alias("kernel")))
        of = lambda p, level: F.abs(pixels.correlation(p["kernel"], pixels.neighbourhood(level, p["pixel"], width)))
        return F.transform(kernels, lambda p: F.struct(p["pixel"].alias("pixel"), p["kernel"].alias("kernel"), F.transform(levels, lambda level: of(p, level)).alias("answers")))

    def scaled(rows: Column) -> Column:
        limit = total(F.transform(rows, lambda p: total(p["answers"]))) / (max(1, count) * LEVELS) * WEAK

        def scale(c: Column, least: Column) -> Column:
            return F.struct(F.when(c > 0, 1 / c).otherwise(0.0).alias("scale"), F.when(least > 0, F.least(F.lit(1.0), c / least)).otherwise(1.0).alias("cap"))

        whole = lambda p, least: F.struct(p["pixel"].alias("pixel"), p["kernel"].alias("kernel"), F.transform(p["answers"], lambda c: scale(c, least)).alias("scales"))
        return bound(limit, lambda least: F.transform(rows, lambda p: whole(p, least)))

    levels = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda c: covered((c * STEP).cast("double"), F.col("a"), F.col("b")))
    points = bound(bound(levels, answers), scaled)
    black = lambda points: strength(covered(F.lit(float(BLACK * STEP)), F.col("a"), F.col("b")), points, width)
    both = bound(points, lambda p: F.struct(p.alias("points"), black(p).alias("black")))
    return marks.select("*", both.alias("made")).select(*marks.columns, "made.points", "made.black")


def smoothed(marks: DataFrame, width: int, height: int) -> DataFrame:
    """Marks as frames without their interlacing show them."""
    return marks.withColumns({name: pixels.smoothed_down(F.col(name), width, height) for name in ("a", "b")})


def evaluated(frames: DataFrame, marks: DataFrame, keys: list[str], width: int, height: int, ratio: float) -> DataFrame:
    """frames: keys, v and others; marks: keys, mark, a, b. Each frame with each candidate of its key: (frames' columns without v, mark, corr0, corr1), how clearly it
    shows as it is and with the mark taken off, 1 being the mark on black.

    A mark that isn't of the frame's size has 0 and -1; one that shows nothing on black has null.
    """
    made = prepared(smoothed(marks.filter(F.size("a") == width * height), width, height), width, height, ratio)
    odd = marks.filter(F.size("a") != width * height).select(*keys, "mark")
    rest = [c for c in frames.columns if c != "v"]
    level = pixels.smoothed_down(F.col("v"), width, height, 2)
    shown = strengths(level, F.col("a"), F.col("b"), F.col("points"), width, F.array(F.lit(0.0), F.lit(1.0)))
    fits = frames.join(to_frames(marks, made), keys).select(*rest, "mark", "black", shown.alias("s"))
    own = fits.select(*rest, "mark", F.try_divide(F.get("s", 0), "black").alias("corr0"), F.try_divide(F.get("s", 1), "black").alias("corr1"))
    return own.unionByName(frames.select(*rest).join(odd, keys).select(*rest, "mark", F.lit(0.0).alias("corr0"), F.lit(-1.0).alias("corr1")))


def first_valid(frames: DataFrame, keys: list[str], order: str, valid: Column, most: int) -> DataFrame:
    """The first `most` valid frames of each key by order: a scan stops there."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return frames.filter(valid).withColumn("taken", rank).filter(F.col("taken") <= most).drop("taken")


def best_fades(frames: DataFrame, marks: DataFrame, keys: list[str], width: int, height: int, ratio: float) -> DataFrame:
    """Adds `fade`, in tenths: by which a key's mark has to be taken off to leave least of it, the least on ties."""
    made = prepared(smoothed(marks, width, height), width, height, ratio).filter("black <> 0")
    level = pixels.smoothed_down(F.col("v"), width, height, 2)
    left = rests(level, F.col("a"), F.col("b"), F.col("points"), F.col("black"), width, FADES)
    return frames.join(to_frames(marks, made), keys).select(*frames.columns, bound(left, first_minimum).alias("fade"))


def rests(values: Column, a: Column, b: Column, points: Column, black: Column, width: int, fades: int) -> Column:
    """What is left of a mark after it was taken off by 0, 1, 2 tenths and so on, in parts of what it shows on black."""
    tenths = F.transform(F.sequence(F.lit(0), F.lit(fades - 1)), lambda k: k * F.lit(0.1))
    return F.transform(strengths(values, a, b, points, width, tenths), lambda s: F.round(F.abs(s / black), 6))


def fitted(frames: DataFrame, keys: list[str], area: int) -> DataFrame:
    """frames: keys, v, background. (keys, a, b): the mark whose lines lead from each pixel to the background; keys with a pixel without a line are left out. All samples are summed before they are shuffled."""
    samples = frames.select(*keys, F.col("background").cast("double").alias("b"), F.posexplode("v").alias("pixel", "f"))
    lines = pixels.symmetric_fit(samples, [*keys, "pixel"], MOST)
    whole = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pixel", "a", "b"))).alias("p")).filter(F.size("p") == area)
    return whole.select(*keys, F.transform("p", lambda p: p["a"]).alias("a"), F.transform("p", lambda p: p["b"]).alias("b"))


def found_mark(frames: DataFrame, keys: list[str], width: int, height: int, ratio: float = 0.1, passes: int = 2) -> DataFrame:
    """A mark fitted to all frames, then `passes` times to those that show the one before. Each pass is a job over the same frames; its marks, one a key, are stored."""
    marks = stored(fitted(frames, keys, width * height))
    for _ in range(passes):
        shown = best_fades(frames, marks, keys, width, height, ratio).filter(F.col("fade") >= SHOWN)
        marks = stored(fitted(shown, keys, width * height))
    return marks

"""Per-pixel statistics: line fits, robust means, neighbourhood scores, restoring of covered pixels.

Pictures are arrays in row order, so all that looks at neighbours stays within a row of the table and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmark.functions.arrays import bound, total

#: Side of the square neighbourhood of correlations and variances.
SIDE = 5


def symmetric_fit(points: DataFrame, keys: list[str], most: float = 1.0) -> DataFrame:
    """points: keys, f, b. (keys, n, a, b): the line b = a f + b whose slope is the mean of the fit of b on f and the inverted fit of f on b, and likewise its height.

    The height is in parts of `most`, as if all samples had been. Keys without a finite line or of slope 0 are left out.
    """
    fits = points.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.regr_slope("b", "f").alias("a1"),
        F.regr_intercept("b", "f").alias("b1"),
        F.regr_slope("f", "b").alias("a2"),
        F.regr_intercept("f", "b").alias("b2"),
    )
    whole = fits.filter("a1 is not null and a2 is not null and a2 <> 0")
    lines = whole.select(*keys, "n", ((F.col("a1") + 1 / F.col("a2")) / 2).alias("a"), ((F.col("b1") - F.col("b2") / F.col("a2")) / 2 / most).alias("b"))
    return lines.filter("a <> 0 and not isnan(a) and not isnan(b)")


def middle_half_mean(samples: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """samples: keys, v (whole numbers). (keys, n, spread, uniform, middle): whether values differ by no more than threshold, and the mean of the middle half, rounded by adding half the count and cutting."""
    order = Window.partitionBy(*keys).orderBy("v")
    ranked = samples.select(*keys, "v", (F.row_number().over(order) - 1).alias("k"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    quarter = F.floor(F.col("n") / 4)
    middle = (F.col("k") >= quarter) & (F.col("k") < F.col("n") - quarter)
    out = ranked.groupBy(*keys, "n").agg((F.max("v") - F.min("v")).alias("spread"), F.sum(F.when(middle, F.col("v"))).alias("total"), F.count_if(middle).alias("taken"))
    mean = (F.col("total") + F.floor(F.col("taken") / 2)) / F.col("taken")
    cut = F.when(mean < 0, F.ceil(mean)).otherwise(F.floor(mean)).cast("long")
    return out.select(*keys, "n", "spread", (F.col("spread") <= threshold).alias("uniform"), cut.alias("middle"))


def uniform_planes(samples: DataFrame, keys: list[str], planes: list[str], threshold: int) -> DataFrame:
    """(keys, uniform): a border is of one colour if the samples of none of its planes lie further apart than threshold."""
    flat = [F.max(p) - F.min(p) <= threshold for p in planes]
    whole = flat[0]
    for one in flat[1:]:
        whole = whole & one
    return samples.groupBy(*keys).agg(whole.alias("uniform"))


def field_of(values: Column, width: int, bottom: int, offset: int = 0) -> Column:
    """Every second row of a picture: the top field or the bottom one; of colour planes a picture that starts at an odd row takes the other."""
    first = bottom ^ (offset % 2)
    return F.filter(values, lambda v, i: F.floor(i / width) % 2 == first)


def smoothed_down(values: Column, width: int, height: int, bias: int = 0) -> Column:
    """(1, 2, 1) / 4 along each column; first and last rows stay. Samples of frames have a bias of 2, which raises them by a half, before the division."""
    at = lambda i: F.element_at(values, (i + 1).cast("int"))
    inner = lambda i: (i >= width) & (i < width * (height - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.when(inner(i), (at(i - width) + 2 * at(i) + at(i + width) + bias) / 4).otherwise(at(i)))


def neighbourhood(values: Column, i: Column, width: int) -> Column:
    """The SIDE x SIDE values around pixel i, row by row; i must lie two pixels or more inside."""
    rows = [F.slice(values, (i + (dy * width - SIDE // 2) + 1).cast("int"), SIDE) for dy in range(-(SIDE // 2), SIDE // 2 + 1)]
    return F.concat(*rows)


def inside(i: Column, width: int, height: int) -> Column:
    edge = SIDE // 2
    x, y = i % width, F.floor(i / width)
    return (x >= edge) & (x < width - edge) & (y >= edge) & (y < height - edge)


def correlation(kernel: Column, values: Column) -> Column:
    """Sum of a kernel times the values with their mean taken off."""
    about = lambda near: bound(total(near) / (SIDE * SIDE), lambda mean: total(F.zip_with(kernel, near, lambda k, v: k * (v - mean))))
    return bound(values, about)


def local_variances(values: Column, width: int, height: int) -> Column:
    """For each pixel the sum of squared differences from the neighbourhood's mean, 0 near the edges."""

    def one(i: Column) -> Column:
        squared = lambda near: bound(total(near), lambda t: total(F.transform(near, lambda v: v * v)) - t * t / (SIDE * SIDE))
        return bound(neighbourhood(values, i, width), squared)

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.when(inside(i, width, height), F.round(one(i), 9)).otherwise(0.0))


def top_pixels(variances: Column, ratio: float, count: int) -> Column:
    """Indices of the floor(count * ratio) largest values, larger indices first on ties, in falling order."""
    pairs = F.transform(variances, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return F.transform(F.slice(F.reverse(F.array_sort(pairs)), 1, int(count * ratio)), lambda p: p["i"])


def restored(value: Column, a: Column, b: Column, most: float, fade: Column) -> Column:
    """A covered sample with the cover taken off by `fade`: rounded, kept within 0 and most, cut to a whole number."""
    background = a * value + b * most
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(most)), fade * background + (1 - fade) * value + 0.5))).cast("int")


def cover_distance(a: Column, b: Column) -> Column:
    """How far the line a x + b is from leaving x in [0, 1] as it is, squared and averaged."""
    return (a - 1) * (a - 1) / 3 + (a - 1) * b + b * b


def without_faint(planes: list[tuple[Column, Column]], least: float = 0.3) -> tuple[Column, list[tuple[Column, Column]]]:
    """The distance of a pixel's lines from leaving it as it is, in thousandths over all planes, and the lines, none where that is below `least`."""
    far = cover_distance(*planes[0])
    for plane in planes[1:]:
        far = far + cover_distance(*plane)
    far = F.round(far * 1000, 9)
    return far, [(F.when(far < least, 1.0).otherwise(a), F.when(far < least, 0.0).otherwise(b)) for a, b in planes]


def correlation_score(normalised: Column, weight: Column) -> Column:
    """What exceeds a full correlation doesn't count; weak ones are weighted down."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), normalised)) * weight

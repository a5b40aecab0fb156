"""A mark found from the frames of a recording: backgrounds measured at the border, lines fitted for all planes together, in several passes.

A frame is one row with its planes as arrays in row order: py, and pu and pv of a part of its width and height. Frames meet their mark by a
key that both have; a fit sums samples where they are read and shuffles one row a pixel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.functions.arrays import bound, total
from reelmark.operators import marks, pixels
from reelmark.sources.storage import stored

#: Part of all pixels that tell a mark while it is scanned, and passes after the first.
RATIO, PASSES = 0.1, 2
#: Lines that change a sample by less than this, in thousandths over all planes, are noise around the mark.
FAINT = 0.3


@dataclass(frozen=True)
class Shape:
    """Size of a luma plane, and by how many halvings colour planes are smaller."""

    width: int
    height: int
    log_x: int = 1
    log_y: int = 1

    def planes(self) -> dict[str, tuple[int, int]]:
        colour = self.width >> self.log_x, self.height >> self.log_y
        return {"y": (self.width, self.height), "u": colour, "v": colour}

    def samples(self) -> int:
        return sum(w * h for w, h in self.planes().values())


def border(values: Column, width: int, height: int) -> Column:
    """The samples along a plane's four edges, each once."""
    return F.filter(values, lambda v, i: (i < width) | (i >= width * (height - 1)) | (i % width == 0) | (i % width == width - 1))


def middle_mean(values: Column, n: int) -> Column:
    """The mean of the middle half of n whole numbers, rounded by adding half their number and cutting."""
    quarter = n // 4
    taken = n - 2 * quarter
    mean = (total(F.slice(F.array_sort(values), quarter + 1, taken)) + taken // 2) / taken
    return F.when(mean < 0, F.ceil(mean)).otherwise(F.floor(mean)).cast("double")


def measured(frames: DataFrame, shape: Shape, threshold: int) -> DataFrame:
    """The frames whose border is of one colour, its samples no further apart than threshold in any plane; adds that colour: bg_y, bg_u, bg_v."""
    def edge(name: str, width: int, height: int) -> Column:
        n = width * height - max(0, width - 2) * max(0, height - 2)
        return bound(border(F.col(f"p{name}"), width, height), lambda e: F.struct((F.array_max(e) - F.array_min(e)).alias("spread"), middle_mean(e, n).alias("mean")))

    out, flat = frames, F.lit(True)
    for name, (width, height) in shape.planes().items():
        out = out.withColumn(f"_{name}", edge(name, width, height))
        flat = flat & (F.col(f"_{name}.spread") <= threshold)
    return out.filter(flat).select(*frames.columns, *[F.col(f"_{name}.mean").alias(f"bg_{name}") for name in shape.planes()])


def fitted(frames: DataFrame, keys: list[str], shape: Shape) -> DataFrame:
    """frames: keys, planes, backgrounds. (keys, a_y, b_y, a_u, ...): lines of all planes; keys with any pixel that has none are left out."""
    def samples(k: int, name: str) -> Column:
        return F.transform(f"p{name}", lambda f, i: F.struct(F.lit(k).alias("plane"), i.alias("pixel"), f.cast("double").alias("f"), F.col(f"bg_{name}").alias("b")))

    field = lambda own, c: F.transform(own, lambda p: p[c])
    points = frames.select(*keys, F.explode(F.concat(*[samples(k, name) for k, name in enumerate(shape.planes())])).alias("s")).select(*keys, "s.*")
    lines = pixels.symmetric_fit(points, [*keys, "plane", "pixel"], marks.MOST)
    whole = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("plane", "pixel", "a", "b"))).alias("l")).filter(F.size("l") == shape.samples())
    start, columns = 0, []
    for name, (width, height) in shape.planes().items():
        own = F.slice("l", start + 1, width * height)
        columns += [field(own, c).alias(f"{c}_{name}") for c in "ab"]
        start += width * height
    return whole.select(*keys, *columns)


def cleaned(found: DataFrame, shape: Shape) -> DataFrame:
    """Marks without faint lines: a luma pixel goes by the distance of its lines of all planes, and a colour pixel with any of its luma pixels."""
    width, (colour_width, _) = shape.width, shape.planes()["u"]
    at = lambda name, i: F.element_at(name, (i + 1).cast("int"))

    def distance(i: Column) -> Column:
        j = F.floor(i / width / (1 << shape.log_y)) * colour_width + F.floor(i % width / (1 << shape.log_x))
        far = pixels.cover_distance(at("a_y", i), at("b_y", i))
        for name in "uv":
            far = far + pixels.cover_distance(at(f"a_{name}", j), at(f"b_{name}", j))
        return F.round(far * 1000, 9)

    def covers(j: Column) -> list[Column]:
        corner = F.floor(j / colour_width) * (width << shape.log_y) + j % colour_width * (1 << shape.log_x)
        return [corner + dy * width + dx for dy in range(1 << shape.log_y) for dx in range(1 << shape.log_x)]

    faint = F.transform(F.sequence(F.lit(0), F.lit(width * shape.height - 1)), lambda i: distance(i) < FAINT)
    gone_luma = lambda i: at("_faint", i)
    gone_colour = lambda i: F.exists(F.array(*covers(i)), lambda k: at("_faint", k))
    without = lambda column, gone, plain: F.transform(column, lambda x, i: F.when(gone(i), plain).otherwise(x))
    marked = found.withColumn("_faint", faint)
    for name in shape.planes():
        for column, plain in ((f"a_{name}", 1.0), (f"b_{name}", 0.0)):
            marked = marked.withColumn(f"_{column}", without(column, gone_luma if name == "y" else gone_colour, plain))
    keys = [c for c in found.columns if c[:2] not in ("a_", "b_")]
    return marked.select(*keys, *[F.col(f"_{c}_{name}").alias(f"{c}_{name}") for name in shape.planes() for c in "ab"])


def luma(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.select(*keys, F.col("a_y").alias("a"), F.col("b_y").alias("b"))


def scanned(frames: DataFrame, keys: list[str], order: str, shape: Shape, threshold: int, most: int, passes: int = PASSES) -> DataFrame:
    """(keys, a_y, b_y, a_u, ...): the mark of each key.

    The first `most` frames of plain border are written once. A mark is fitted to all of them, then again to those that show the mark of the
    pass before, without faint lines; each pass leaves one row a key.
    """
    valid = stored(marks.first_valid(measured(frames, shape, threshold), keys, order, F.lit(True), most))
    found = stored(fitted(valid, keys, shape))
    for _ in range(passes):
        shown = marks.best_fades(valid.withColumn("v", F.col("py")), luma(found, keys), keys, shape.width, shape.height, RATIO).filter(F.col("fade") >= marks.SHOWN)
        found = stored(cleaned(fitted(shown, keys, shape), shape))
    return found

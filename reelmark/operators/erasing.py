"""A mark taken off a recording: every frame analysed whole and by fields, sections and fades decide by how much, all planes restored.

Frames are rows (series_id, n, py, pu, pv), marks rows (series_id, a_y, b_y, a_u, ...) as scan.scanned() finds them. Only a frame's levels
are shuffled between the steps, its planes meet them once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.operators import marks, pixels, scan, series

#: Fades of a tenth each, 0 to 1, and part of the pixels that tell a mark in an analysis.
FADES, RATIO = 11, 0.35
#: Frames that a change of the mark may take.
FADE_LENGTH = 16


def analysis(frames: DataFrame, found: DataFrame, shape: scan.Shape, ratio: float = RATIO) -> DataFrame:
    """(series_id, n, frame, top, bottom): what is left of the mark after each of FADES fades, in a frame without its interlacing and in each of its fields as it is."""
    own = scan.luma(found, ["series_id"])
    width, height = shape.width, shape.height
    kinds = {"frame": (marks.smoothed(own, width, height), height)}
    for bottom, name in enumerate(("top", "bottom")):
        kinds[name] = own.withColumns({c: pixels.field_of(F.col(c), width, bottom) for c in "ab"}), height // 2
    joined = frames.select("series_id", "n", "py")
    for name, (mark, rows) in kinds.items():
        made = marks.prepared(mark, width, rows, ratio).filter("black <> 0")
        # One row a series: what tells its mark.
        joined = joined.join(marks.to_frames(found, made.select("series_id", F.struct("a", "b", "points", "black").alias(f"{name}_mark"))), "series_id")
    pictures = {"frame": pixels.smoothed_down(F.col("py"), width, height, 2)} | {name: pixels.field_of(F.col("py"), width, bottom) for bottom, name in enumerate(("top", "bottom"))}
    of = lambda name: F.col(f"{name}_mark")
    left = [marks.rests(pictures[name], of(name)["a"], of(name)["b"], of(name)["points"], of(name)["black"], width, FADES).alias(name) for name in kinds]
    return joined.select("series_id", "n", *left)


def levels(analysed: DataFrame) -> DataFrame:
    """(series_id, n, level, top, bottom): the fade, in tenths, that leaves least of the mark."""
    return analysed.select("series_id", "n", *[series.first_minimum(F.col(a)).alias(b) for a, b in (("frame", "level"), ("top", "top"), ("bottom", "bottom"))])


def fades(own: DataFrame, sections: DataFrame | None, fade_length: int = FADE_LENGTH) -> DataFrame:
    """(series_id, n, fade_top, fade_bottom) of frames with levels: 0 or 1 where the sections don't change nearby, else what the analysis says there.

    own: see levels(); sections: see series.sections(), or None where all is left to the analysis. SLOTS frames lie in a row of the analysis.
    """
    kinds = series.fade_kind(own.select("series_id", "n", "level"))
    found = series.fades(own.select("series_id", "n"), series.analysed(own), kinds)
    if sections is None:
        return found
    fixed = series.clamped_constancy(series.section_labels(own.select("series_id", "n"), sections), fade_length >> 1)
    both = found.join(fixed.select("series_id", "n", "fixed").hint("merge"), ["series_id", "n"])
    return both.select("series_id", "n", *[F.coalesce(F.col("fixed").cast("double"), F.col(c)).alias(c) for c in ("fade_top", "fade_bottom")])


def erased(frames: DataFrame, found: DataFrame, fade: DataFrame, shape: scan.Shape, image_y: int = 0) -> DataFrame:
    """The frames with their mark taken off: rows of each field by the field's own fade. image_y: the row of the picture at which the planes begin."""

    def plane(name: str, width: int) -> Column:
        # Of colour planes the top field has the odd rows where the planes begin at an odd pair of rows.
        first = 0 if name == "y" else image_y // 2 % 2
        lines = F.arrays_zip(F.col(f"p{name}").alias("v"), F.col(f"a_{name}").alias("a"), F.col(f"b_{name}").alias("b"))
        amount = lambda i: F.when(F.floor(i / width) % 2 == first, F.col("fade_top")).otherwise(F.col("fade_bottom"))
        return F.transform(lines, lambda p, i: pixels.restored(p["v"], p["a"], p["b"], marks.MOST, amount(i)))

    met = frames.join(fade.hint("merge"), ["series_id", "n"]).join(marks.to_frames(found, found), "series_id")
    own = {f"p{name}": plane(name, width) for name, (width, _) in shape.planes().items()}
    return met.select(*[own[c].alias(c) if c in own else frames[c] for c in frames.columns], "fade_top", "fade_bottom")

"""Frame time series: smoothing, three-state labels, intervals, and choices among candidates.

A series is rows (series_id, n, ...) with n from 0 without gaps. Every window is partitioned by series_id, and windows of one step share
their order, so a series is sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmark.sources.storage import stored

#: A score this far from zero tells on from off; the min-max test asks for more.
THRESHOLD, MINMAX_THRESHOLD = 0.2, 0.5
OFF, UNKNOWN, ON = 0, 1, 2
AVERAGE_SECONDS, MEDIAN_SECONDS = 1.0, 0.5


#: Frames that a task takes on average. More frames are dealt to more tasks, so what a task holds doesn't grow with the table.
TASK_FRAMES = 1 << 17


def tasks_of(frames: DataFrame, most: int | None = None) -> int:
    """As many tasks as shuffles have, more where frames need them: `most` to a task on average, TASK_FRAMES by default."""
    return max(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-frames.count() // (most or TASK_FRAMES)))


def half_window(fps: int, seconds: float) -> int:
    return int(fps * seconds / 2 + 0.5)


def noise_clipped(corr0: Column, corr1: Column) -> Column:
    """A detection can't be negative, nor what is left after removal positive."""
    return F.greatest(F.lit(0.0), corr0) + F.least(F.lit(0.0), corr1)


def state(value: Column, threshold: float) -> Column:
    return F.when(F.abs(value) < threshold, UNKNOWN).when(value < 0, OFF).otherwise(ON)


def edge_padded(series: DataFrame, half: int) -> DataFrame:
    """Repeats a series' first row for n in [-half, 0) and its last one for as many beyond its end; adds last_n."""
    whole = Window.partitionBy("series_id")
    before = F.when(F.col("n") == 0, -half).otherwise(F.col("n"))
    after = F.when(F.col("n") == F.col("last_n"), F.col("n") + half).otherwise(F.col("n"))
    return series.withColumn("last_n", F.max("n").over(whole)).withColumn("n", F.explode(F.sequence(before, after)))


def frame_labels(series: DataFrame, fps: int = 30) -> DataFrame:
    """(series_id, n, score, label): the median-smoothed score and whether the mark is on, off or unknown.

    A frame is labelled if the lesser of the maxima of both half windows and the moving average agree; runs of unknown frames take the
    label around them if both sides agree, where the outside counts as off.
    """
    average, median = half_window(fps, AVERAGE_SECONDS), half_window(fps, MEDIAN_SECONDS)
    scored = series.select("series_id", "n", noise_clipped(F.col("corr0"), F.col("corr1")).alias("raw"))
    padded = edge_padded(scored, max(average, median))
    by = Window.partitionBy("series_id").orderBy("n")
    smooth = padded.select(
        "series_id",
        "n",
        "last_n",
        F.least(F.max("raw").over(by.rowsBetween(-average, -1)), F.max("raw").over(by.rowsBetween(1, average))).alias("min_max"),
        F.round(F.avg("raw").over(by.rowsBetween(-average, average)), 9).alias("average"),
        F.percentile("raw", 0.5).over(by.rowsBetween(-median, median)).alias("score"),
    ).filter((F.col("n") >= 0) & (F.col("n") <= F.col("last_n")))
    first, second = state(F.col("min_max"), MINMAX_THRESHOLD), state(F.col("average"), THRESHOLD)
    seen = smooth.withColumn("seen", F.when(first == second, first).otherwise(UNKNOWN))
    known = F.when(F.col("seen") != UNKNOWN, F.col("seen"))
    before = F.coalesce(F.last(known, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(OFF))
    after = F.coalesce(F.first(known, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing)), F.lit(OFF))
    return seen.select("series_id", "n", "score", F.when(before == after, before).otherwise(F.col("seen")).alias("label"))


def sections(labels: DataFrame) -> DataFrame:
    """On intervals (series_id, s_best, s_start, s_end, e_best, e_start, e_end) of labelled frames.

    An interval opens at the first on-label and closes at the next off-label; unknown frames keep the state. Both ends are then moved to
    where the smoothed score crosses its threshold, and start and best points are searched from there. Every search is a running
    minimum or maximum over the series, looked up at one row, so a series is passed over once whatever its number of intervals. The
    frames with what was found are written once and read twice: for the edges, and where intervals begin and end.
    """
    by = Window.partitionBy("series_id").orderBy("n")
    past, ahead = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    last = lambda test: F.max(F.when(test, F.col("n"))).over(past)
    first = lambda test: F.min(F.when(test, F.col("n"))).over(ahead)
    score = F.col("score")
    # One more row stands for the end of the series.
    size = F.count("*").over(Window.partitionBy("series_id"))
    ended = labels.withColumn("frames", size).withColumn("n", F.explode(F.when(F.col("n") == F.col("frames") - 1, F.array(F.col("n"), F.col("n") + 1)).otherwise(F.array("n"))))
    is_end = F.col("n") == F.col("frames")
    ended = ended.withColumn("score", F.when(~is_end, score)).withColumn("label", F.when(~is_end, F.col("label")))
    latch = F.coalesce(F.last(F.when(F.col("label") != UNKNOWN, F.col("label")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(OFF))
    running = ended.select(
        "series_id",
        "n",
        "frames",
        "score",
        F.when(is_end, OFF).otherwise(latch).alias("state"),
        last(score < THRESHOLD).alias("last_low"),
        first(score >= THRESHOLD).alias("next_high"),
        last(score > -THRESHOLD).alias("last_not_off"),
        first(score <= -THRESHOLD).alias("next_off"),
        last(score <= -THRESHOLD).alias("last_off"),
        F.coalesce(first(score > 0), F.col("frames")).alias("next_positive"),
        last(score >= THRESHOLD).alias("last_high"),
        last(score > 0).alias("last_positive"),
    )
    # The first positive frame as seen from right after the last off one, and from the series' start.
    behind = F.last(F.when(score <= -THRESHOLD, F.col("positive_behind")), ignorenulls=True).over(past)
    whole = running.withColumn("positive_behind", F.coalesce(F.lead("next_positive").over(by), F.col("frames")))
    whole = whole.withColumn("off_positive", behind).withColumn("first_positive", F.first("next_positive").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("positive_behind")
    frames = stored(whole)
    tasks = tasks_of(frames)
    changed = frames.repartition(tasks, "series_id").withColumn("was", F.coalesce(F.lag("state").over(by), F.lit(OFF)))
    opens, closes = (F.col("state") == ON) & (F.col("was") != ON), (F.col("state") == OFF) & (F.col("was") == ON)
    before = lambda column, none: F.coalesce(F.lag(F.when(closes, F.col(column))).over(by), F.col(none) if none else F.lit(0))
    # Edges open and close in turn: what is known where an interval closes is the next edge's.
    ahead_of = [F.lead(c).over(by).alias(f"close_{c}") for c in ("score", "last_not_off", "next_off")]
    edges = changed.filter(opens | closes).select(
        "series_id", "n", "frames", "score", "last_low", "next_high", F.lead("n").over(by).alias("close"), before("n", "").alias("after"), before("next_positive", "first_positive").alias("after_positive"), opens.alias("opens"), *ahead_of
    )
    s_end = F.coalesce(F.when(score >= THRESHOLD, F.coalesce(F.col("last_low") + 1, F.lit(0))).otherwise(F.col("next_high")), F.col("frames"))
    begun = edges.filter("opens").withColumn("s_end", s_end)
    back = F.when(F.col("close_last_not_off") >= F.col("s_end"), F.col("close_last_not_off") + 1).otherwise(F.col("s_end"))
    e_end = F.when(F.col("close") == F.col("frames"), F.col("frames")).when(F.col("close_score") <= -THRESHOLD, back).otherwise(F.coalesce("close_next_off", F.col("frames")))
    closed = begun.withColumn("e_end", e_end).filter("s_end != e_end").select("series_id", F.col("n").alias("opened"), "after", "after_positive", "s_end", "e_end")
    # Both ends of an interval are looked up in one go.
    # Stored frames take far less room than in a task's memory, so they are never broadcast.
    looked_up = frames.select("series_id", "n", "last_off", "off_positive", "last_high", "last_positive").repartition(tasks, "series_id", "n").hint("merge")
    ends = closed.select("*", F.explode(F.array("s_end", "e_end")).alias("n")).repartition(tasks, "series_id", "n").join(looked_up, ["series_id", "n"])
    at = lambda place, column: F.max(F.when(F.col("n") == F.col(place), F.col(column))).alias(column)
    ending = ends.groupBy("series_id", "opened", "after", "after_positive", "s_end", "e_end").agg(at("s_end", "last_off"), at("s_end", "off_positive"), at("e_end", "last_high"), at("e_end", "last_positive"))
    went_off = F.col("last_off") >= F.col("after")
    ending = ending.withColumn("s_start", F.when(went_off, F.col("last_off") + 1).otherwise(F.col("after"))).withColumn("next_positive", F.when(went_off, F.col("off_positive")).otherwise(F.col("after_positive")))
    ending = ending.withColumn("e_from", F.when(F.col("last_high") >= F.col("s_end"), F.col("last_high") + 1).otherwise(F.col("s_end")))
    ending = ending.withColumn("e_peak", F.when(F.col("last_positive") >= F.col("e_from"), F.col("last_positive") + 1).otherwise(F.col("e_from")))
    best = ending.withColumn("s_best", F.when(F.col("next_positive") < F.col("s_end"), F.col("next_positive")).otherwise(F.col("s_end")))
    return best.select(
        "series_id",
        "s_best",
        "s_start",
        "s_end",
        (F.col("e_peak") - 1).alias("e_best"),
        (F.col("e_from") - 1).alias("e_start"),
        (F.col("e_end") - 1).alias("e_end"),
    )


def section_labels(frames: DataFrame, found: DataFrame) -> DataFrame:
    """(series_id, n, label) for frames (series_id, n): 1 while a change may go on, 2 between both changes, 0 elsewhere; later intervals and later parts of one win.

    Each interval covers three ranges, opened out into frames; the latest write to a frame counts. Ranges are written once, and opened out in
    as many tasks as the frames need.
    """
    tasks = tasks_of(frames)
    parts = F.array(
        F.struct(F.col("s_start").alias("a"), F.col("s_end").alias("b"), F.lit(1).alias("label")),
        F.struct(F.col("s_end").alias("a"), F.col("e_start").alias("b"), F.lit(2).alias("label")),
        F.struct((F.col("e_start") + 1).alias("a"), F.col("e_end").alias("b"), F.lit(1).alias("label")),
    )
    number = F.row_number().over(Window.partitionBy("series_id").orderBy("s_start", "s_end"))
    ranges = stored(found.withColumn("number", number).select("series_id", "number", F.posexplode(parts).alias("step", "part")))
    writes = ranges.filter("part.a <= part.b").select("series_id", F.explode(F.sequence("part.a", "part.b")).alias("n"), "part.label", (F.col("number") * 3 + F.col("step")).alias("turn"))
    latest = writes.repartition(tasks, "series_id", "n").groupBy("series_id", "n").agg(F.max_by("label", "turn").alias("label"))
    return frames.select("series_id", "n").repartition(tasks, "series_id", "n").join(latest.hint("merge"), ["series_id", "n"], "left").select("series_id", "n", F.coalesce("label", F.lit(0)).alias("label"))


def clamped_constancy(labels: DataFrame, half: int) -> DataFrame:
    """Adds `fixed`: 1 or 0 if all labels within `half` frames are equal (2 gives 1), null if they change. Places beyond the ends repeat the end."""
    near = Window.partitionBy("series_id").orderBy("n").rowsBetween(-half, half)
    same = F.min("label").over(near) == F.max("label").over(near)
    return labels.withColumn("fixed", F.when(same, (F.col("label") == ON).cast("int")))


def fade_kind(levels: DataFrame, distance: int = 4) -> DataFrame:
    """levels: (series_id, n, level) with level 0 to 10. Adds `abrupt`: the means of the frames before and after lie apart, below 0.3 and above 0.7 or the other way.

    Places beyond the ends repeat the end frame, as padding rows.
    """
    by = Window.partitionBy("series_id").orderBy("n")
    padded = edge_padded(levels, distance)
    mean = lambda a, b: F.round(F.avg("level").over(by.rowsBetween(a, b)) / 10, 9)
    both = padded.withColumn("before", mean(-distance, -1)).withColumn("after", mean(1, distance)).filter((F.col("n") >= 0) & (F.col("n") <= F.col("last_n")))
    abrupt = ((F.col("before") < 0.3) & (F.col("after") > 0.7)) | ((F.col("before") > 0.7) & (F.col("after") < 0.3))
    return both.withColumn("abrupt", abrupt).drop("last_n")


#: Frames that one analysis row holds.
SLOTS = 8


def analysed(levels: DataFrame) -> DataFrame:
    """levels: (series_id, n, level, top, bottom). (series_id, row, slots): SLOTS frames to a row, as an analysis stores them; slots in the order of n."""
    own = F.struct("n", "level", "top", "bottom")
    return levels.groupBy("series_id", F.shiftright("n", 3).alias("row")).agg(F.array_sort(F.collect_list(own)).alias("slots"))


def fades(frames: DataFrame, analysis: DataFrame, kinds: DataFrame) -> DataFrame:
    """(series_id, n, fade_top, fade_bottom): a frame's fades in tenths, looked up in its row and slot of the analysis. Where the change is abrupt each field has its own, else both take the frame's.

    frames: (series_id, n); kinds: (series_id, n, abrupt), see fade_kind().
    """
    placed = frames.select("series_id", "n", F.shiftright("n", 3).alias("row"), (F.col("n").bitwiseAND(SLOTS - 1) + 1).cast("int").alias("slot"))
    found = placed.join(analysis.hint("merge"), ["series_id", "row"]).select("series_id", "n", F.element_at("slots", F.col("slot")).alias("s"))
    both = found.join(kinds.select("series_id", "n", "abrupt").hint("merge"), ["series_id", "n"])
    of = lambda own: (F.when(F.col("abrupt"), F.col(f"s.{own}")).otherwise(F.col("s.level")) / 10).alias(f"fade_{own}")
    return both.select("series_id", "n", of("top"), of("bottom"))


def detected(corr0: Column, corr1: Column) -> Column:
    """The mark is seen and can be removed."""
    return (corr0 > THRESHOLD) & (F.abs(corr1) < THRESHOLD)


def candidate_scores(evaluated: DataFrame) -> DataFrame:
    """evaluated: (series_id, n, logo, corr0, corr1). (series_id, logo, detected, frames, score): mean rest after removal over the share of frames detected; null without any."""
    hit = detected(F.col("corr0"), F.col("corr1"))
    out = evaluated.groupBy("series_id", "logo").agg(F.count_if(hit).alias("detected"), F.count("*").alias("frames"), F.sum(F.when(hit, F.abs("corr1"))).alias("cost"))
    score = F.when(F.col("detected") > 0, F.col("cost") / F.col("detected") * (F.col("frames") / F.col("detected")))
    return out.select("series_id", "logo", "detected", "frames", score.alias("score"))


def best_candidate(scores: DataFrame) -> DataFrame:
    """The candidate of least score in each series, the first on ties, one without detections last; with its share of frames."""
    order = F.struct(F.col("score").isNull().alias("none"), "score", "logo")
    best = scores.groupBy("series_id").agg(F.min_by(F.struct("logo", "score", "detected", "frames"), order).alias("best"))
    return best.select("series_id", "best.logo", "best.score", (F.col("best.detected") / F.col("best.frames")).alias("ratio"))


def first_minimum(values: Column) -> Column:
    """Index from 0 of the least element, the first on ties."""
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")

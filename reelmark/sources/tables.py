"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frame series: (series_id, n, score, corr0, corr1), frames of a user numbered from 0 by time and id.

    The raw score (value - 50) / 50 is split as a detector would report it: corr0 its positive part, corr1 its negative part.
    """
    from pyspark.sql import Window

    from reelmark.operators.series import tasks_of

    events = table(spark, sf_dir, "events").filter(F.col("user_id").isNotNull())
    events = events.repartition(tasks_of(events), "user_id")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    raw = (F.coalesce("value", F.lit(50.0)) - F.lit(50.0)) / F.lit(50.0)
    return events.select(
        F.col("user_id").alias("series_id"),
        (F.row_number().over(order) - 1).cast("long").alias("n"),
        F.greatest(F.lit(0.0), raw).alias("corr0"),
        F.least(F.lit(0.0), raw).alias("corr1"),
    )

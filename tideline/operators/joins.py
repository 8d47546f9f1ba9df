"""Joins between stages, on natural keys and on windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.design import OUTSIDE, UNKNOWN, StudyDesign
from tideline.operators.skew import key_digest

# Windows a broadcast may carry: a thousand years of days.
MAX_BROADCAST_DAYS = 366_000


def stage_join(base: DataFrame, stage: DataFrame, key: str = "review_id") -> DataFrame:
    """Add the columns of a later stage that ``base`` lacks, matched on the row key."""
    new = [c for c in stage.columns if c not in base.columns]
    if not new:
        return base
    return base.join(stage.select(key, *new), key, "left")


def natural_key_join(left: DataFrame, right: DataFrame, keys: list[str], row_key: str,
                     fanout: bool = False) -> DataFrame:
    """Left join on natural keys that may repeat on the right; null matches null.

    One right row per key is taken, the one with the smallest ``row_key``, so the rows of
    ``left`` stay as they are. ``fanout=True`` adds ``n_matches``, how often a plain join
    would repeat the row: the inflated counts and means of such a join are then weighted
    aggregates, and equal copies are never multiplied out.
    """
    new = [c for c in right.columns if c not in left.columns]
    # Group by the digest, not the texts: partial minima collapse copies before the shuffle.
    side = right.withColumn("_key", key_digest(keys)).groupBy("_key").agg(
        F.min(row_key).alias("_first"), F.count("*").alias("n_matches"))
    if new:
        side = side.join(right.select(F.col(row_key).alias("_first"), *new), "_first", "left")
    joined = left.withColumn("_key", key_digest(keys)).join(side, "_key", "left")
    return joined.select(
        *left.columns, *new, *([F.coalesce("n_matches", F.lit(1)).alias("n_matches")] if fanout else []),
    )


def window_range_join(df: DataFrame, day: str, design: StudyDesign) -> DataFrame:
    """Window labels by joining on the days of each window: an equi-join, not a range scan.

    A row gets one copy per window it lies in; rows in none are ``outside``, undated rows
    ``unknown``. The day table is broadcast while its known size allows.
    """
    days = design.window_days(df.sparkSession)
    if design.day_count() <= MAX_BROADCAST_DAYS:
        days = F.broadcast(days)
    joined = df.join(days, df[day] == days["day"], "left").drop(days["day"])
    label = F.when(F.col(day).isNull(), UNKNOWN).otherwise(F.coalesce("window_label", F.lit(OUTSIDE)))
    return joined.withColumn("window_label", label)


def semi_windows(df: DataFrame, day: str, design: StudyDesign) -> DataFrame:
    """Rows whose day lies in any window."""
    days = design.window_days(df.sparkSession).select("day").distinct()
    if design.day_count() <= MAX_BROADCAST_DAYS:
        days = F.broadcast(days)
    return df.join(days, df[day] == days["day"], "left_semi")


def in_windows(df: DataFrame, labels: list[str], column: str = "temporal_window") -> DataFrame:
    """Rows whose window label is listed."""
    return df.where(F.col(column).isin(labels))


def until_first_below(df: DataFrame, by: str, position: str, day: str, low) -> DataFrame:
    """Rows of each group before its first row dated under ``low``; undated rows stay.

    For lists ordered newest first. The stop position of each group is an aggregate, so a
    group of any size is never sorted in one task.
    """
    stops = df.groupBy(by).agg(F.min(F.when(F.col(day) < F.lit(low), F.col(position))).alias("_stop"))
    stops = stops.withColumnRenamed(by, "_by")
    marked = df.join(stops, df[by].eqNullSafe(stops["_by"]), "left").drop("_by")
    return marked.where(F.col("_stop").isNull() | (F.col(position) < F.col("_stop"))).drop("_stop")

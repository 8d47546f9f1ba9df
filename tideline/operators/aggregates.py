"""Descriptive aggregates by window and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.design import StudyDesign
from tideline.functions.numbers import half_even

MAX_WIDE = 500


def label_values(df: DataFrame, column: str, most: int = MAX_WIDE) -> list:
    """Distinct non-null labels, sorted; an error when they are too many to be columns."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} values; pass the ones to spread")
    return sorted(r[0] for r in rows)


def label_counts(column: str, values: list, prefix: str) -> list[Column]:
    """One 0-filled count per label."""
    return [F.count_if(F.col(column) == F.lit(v)).alias(f"{prefix}{v}") for v in values]


def emotion_pivot(df: DataFrame, by: list[str], label: str = "emotion_label",
                  values: list | None = None, prefix: str = "emotion_") -> DataFrame:
    """Counts per label, one column each, 0-filled; groups without any label are absent."""
    values = label_values(df, label) if values is None else values
    return df.where(F.col(label).isNotNull()).groupBy(*by).agg(*label_counts(label, values, prefix))


def sentiment_by(df: DataFrame, by: str, score: str = "sentiment_score", emotion: str | None = None,
                 emotions: list | None = None) -> DataFrame:
    """Mean score and number of scored rows per group, and emotion counts if asked.

    Counts and means come from one aggregate; no join of two summaries is needed.
    """
    aggs = [F.avg(score).alias("mean_sentiment"), F.count(score).alias("review_count")]
    if emotion is not None:
        emotions = label_values(df, emotion) if emotions is None else emotions
        aggs += label_counts(emotion, emotions, "emotion_")
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(*aggs)


def topic_distribution(df: DataFrame, by: str, topics: dict[str, list]) -> DataFrame:
    """Counts per group and topic, one column ``<topic column>_<topic>`` each, 0-filled.

    All topic columns in one pass over the rows.
    """
    aggs = [a for column, values in topics.items() for a in label_counts(column, values, f"{column}_")]
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(*aggs)


def temporal_summary(df: DataFrame, design: StudyDesign, group: str = "city", window: str = "temporal_window",
                     rating: str = "rating", score: str = "sentiment_score", weight: str | None = None,
                     digits: int = 3) -> DataFrame:
    """Count, mean and sample deviation of ratings and mean score per group and event window.

    ``weight`` counts each row that many times, as a fan-out join would have repeated it.
    """
    rows = df.where(F.col(window).isin(design.event_labels) & F.col(group).isNotNull())
    if weight is None:
        n, mean, std = F.count(rating), F.avg(rating), F.stddev_samp(rating)
        score_mean = F.avg(score)
    else:
        w = F.when(F.col(rating).isNotNull(), F.col(weight))
        n = F.coalesce(F.sum(w), F.lit(0))
        mean = F.try_divide(F.sum(F.col(rating) * w), F.sum(w))
        spread = F.sum(F.col(rating) * F.col(rating) * w) - F.sum(F.col(rating) * w) * mean
        std = F.sqrt(F.try_divide(F.greatest(spread, F.lit(0.0)), F.sum(w) - 1))
        sw = F.when(F.col(score).isNotNull(), F.col(weight))
        score_mean = F.try_divide(F.sum(F.col(score) * sw), F.sum(sw))
    out = rows.groupBy(group, window).agg(
        n.alias("n"),
        half_even(mean, digits).alias("rating_mean"),
        half_even(std, digits).alias("rating_std"),
        half_even(score_mean, digits).alias("sentiment_mean"),
    )
    return out.orderBy(group, design.ordinal(window))


def year_compare(df: DataFrame, design: StudyDesign, group: str = "city", window: str = "temporal_window",
                 rating: str = "rating", score: str = "sentiment_score") -> DataFrame:
    """Mean rating, mean score and rows of the target per window pair and year."""
    place = paired_window(design, F.col(window))
    rows = df.where((F.col(group) == design.target) & F.col(window).isin(design.paired_labels))
    return (
        rows.select(place["window"].alias("window"), place["year"].alias("year"), rating, score)
        .groupBy("window", "year")
        .agg(F.avg(rating).alias("rating"), F.avg(score).alias("sentiment"), F.count("*").alias("n"))
    )


def paired_window(design: StudyDesign, window: Column) -> Column:
    """Struct of the pair's event label and the year the row belongs to."""
    name = year = None
    for event, baseline in design.pairs:
        for label, y in ((event, design.event_year), (baseline, design.baseline_year)):
            test = window == F.lit(label)
            name = F.when(test, F.lit(event)) if name is None else name.when(test, F.lit(event))
            year = F.when(test, F.lit(y)) if year is None else year.when(test, F.lit(y))
    return F.struct(name.alias("window"), year.alias("year"))

"""Comparisons of event against baseline and of target against control.

Each takes rows, or the cells :func:`compact` makes of them in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.design import StudyDesign
from tideline.functions.numbers import half_even, pct_change, share_pct
from tideline.operators.aggregates import emotion_pivot, paired_window
from tideline.operators.scratch import written
from tideline.operators.skew import top_per_group

WINDOW = "temporal_window"
CELL_COLUMNS = {"n", "score_sum", "score_n"}


def compact(df: DataFrame, topic: str, group: str = "city", window: str = WINDOW, score: str = "sentiment_score",
            label: str = "sentiment_label") -> DataFrame:
    """Rows counted per group, window, class and topic, with the sum and number of scores.

    All comparisons follow from these cells, so a table is read once for all of them.
    """
    return df.groupBy(group, window, label, topic).agg(
        F.count("*").alias("n"), F.sum(score).alias("score_sum"), F.count(score).alias("score_n")
    )


def _is_cells(df: DataFrame) -> bool:
    return CELL_COLUMNS <= set(df.columns)


def _count(df: DataFrame, test: Column) -> Column:
    if _is_cells(df):
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return F.count_if(test)


def _mean(df: DataFrame, test: Column, score: str) -> Column:
    if _is_cells(df):
        scored = F.sum(F.when(test, F.col("score_n")))
        return F.try_divide(F.sum(F.when(test, F.col("score_sum"))), F.nullif(scored, F.lit(0)).cast("double"))
    return F.avg(F.when(test, F.col(score)))


def volumetric(df: DataFrame, design: StudyDesign, group: str = "city", window: str = WINDOW) -> DataFrame:
    """Rows per group and window pair, event against baseline, with the change in percent.

    One aggregate with a conditional count per window; pairs unfold from its few rows.
    """
    counts = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        *[_count(df, F.col(window) == F.lit(w)).alias(w) for w in design.paired_labels]
    )
    pair = F.explode(F.array(*[
        F.struct(
            F.lit(e).alias("window_event"), F.lit(b).alias("window_baseline"),
            F.col(e).alias("reviews_event"), F.col(b).alias("reviews_baseline"),
        )
        for e, b in design.pairs
    ]))
    return counts.select(group, pair.alias("p")).select(
        group, "p.*", pct_change("p.reviews_event", "p.reviews_baseline").alias("pct_change")
    )


def window_counts(df: DataFrame, window: str = WINDOW) -> DataFrame:
    """Rows per window when there is no group; the change is unknown."""
    return df.where(F.col(window).isNotNull()).groupBy(window).agg(
        _count(df, F.lit(True)).alias("review_count"),
        F.max(F.lit(None).cast("double")).alias("pct_change_vs_baseline"),
    )


def sentiment_change(df: DataFrame, design: StudyDesign, group: str = "city", window: str = WINDOW,
                     score: str = "sentiment_score", label: str = "sentiment_label",
                     emotion: str | None = None, emotions: list | None = None,
                     emotions_by_group: bool = False, missing_as_zero: bool = True) -> DataFrame:
    """Count, mean score and class shares of both years per group and window pair.

    Changes compare the rounded figures. With ``missing_as_zero`` a side without rows
    counts as 0 in them, otherwise the change is null. ``emotion`` adds emotion counts of
    the event window, over all groups unless ``emotions_by_group``; it needs rows.
    """
    def stats(w: str) -> Column:
        mine = F.col(window) == F.lit(w)
        n = _count(df, mine)
        return F.struct(
            n.alias("n"),
            half_even(_mean(df, mine, score), 4).alias("mean"),
            share_pct(_count(df, mine & (F.col(label) == "positive")), n).alias("pos"),
            share_pct(_count(df, mine & (F.col(label) == "negative")), n).alias("neg"),
        ).alias(f"s_{w}")

    wide = df.where(F.col(group).isNotNull()).groupBy(group).agg(*[stats(w) for w in design.paired_labels])
    pair = F.explode(F.array(*[
        F.struct(F.lit(e).alias("window"), F.col(f"s_{e}").alias("e"), F.col(f"s_{b}").alias("b"))
        for e, b in design.pairs
    ]))
    rows = wide.select(group, pair.alias("p")).select(group, "p.*")

    def side(stat: str, s: str) -> Column:
        value, n = F.col(f"{s}.{stat}"), F.col(f"{s}.n")
        return F.when(n == 0, F.lit(0.0)).otherwise(value) if missing_as_zero else value

    def known(s: str) -> Column:
        return F.nullif(F.col(f"{s}.n"), F.lit(0))

    out = rows.select(
        group, "window",
        known("e").alias("review_count_event"),
        F.col("e.mean").alias("mean_sentiment_event"),
        F.col("e.pos").alias("pct_positive_event"),
        F.col("e.neg").alias("pct_negative_event"),
        known("b").alias("review_count_baseline"),
        F.col("b.mean").alias("mean_sentiment_baseline"),
        F.col("b.pos").alias("pct_positive_baseline"),
        F.col("b.neg").alias("pct_negative_baseline"),
        pct_change(side("mean", "e"), side("mean", "b")).alias("pct_change_mean_sentiment"),
        pct_change(side("pos", "e"), side("pos", "b")).alias("pct_change_positive"),
        pct_change(side("neg", "e"), side("neg", "b")).alias("pct_change_negative"),
    )
    if emotion is None:
        return out
    by = [group, window] if emotions_by_group else [window]
    counts = emotion_pivot(df.where(F.col(window).isin(design.event_labels)), by, emotion, emotions)
    counts = counts.withColumnRenamed(window, "window")
    return out.join(counts, [group, "window"] if emotions_by_group else "window", "left")


def target_vs_control(df: DataFrame, design: StudyDesign, group: str = "city", window: str = WINDOW,
                      score: str = "sentiment_score", label: str = "sentiment_label") -> DataFrame:
    """Event-year figures of target and control per window, with their difference on both rows.

    Both groups of a window come out of one aggregate, so no self-join is needed.
    """
    def stats(place: str) -> Column:
        mine = F.col(group) == F.lit(place)
        n = _count(df, mine)
        shares = [
            share_pct(_count(df, mine & (F.col(label) == c)), n).alias(f"pct_{c}")
            for c in ("positive", "negative", "neutral")
        ]
        mean = half_even(_mean(df, mine, score), 4).alias("mean_sentiment")
        return F.struct(F.lit(place).alias(group), n.alias("review_count"), mean, *shares)

    rows = df.where(F.col(group).isin(design.target, design.control) & F.col(window).isin(design.event_labels))
    wide = rows.groupBy(window).agg(stats(design.target).alias("t"), stats(design.control).alias("c"))
    both = (F.col("t.review_count") > 0) & (F.col("c.review_count") > 0)
    difference = half_even(F.col("t.mean_sentiment") - F.col("c.mean_sentiment"), 4)
    differences = {
        "diff_mean_sentiment": F.when(both, difference),
        "diff_pct_positive": F.when(both, pct_change("t.pct_positive", "c.pct_positive")),
        "diff_pct_negative": F.when(both, pct_change("t.pct_negative", "c.pct_negative")),
    }
    sides = wide.withColumns(differences).select(window, F.explode(F.array("t", "c")).alias("s"), *differences)
    return sides.where(F.col("s.review_count") > 0).select(window, "s.*", *differences)


def category_share(df: DataFrame, by: dict[str, Column], topic: str) -> DataFrame:
    """Count of each topic in its group and its share in percent; null topics are left out.

    The share's denominator is a window over the counts, one row per group and topic.
    """
    counts = df.where(F.col(topic).isNotNull()).groupBy(
        *[c.alias(name) for name, c in by.items()], F.col(topic).alias("topic")
    ).agg(_count(df, F.lit(True)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(*by))
    return counts.withColumn("pct", share_pct(F.col("count"), total))


def category_share_by_window(df: DataFrame, design: StudyDesign, topic: str, window: str = WINDOW) -> DataFrame:
    """Topic shares per window pair and year."""
    place = paired_window(design, F.col(window))
    rows = df.where(F.col(window).isin(design.paired_labels))
    return category_share(rows, {"window": place["window"], "year": place["year"]}, topic)


def category_share_by_group(df: DataFrame, design: StudyDesign, topic: str, group: str = "city",
                            window: str = WINDOW) -> DataFrame:
    """Topic shares of target and control in the event year."""
    rows = df.where(F.col(window).isin(design.event_labels) & F.col(group).isin(design.target, design.control))
    return category_share(rows, {group: F.col(group)}, topic)


def top_categories(shares: DataFrame, by: list[str], n: int = 3) -> DataFrame:
    """The n largest topics per group, ties by topic."""
    return top_per_group(shares, by, [F.desc("count"), F.asc("topic")], n)


def key_findings(df: DataFrame, design: StudyDesign, topic: str, group: str = "city",
                 window: str = WINDOW) -> DataFrame:
    """All comparisons as rows of (section, group_name, window_name, measure, value).

    The cells are written first: six sections read them, and the table is read once.
    """
    def long(frame: DataFrame, section: str, name: Column, place: Column, measures: dict[str, Column]) -> DataFrame:
        pairs = F.explode(F.array(*[
            F.struct(F.lit(m).alias("measure"), v.cast("double").alias("value")) for m, v in measures.items()
        ]))
        return frame.select(
            F.lit(section).alias("section"), name.alias("group_name"), place.alias("window_name"), pairs.alias("m")
        ).select("section", "group_name", "window_name", "m.measure", "m.value")

    col, none = F.col, F.lit("all")
    cells = written(compact(df, topic, group, window), "findings")
    totals = cells.agg(
        _count(cells, F.lit(True)).alias("n"), _count(cells, col(group) == design.target).alias("t")
    )
    vol = volumetric(cells, design, group, window)
    change = sentiment_change(cells, design, group, window)
    place = target_vs_control(cells, design, group, window)
    by_window = top_categories(category_share_by_window(cells, design, topic, window), ["window", "year"])
    by_group = top_categories(category_share_by_group(cells, design, topic, group, window), [group])
    change_columns = [c for c in change.columns if c not in (group, "window")]
    place_columns = [c for c in place.columns if c not in (group, window)]
    top = {"topic": col("topic"), "pct": col("pct")}
    parts = [
        long(totals, "totals", none, none, {"reviews": col("n"), "target_reviews": col("t")}),
        long(vol, "volume", col(group), col("window_event"),
             {c: col(c) for c in ("reviews_event", "reviews_baseline", "pct_change")}),
        long(change, "sentiment_change", col(group), col("window"), {c: col(c) for c in change_columns}),
        long(place, "target_vs_control", col(group), col(window), {c: col(c) for c in place_columns}),
        long(by_window, "top_topics_window", F.concat_ws("#", "year", "rank"), col("window"), top),
        long(by_group, "top_topics_group", F.concat_ws("#", group, "rank"), none, top),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

"""Label mapping: stars, predicted classes, annotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Star label to class and to signed score.
STAR_LABEL = {
    "1 star": "negative",
    "2 stars": "negative",
    "3 stars": "neutral",
    "4 stars": "positive",
    "5 stars": "positive",
}
STAR_SCORE = {
    "1 star": -1.0,
    "2 stars": -0.5,
    "3 stars": 0.0,
    "4 stars": 0.5,
    "5 stars": 1.0,
}
# The two-class reading of stars, three counting as positive.
STAR_BINARY = {
    "1 star": "negative",
    "2 stars": "negative",
    "3 stars": "positive",
    "4 stars": "positive",
    "5 stars": "positive",
}
# Sentiment classes and the polarity cut.
SENTIMENTS = ["positive", "negative", "neutral"]
POLARITY_CUT = 0.05


def case_map(c: Column | str, mapping: dict, default) -> Column:
    """Dictionary lookup as a CASE; for the few-entry maps of this package."""
    c = F.col(c) if isinstance(c, str) else c
    out = None
    for key, value in mapping.items():
        test = c == F.lit(key)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    if out is None:
        return F.lit(default)
    return out if default is None else out.otherwise(F.lit(default))


def star_to_label(c: Column | str) -> Column:
    return case_map(_lower(c), STAR_LABEL, "neutral")


def star_to_score(c: Column | str) -> Column:
    return case_map(_lower(c), STAR_SCORE, 0.0)


def stars_text(n: Column | str) -> Column:
    """``1 star`` … ``5 stars`` from a number."""
    n = F.col(n) if isinstance(n, str) else n
    return F.concat(n.cast("string"), F.when(n.cast("int") == 1, F.lit(" star")).otherwise(F.lit(" stars")))


def normalise_three_class(c: Column | str) -> Column:
    """Leading 1-2 negative, 3 neutral, anything else positive."""
    label = _plain(c)
    head = F.substring(label, 1, 1)
    return (
        F.when(label.isNull(), F.lit(None).cast("string"))
        .when(head.isin("1", "2"), "negative").when(head == "3", "neutral").otherwise("positive")
    )


def normalise_binary_stars(c: Column | str) -> Column:
    """Two classes from a star label, unknown labels positive."""
    return case_map(_plain(c), STAR_BINARY, "positive")


def normalise_binary_label(c: Column | str) -> Column:
    """``positive`` and ``label_1`` positive, anything else negative."""
    return F.when(_plain(c).isin("positive", "label_1"), "positive").otherwise("negative")


def normalise_plain(c: Column | str) -> Column:
    """Lower case, trimmed."""
    return _plain(c)


def top_class(predictions: Column | str) -> Column:
    """Best struct of an array of (label, score); the first one wins a tie."""
    predictions = F.col(predictions) if isinstance(predictions, str) else predictions
    ranked = F.transform(
        predictions,
        lambda p, i: F.struct(p["score"].alias("score"), (-i).alias("order"), F.lower(p["label"]).alias("label")),
    )
    best = F.array_max(ranked)
    return F.struct(best["label"].alias("label"), best["score"].alias("score"))


def polarity_label(score: Column | str, cut: float = POLARITY_CUT) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score > cut, "positive").when(score < -cut, "negative").otherwise("neutral")


def _lower(c: Column | str) -> Column:
    return F.lower(F.col(c) if isinstance(c, str) else c)


def _plain(c: Column | str) -> Column:
    return F.trim(_lower(c))

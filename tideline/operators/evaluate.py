"""Classifier evaluation: confusion, per-class figures, accuracy by slice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.numbers import half_even


def label_union(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Every label of truth or prediction, once, sorted."""
    both = df.select(F.explode(F.array(truth, predicted)).alias("label"))
    return both.where(F.col("label").isNotNull()).distinct().orderBy("label")


def label_list(df: DataFrame, truth: str, predicted: str, most: int = 1000) -> list[str]:
    """The same as a list for the other functions; an error when there are too many."""
    rows = label_union(df, truth, predicted).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labels")
    return [r[0] for r in rows]


def _pairs(df: DataFrame, truth: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per (truth, predicted) of rows with a truth, the only pass over the rows."""
    return df.where(F.col(truth).isNotNull()).groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def confusion(df: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """Dense counts, one row per (truth, predicted) of the listed labels, truth in rows."""
    counted = _pairs(df, truth, predicted).where(F.col("truth").isin(labels) & F.col("predicted").isin(labels))
    names = F.array(*[F.lit(x) for x in labels])
    zeros = (
        df.sparkSession.range(1)
        .select(F.explode(names).alias("truth"))
        .select("truth", F.explode(names).alias("predicted"), F.lit(0).cast("bigint").alias("n"))
    )
    return counted.unionByName(zeros).groupBy("truth", "predicted").agg(F.sum("n").alias("n"))


def class_figures(df: DataFrame, truth: str, predicted: str, labels: list[str],
                  by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each listed label; 0 where a division has no base.

    Rows of other labels still count as predictions and misses of the listed ones.
    """
    return _figures(_pairs(df, truth, predicted, by), labels, by)


def _figures(pairs: DataFrame, labels: list[str], by: tuple[str, ...]) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(zero)
    sides = pairs.select(*by, F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), zero.alias("claimed"), hit.alias("hits")),
        F.struct(F.col("predicted").alias("label"), zero.alias("support"), F.col("n").alias("claimed"), zero.alias("hits")),
    )).alias("s")).select(*by, "s.*").where(F.col("label").isin(labels))
    groups = pairs.select(*by).distinct() if by else pairs.sparkSession.range(1)
    zeros = groups.select(
        *by, F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"),
        zero.alias("support"), zero.alias("claimed"), zero.alias("hits"),
    )
    sums = sides.unionByName(zeros).groupBy(*by, "label").agg(
        *[F.sum(c).cast("double").alias(c) for c in ("support", "claimed", "hits")]
    )

    def ratio(part, whole):
        return F.coalesce(F.try_divide(part, F.nullif(whole, F.lit(0.0))), F.lit(0.0))

    # F1 over counts: 2 hits / (claimed + support) is 2PR / (P + R).
    return sums.select(
        *by, "label",
        ratio(F.col("hits"), F.col("claimed")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(F.lit(2.0) * F.col("hits"), F.col("claimed") + F.col("support")).alias("f1"),
        F.col("support").cast("bigint").alias("support"),
    )


def class_report(df: DataFrame, truth: str, predicted: str, labels: list[str], digits: int = 4,
                 by: tuple[str, ...] = ()) -> DataFrame:
    """Figures per label, their plain and support-weighted means, and the accuracy of all rows."""
    pairs = _pairs(df, truth, predicted, by)
    figures = _figures(pairs, labels, by)
    names = ("precision", "recall", "f1")
    weight = F.nullif(F.sum("support"), F.lit(0)).cast("double")
    macro = figures.groupBy(*by).agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = figures.groupBy(*by).agg(
        *[F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), weight), F.lit(0.0)).alias(c) for c in names],
        F.sum("support").alias("support"),
    )
    right = F.sum(F.when(F.col("truth").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(F.lit(0)))
    acc = pairs.groupBy(*by).agg(
        F.try_divide(right.cast("double"), F.sum("n").cast("double")).alias("accuracy"), F.sum("n").alias("support")
    )
    acc = acc.select(*by, *[F.col("accuracy").alias(c) for c in names], "support")
    out = figures
    for name, part in (("macro avg", macro), ("weighted avg", weighted), ("accuracy", acc)):
        out = out.unionByName(part.withColumn("label", F.lit(name)))
    return out.select(*by, "label", *[half_even(c, digits).alias(c) for c in names], "support")


def accuracy_by_slice(df: DataFrame, truth: str, predicted: str, by: str) -> DataFrame:
    """Accuracy and rows per slice, of rows with a truth."""
    return df.where(F.col(truth).isNotNull()).groupBy(by).agg(_accuracy(truth, predicted).alias("accuracy"), F.count("*").alias("n"))


def mean_slice_accuracy(slices: DataFrame) -> DataFrame:
    """Unweighted mean of the slice accuracies."""
    return slices.agg(F.avg("accuracy").alias("mean_accuracy"), F.count("*").alias("n_slices"))


def compare_models(df: DataFrame, truth: str, predictions: dict[str, str], labels: list[str], digits: int = 4) -> DataFrame:
    """One row per model: rows, accuracy, macro F1, weighted F1.

    ``predictions`` maps a model's name to its column; all models are counted in one pass.
    """
    unfolded = df.select(F.col(truth).alias("truth"), F.explode(F.array(*[
        F.struct(F.lit(model).alias("model"), F.col(column).alias("predicted")) for model, column in predictions.items()
    ])).alias("p")).select("truth", "p.*")
    report = class_report(unfolded, "truth", "predicted", labels, digits, by=("model",))

    def cell(label: str, column: str):
        return F.max(F.when(F.col("label") == label, F.col(column)))

    return report.groupBy("model").agg(
        cell("accuracy", "support").alias("n_samples"), cell("accuracy", "f1").alias("accuracy"),
        cell("macro avg", "f1").alias("macro_f1"), cell("weighted avg", "f1").alias("weighted_f1"),
    )


def _accuracy(truth: str, predicted: str):
    return F.avg(F.when(F.col(truth).eqNullSafe(F.col(predicted)), F.lit(1.0)).otherwise(F.lit(0.0)))

"""Exact quantiles and box statistics of groups too large for one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SKETCH_ACCURACY = 10_000


def quantile_cells(df: DataFrame, by: list[str], value: str, probs: list[float],
                   accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Counted values around each quantile, and counted gaps between them.

    A quantile sketch brackets each requested rank between two values. Rows inside a
    bracket keep their value; rows outside only add to the count of the gap they lie in,
    of which the two end values stay known.
    What is left per group is a sliver of the data, and exact ranks follow from it.
    """
    slack = 3.0 / accuracy
    lows = [max(p - slack, 0.0) for p in probs]
    highs = [min(p + slack, 1.0) for p in probs]
    known = [F.col(c).isNotNull() for c in [*by, value]]
    rows = df.where(reduce(and_, known)).select(*by, F.col(value).cast("double").alias("_v"))
    rows = rows.where(~F.isnan("_v"))
    # One sketch per group answers both ends of all brackets.
    ends = F.percentile_approx("_v", lows + highs, accuracy)
    sketch = rows.groupBy(*by).agg(ends.alias("_ends")).select(
        *by, F.slice("_ends", 1, len(probs)).alias("_lo"), F.slice("_ends", len(probs) + 1, len(probs)).alias("_hi")
    )
    keyed = rows.join(sketch, by)
    inside = F.exists(F.arrays_zip("_lo", "_hi"), lambda b: F.col("_v").between(b["_lo"], b["_hi"]))
    next_low = F.array_min(F.filter("_lo", lambda x: x > F.col("_v")))
    return (
        keyed.select(
            *by,
            inside.alias("_in"),
            F.when(inside, F.col("_v")).otherwise(F.coalesce(next_low, F.lit(float("inf")))).alias("_at"),
            "_v",
        )
        .groupBy(*by, "_in", "_at")
        .agg(F.count("*").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    )


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float],
                    accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Linear-interpolation quantiles, one column per entry of ``probs``, and ``n``."""
    cells = quantile_cells(df, by, value, list(probs.values()), accuracy)
    group = Window.partitionBy(*by)
    upto = group.orderBy("_at", "_in").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(group))

    def at_rank(rank: Column) -> Column:
        # Value at 0-based position `rank`; in a gap only the two ends are known and needed.
        first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1
        value = F.when(F.col("_in") | (rank == first), F.col("_min")).when(rank == last, F.col("_max"))
        return F.max(F.when((first <= rank) & (rank <= last), value))

    aggs = []
    for name, p in probs.items():
        rank = (F.col("_n") - 1) * F.lit(p)
        aggs += [at_rank(F.floor(rank)).alias(f"_{name}_a"), at_rank(F.ceil(rank)).alias(f"_{name}_b")]
    wide = ranked.groupBy(*by).agg(F.max("_n").alias("n"), *aggs)
    out = []
    for name, p in probs.items():
        rank = (F.col("n") - 1) * F.lit(p)
        part = rank - F.floor(rank)
        low, high = F.col(f"_{name}_a"), F.col(f"_{name}_b")
        out.append((low + (high - low) * part).alias(name))
    return wide.select(*by, "n", *out)


def box_stats(df: DataFrame, by: list[str], value: str, whisker: float = 1.5,
              accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """n, mean, quartiles, whisker ends and number of outliers per group; nulls left out.

    A whisker ends at the furthest value within ``whisker`` quartile ranges of the box,
    and at the box itself when no value lies between.
    """
    joined = _with_fences(df, by, value, whisker, accuracy)
    inside = F.col(value).between(F.col("_low"), F.col("_high"))
    out = joined.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.avg(value).alias("mean"),
        *[F.max(q).alias(q) for q in ("q1", "median", "q3")],
        F.min(F.when(F.col(value) >= F.col("_low"), F.col(value))).alias("_wl"),
        F.max(F.when(F.col(value) <= F.col("_high"), F.col(value))).alias("_wh"),
        F.count_if(~inside).alias("n_outliers"),
    )
    return out.select(
        *by, "n", "mean", "q1", "median", "q3",
        F.least("_wl", "q1").alias("whisker_low"),
        F.greatest("_wh", "q3").alias("whisker_high"),
        "n_outliers",
    )


def box_outliers(df: DataFrame, by: list[str], value: str, whisker: float = 1.5,
                 accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """The rows beyond the whiskers."""
    joined = _with_fences(df, by, value, whisker, accuracy)
    return joined.where(~F.col(value).between(F.col("_low"), F.col("_high"))).select(*by, value)


def _with_fences(df: DataFrame, by: list[str], value: str, whisker: float, accuracy: int) -> DataFrame:
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias(value))
    boxes = exact_quantiles(rows, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, accuracy)
    reach = (F.col("q3") - F.col("q1")) * F.lit(whisker)
    boxes = boxes.withColumns({"_low": F.col("q1") - reach, "_high": F.col("q3") + reach})
    return rows.join(boxes, by)

"""Repeatable samples: the order of a hash of the row key replaces a random draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import strip_space
from tideline.operators.skew import number_rows, top_per_group

# Rows per stratum, seed, shortest text worth annotating.
PER_STRATUM = 30
SEED = 42
MIN_CHARS = 10


def draw_key(seed: int | str, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def head_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """First n rows by key."""
    return df.orderBy(key).limit(n)


def random_sample(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """n rows in the order of a hash of their key; all rows if there are fewer."""
    return df.orderBy(draw_key(seed, key), key).limit(n)


def eligible(text: Column | str, language: Column | str, wanted: str = "it", min_chars: int = MIN_CHARS) -> Column:
    """Long enough and in the wanted language."""
    text = F.col(text) if isinstance(text, str) else text
    language = F.col(language) if isinstance(language, str) else language
    return F.coalesce((F.length(strip_space(text)) >= min_chars) & (language == wanted), F.lit(False))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int = PER_STRATUM, seed: int = SEED,
                      columns: list[str] | None = None, annotation: str = "annotation") -> DataFrame:
    """Up to n rows of each stratum, shuffled, numbered 1..N, with an empty annotation column.

    Only strata and keys, unique and not null, are ranked; the other columns join the chosen keys.
    """
    slim = df.select(stratum, key)
    drawn = top_per_group(slim, [stratum], [draw_key(seed, key), F.col(key)], n, rank="_rank").drop("_rank")
    mixed = number_rows(drawn.withColumn("_mix", draw_key(f"{seed}:mix", key)), "_mix", "_id")
    keep = [c for c in (columns or df.columns) if c in df.columns and c != "id"]
    chosen = mixed.select("_id", F.col(key).alias("_key"))
    return df.join(chosen, df[key] == chosen["_key"]).select(F.col("_id").alias("id"), *keep, F.lit("").alias(annotation))


def sample_stats(df: DataFrame, stratum: str, text: str, language: str, wanted: str = "it",
                 n: int = PER_STRATUM, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per stratum: rows with text, eligible rows, rows a sample would take."""
    with_text = F.coalesce(strip_space(F.col(text)) != "", F.lit(False))
    ok = with_text & eligible(text, language, wanted, min_chars)
    return df.groupBy(stratum).agg(
        F.count_if(with_text).alias("n_raw"),
        F.count_if(ok).alias("n_eligible"),
        F.least(F.count_if(ok), F.lit(n)).alias("n_sampled"),
    )

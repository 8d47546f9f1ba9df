"""Resumable processing: what is done is a table of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.sources.reviews import read_stage


def pending(items: DataFrame, done: DataFrame | None, key: str = "url") -> DataFrame:
    """Items whose key is not in the ledger.

    The ledger is not deduplicated first: an anti join does not care, and a join directly
    on the shuffled sides lets Spark split a skewed key.
    """
    return items if done is None else items.join(done.select(key), key, "left_anti")


def read_ledger(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    return read_stage(spark, root, name)


def commit_done(done: DataFrame, root: str, name: str, key: str = "url") -> None:
    """Append processed keys, after their results are safely written."""
    done.select(key).write.mode("append").parquet(f"{root.rstrip('/')}/{name}")


def clear_ledger(spark: SparkSession, root: str, name: str, key: str = "url") -> None:
    """Empty the ledger when everything is done."""
    spark.createDataFrame([], f"{key} string").write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")

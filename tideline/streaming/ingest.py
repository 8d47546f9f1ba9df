"""Incremental ingestion: new files only, exactly once, then stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tideline.sources.reviews import read_stage


def stream_reviews(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str,
                   source_format: str = "parquet", transform: Callable[[DataFrame], DataFrame] | None = None,
                   partition_by: list[str] | None = None, files_per_batch: int = 1000,
                   options: dict[str, str] | None = None) -> None:
    """Process the files of ``source`` that earlier runs have not, append them to ``target``.

    The checkpoint remembers the files, the file sink's log makes a repeated batch
    harmless. Stateless, so it runs for any number of files; ``files_per_batch`` bounds
    one batch.
    """
    reader = spark.readStream.schema(schema).format(source_format).option("maxFilesPerTrigger", files_per_batch)
    for name, value in (options or {}).items():
        reader = reader.option(name, value)
    rows = reader.load(source)
    out = transform(rows) if transform else rows
    writer = (
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start(target).awaitTermination()


def resumable_step(spark: SparkSession, source: str, target: str, ledger: str, checkpoint: str, schema: str, key: str,
                   source_format: str = "parquet", transform: Callable[[DataFrame], DataFrame] | None = None,
                   files_per_batch: int = 1000, options: dict[str, str] | None = None) -> None:
    """Process new files and note their keys as done, results first, both under the batch's number.

    A batch that is repeated after a loss, even between its two writes, has the same
    number and rows, so it replaces what it left. :func:`committed` reads the batches
    that are whole.
    """
    reader = spark.readStream.schema(schema).format(source_format).option("maxFilesPerTrigger", files_per_batch)
    for name, value in (options or {}).items():
        reader = reader.option(name, value)

    def commit(batch: DataFrame, number: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            write_batch(transform(batch) if transform else batch, target, number)
            write_batch(batch.select(key).distinct(), ledger, number)
        finally:
            batch.unpersist()

    writer = reader.load(source).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def write_batch(rows: DataFrame, folder: str, number: int) -> None:
    """Write the rows of a batch, in place of any that it wrote before."""
    rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")


def committed(spark: SparkSession, target: str, ledger: str) -> DataFrame | None:
    """The results of all batches whose keys are in the ledger; None before the first."""
    rows, done = read_stage(spark, target, ""), read_stage(spark, ledger, "")
    if rows is None or done is None:
        return None
    return rows.join(done.select("batch").distinct(), "batch", "left_semi").drop("batch")

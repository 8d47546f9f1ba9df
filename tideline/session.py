"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 8 << 20
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tideline", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, skew-join splitting and UTC dates.

    Partition counts and memory belong to the cluster and are set only by ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | None = None, **conf: str) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    cores = cores or os.cpu_count() or 1
    defaults = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session(master=f"local[{cores}]", **{**defaults, **conf})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder named by ``spark.checkpoint.dir``.

    Every executor must see it, so an unset folder is an error on a cluster; a session of
    one process falls back to a new temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tideline-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    names = {name: f"spark.sql.{name.replace('_', '.')}" for name in values}
    before = {full: spark.conf.get(full, None) for full in names.values()}
    for name, full in names.items():
        spark.conf.set(full, values[name])
    try:
        yield
    finally:
        for full, value in before.items():
            spark.conf.set(full, value) if value is not None else spark.conf.unset(full)


def shuffles_removed(spark: SparkSession):
    """Shuffle files of a query started inside go when it ends, not when the driver's collector comes by.

    For queries whose rows are written or collected. Should rows be needed again, as after the loss of a
    cached part, Spark makes the files anew.
    """
    return _settings(spark, classic_shuffleDependency_fileCleanup_enabled="true")


def small_batches(spark: SparkSession):
    """Python workers get rows of megabytes a few at a time, not thousands together."""
    return _settings(spark, execution_arrow_maxBytesPerBatch=str(BATCH_BYTES))


def balanced(df: DataFrame, key: str) -> DataFrame:
    """Rows spread over all cores when a scan has fewer splits than there are cores.

    A table of one small file is one split, and per-text work would run on one core. A
    scan of many splits is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)

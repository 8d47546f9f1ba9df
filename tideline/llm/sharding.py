"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

How many rows each input partition sends to each shard is drawn first, from the
distribution a uniform shuffle would give (multivariate hypergeometric), so that every
shard gets exactly its size. Each partition then permutes its rows' shard numbers
locally, the rows move once, and each shard permutes what it received. Shards are
permuted in cells of a bounded number of rows, chosen at random for each row, so that no
task holds a shard; the cells' sizes follow from the same draws, without reading a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.tables import saved

CELL_ROWS = 8192
MOST_CELLS = 4096  # of a shard; beyond, cells grow, and their sort spills
MATRIX_BYTES = 64 << 20  # bound of the broadcast matrix: partitions x shards x 8 bytes


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Equal sizes, at most one apart."""
    return rows // shards + (np.arange(shards) < rows % shards)


def communication_matrix(held: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows each partition sends to each shard; sums to ``held`` by rows and ``sizes`` by columns."""
    rng = np.random.default_rng([seed, 0])
    left = sizes.copy()
    out = np.zeros((len(held), len(sizes)), np.int64)
    for p, n in enumerate(held):
        out[p] = rng.multivariate_hypergeometric(left, n, method="marginals") if n else 0
        left -= out[p]
    return out


def _draws(seed: int, part: int, sends: np.ndarray, cells: int):
    """Shard, cell and order of each row of a partition, from its matrix row alone."""
    rng = np.random.default_rng([seed, 1, part])
    shard = np.repeat(np.arange(len(sends), dtype=np.int32), sends)
    rng.shuffle(shard)
    return shard, rng.integers(0, cells, len(shard), dtype=np.int32), rng.integers(0, 1 << 63, len(shard))


def sharded(docs: DataFrame, shards: int = 16, seed: int = 7, plain_scan: bool = False) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (0, 1, ... within its shard, without gaps).

    The law is ``rows``: shard sizes are at most one apart. Every row counts alike: null
    texts, equal texts and repeated rows are placed like any other; no column is read to
    decide. Existing columns named shard or slot are replaced. The same input, partitions
    and seed give the same result.

    Rows are numbered by place in their partition, so a partition must hold the same rows
    in the same order when it is read again. A scan of files does (``plain_scan=True``);
    anything else is written to the shared folder first.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("shard", "slot")])
    spark = docs.sparkSession
    if not plain_scan:
        docs = saved(docs, "unsharded")
    most = MATRIX_BYTES // (8 * shards)
    if docs.rdd.getNumPartitions() > most:
        docs = docs.coalesce(most)
    counts = dict(docs.groupBy(F.spark_partition_id().alias("part")).count().collect())  # one number per partition
    held = np.zeros(max(counts, default=0) + 1, np.int64)
    for part, n in counts.items():
        held[part] = n
    total = int(held.sum())
    matrix = spark.sparkContext.broadcast(communication_matrix(held, shard_sizes(total, shards), seed))
    cells = min(MOST_CELLS, max(1, round(total / shards / CELL_ROWS)))

    def sizes(batches):
        for batch in batches:
            for part in batch.column("part").to_pylist():
                shard, cell, _ = _draws(seed, part, matrix.value[part], cells)
                both, n = np.unique(shard.astype(np.int64) * cells + cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(n)], ["block", "n"])

    parts = spark.range(len(held)).select(F.col("id").alias("part"))
    blocks = parts.mapInArrow(sizes, "block long, n long").groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", "n", F.expr(f"block div {cells}").alias("shard"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    offsets = saved(blocks.select(F.col("block").alias("__block"), before.alias("__before")), "offsets")

    new = [T.StructField("shard", T.IntegerType()), T.StructField("__block", T.LongType()), T.StructField("__order", T.LongType())]
    schema = T.StructType([*docs.schema.fields, T.StructField("__part", T.IntegerType()), *new])

    def deal(batches):
        done, part = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part = batch.column("__part")[0].as_py()
                shard, cell, order = _draws(seed, part, matrix.value[part], cells)
            at = slice(done, done + batch.num_rows)
            done += batch.num_rows
            if done > len(shard):
                raise ValueError(f"partition {part} holds more rows than were counted")
            block = shard[at].astype(np.int64) * cells + cell[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shard[at]), pa.array(block), pa.array(order[at])], schema.names)
        if part is not None and done < len(shard):
            raise ValueError(f"partition {part} holds fewer rows than were counted")

    dealt = docs.withColumn("__part", F.spark_partition_id()).mapInArrow(deal, schema)
    rank = F.row_number().over(Window.partitionBy("__block").orderBy("__order"))
    # at most shards x MOST_CELLS rows of two longs
    ranked = dealt.withColumn("__rank", rank).join(F.broadcast(offsets), "__block")
    return ranked.select(*docs.columns, "shard", (F.col("__before") + F.col("__rank") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str) -> None:
    """The shards as Parquet folders shard=0, shard=1, ..., rows of each file by slot."""
    docs.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

"""Written intermediate tables, components of links, and grouped maps for many small groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.words import mix
from tideline.session import scratch_path, shuffles_removed


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, read again after a lost executor."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def forget(*tables: DataFrame) -> None:
    """Remove tables written by :func:`saved` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node in links (a, b); the component is its smallest node.

    Each round hooks every root to its smallest neighbour, follows the hooks twice and
    keeps the links between different roots; rounds grow as the logarithm of the longest
    path. A hub is a grouping key with partial minima, never a collected group.
    """
    a, b = F.col("a"), F.col("b")
    edges = saved(links.select("a", "b").where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), name)
    roots, backing = None, []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        hook = both.groupBy(a.alias("node")).agg(F.min("b").alias("to"))
        near = hook = saved(hook.select("node", F.least("node", "to").alias("to")), name)
        for _ in range(2):
            ahead = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
            hook = hook.join(ahead, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        hook = saved(hook, name)
        forget(near)
        if roots is None:
            roots, used = hook.select("node", F.col("to").alias("component")), hook
        else:
            step = hook.select(F.col("node").alias("component"), "to")
            used = roots = saved(roots.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), name)
            forget(*backing)
        backing = [used]
        left = edges.join(hook.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        left = left.join(hook.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x != y")
        after = saved(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name)
        forget(edges, *([] if hook is used else [hook]))
        edges = after
    forget(edges)
    if roots is None:
        roots = links.select(a.alias("node"), a.alias("component")).limit(0)
    roots.backing = backing  # tables that the result reads
    return roots


def map_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str,
               most: int | None = None) -> DataFrame:
    """``work`` on the rows of each run of equal keys, for many groups of bounded size.

    Groups are sorted runs of one partition, so a million small groups cost no more than
    their rows. Keys are integer columns without nulls. With ``most``, a longer run is
    worked on in pieces of about that many rows.
    """
    def groups(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            change[0] = last is not None and any(c[0] != v for c, v in zip(columns, last))
            last = [c[-1] for c in columns]
            at = 0
            for cut in [*np.flatnonzero(change).tolist(), batch.num_rows]:
                if cut < batch.num_rows or cut > at:
                    if cut > at:
                        held.append(batch.slice(at, cut - at))
                    full = most is not None and sum(b.num_rows for b in held) >= most
                    if held and (cut < batch.num_rows or full):
                        yield pa.Table.from_batches(held)
                        held = []
                    at = cut
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        out, rows = [], 0
        for group in groups(batches):
            for lo in range(0, group.num_rows, most or group.num_rows):
                for found in work(group.slice(lo, most)):
                    out.append(found)
                    rows += found.num_rows
            if rows >= 4096:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, rows = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    dealt = df.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


SLOTS = 1 << 24


def id_bits(ids: DataFrame, column: str) -> np.ndarray:
    """A bit set of hashed ids: 2 MB at most, whatever the number of ids.

    It only spares rows a shuffle. As it fills up, more rows take the join that decides.
    """
    def run(batches):
        for batch in batches:
            slot = np.unique(_slots(batch.column(0).cast(pa.int64()).drop_null().to_numpy()))
            word, at = np.unique(slot >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (slot & 63).astype(np.uint64), at) if len(slot) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

    with shuffles_removed(ids.sparkSession):
        found = ids.select(column).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(SLOTS >> 6, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)


def bits_hold(ids: pa.Array, bits: np.ndarray) -> np.ndarray:
    """Which ids may be among those of ``bits``; null ids are not."""
    slot = _slots(ids.cast(pa.int64()).fill_null(0).to_numpy())
    known = (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
    return known & ids.is_valid().to_numpy(zero_copy_only=False)


def maybe_in(df: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """Rows whose id may be among those of ``bits``.

    For rows that are shuffled next. A map that reads them in the same stage calls
    :func:`bits_hold` itself, for one Python process less.
    """
    held = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(bits_hold(batch.column(column), held.value)))

    return df.mapInArrow(run, df.schema)


def without_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose id is not in ``ids``; only rows that may be are shuffled to find out."""
    bits = id_bits(ids, column)
    held = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~bits_hold(batch.column(column), held.value)))

    unsure = maybe_in(df, column, bits).join(ids, column, "left_anti")
    return df.mapInArrow(run, df.schema).unionByName(unsure.select(*df.columns))


def in_doc_order(docs: DataFrame) -> DataFrame:
    """Rows by ascending doc_id over the partitions and within them; nulls first, ties by a hash of the text."""
    tied = docs.withColumn("__tie", F.xxhash64("text")).repartitionByRange("doc_id", "__tie")
    return tied.sortWithinPartitions("doc_id", "__tie", "text").drop("__tie")

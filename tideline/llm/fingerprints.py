"""Document fingerprints: SimHash over word pairs, and permuted block tables for their neighbours.

Every distinct pair of neighbouring words is hashed to 128 bits; each bit votes with the
pair's weight, 1 + ln(occurrences), and the signs of the votes are the fingerprint. To
find fingerprints within a Hamming radius r, the bits are cut into r + 1 blocks: two such
fingerprints agree in one block at least, so each of r + 1 tables is keyed by one block
and its groups are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import words as W
from tideline.llm.tables import components, in_doc_order, map_groups, saved

BITS = 128
BLOCK = 1024
_SIGNS = np.where((np.arange(256)[:, None] >> np.arange(8)) & 1, 1.0, -1.0)


def fingerprints(column: pa.Array) -> np.ndarray:
    """Two 64-bit words for each text; equal texts have equal words, a text without words has zeros."""
    out = [np.zeros((0, 2), np.uint64)]
    for lo, hi, data, offsets in W.slices(column):
        words = W.words_of(data, offsets, lower=True)
        terms, begin = words.windows(words.hashes(), 2, short=True)
        bounds = np.searchsorted(begin, words.first)
        for a, b in zip(bounds[:-1], bounds[1:]):
            terms[a:b].sort()
        row = np.repeat(np.arange(hi - lo), np.diff(bounds))
        fresh = np.ones(len(terms), bool)
        fresh[1:] = (terms[1:] != terms[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(fresh)
        # whole numbers, so that sums do not depend on their order
        weight = np.rint(256 * (1 + np.log(np.diff(np.append(at, len(terms))))))
        both = np.stack([terms[at], W.mix(terms[at] ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
        octets = np.ascontiguousarray(both).view(np.uint8)
        votes = np.empty((hi - lo, BITS))
        for k in range(BITS // 8):
            cells = np.bincount(row[at] * 256 + octets[:, k], weights=weight, minlength=(hi - lo) * 256)
            votes[:, 8 * k:8 * k + 8] = cells.reshape(hi - lo, 256) @ _SIGNS
        out.append(np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64))
    return np.concatenate(out)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def _hex(prints: np.ndarray) -> list[str]:
    return [f"{int(b):016x}{int(a):016x}" for a, b in prints]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text's first ones."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_RESULT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, hi long, lo long")


def _compared(texts: list[str], following: list[str]) -> list[pa.Array]:
    changed = [edited(a, b) for a, b in zip(texts, following)]
    prints, other, after = (fingerprints(pa.array(x, pa.large_string())) for x in (texts, changed, following))
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array(_hex(prints), pa.string()), pa.array(_hex(other), pa.string()),
        pa.array(likeness(prints, other)), pa.array(likeness(prints, after)),
        W.longs(np.ascontiguousarray(prints[:, 1])), W.longs(np.ascontiguousarray(prints[:, 0])),
    ]


def _neighbours_in_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows compared with the next row; the partition's first and last text go out as heads and tails."""
    names = ["kind", "part", "doc_id", "text", *[f.split()[0] for f in _RESULT.split(", ")]]

    def ends(kind, part, doc_id, text):
        blank = [pa.nulls(1, pa.from_numpy_dtype(np.int64)), *[pa.nulls(1, pa.string())] * 3,
                 *[pa.nulls(1, pa.float64())] * 2, *[pa.nulls(1, pa.int64())] * 2]
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()),
                                           pa.array([doc_id], pa.int64()), pa.array([text], pa.string()), *blank], names)

    part, held_id, held = None, None, None
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):  # a few megabytes of texts at a time
            some = batch.slice(lo, 512)
            texts = [t or "" for t in some.column("text").to_pylist()]
            ids = some.column("doc_id").to_pylist()
            if part is None:
                part = some.column("part")[0].as_py()
                yield ends(1, part, ids[0], texts[0])
            else:
                texts, ids = [held, *texts], [held_id, *ids]
            held, held_id = texts[-1], ids[-1]
            if len(texts) > 1:
                n = len(texts) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(ids[:-1], pa.int64()),
                     pa.nulls(n, pa.string()), *_compared(texts[:-1], texts[1:])], names)
    if part is not None:
        yield ends(2, part, held_id, held)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, hi, lo.

    The next document is the next by doc_id, nulls first, ties by a hash of the text, and after the last
    the first; a single document follows itself. Null texts are empty. Likeness is the share
    of equal bits. The texts move once: partitions are ranges of doc_id, and only their
    first and last texts are matched across them. Other columns are not read.
    """
    dealt = in_doc_order(docs.select("doc_id", "text"))
    found = dealt.select(F.lit(0).alias("kind"), F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(
        _neighbours_in_partition, f"kind int, part int, doc_id long, text string, {_RESULT}")
    found = saved(found, "fingerprints")
    # one row for each partition
    parts = found.where("kind = 1").select("part", F.col("text").alias("following"))
    order = Window.orderBy("part")
    tails = found.where("kind = 2").select("part", "doc_id", "text")
    follow = tails.select("part", F.lead("part").over(order).alias("next"), F.first("part").over(order).alias("first"))
    follow = follow.select("part", F.coalesce("next", "first").alias("to"))
    pairs = tails.join(follow, "part").join(parts.withColumnRenamed("part", "to"), "to").select("doc_id", "text", "following")

    def last(batches):
        for batch in batches:
            both = [[t or "" for t in batch.column(c).to_pylist()] for c in ("text", "following")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_compared(*both)],
                                             ["doc_id", *[f.split()[0] for f in _RESULT.split(", ")]])

    closing = pairs.mapInArrow(last, f"doc_id long, {_RESULT}")
    return found.where("kind = 0").drop("kind", "part", "text").unionByName(closing)


def radius_pairs(prints: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b, distance) of ids whose fingerprints differ in at most ``radius`` bits; a < b.

    ``prints`` has distinct (id, hi, lo) without nulls. Groups of a table with more than
    ``block`` fingerprints are compared as pairs of blocks, in tasks of their own.
    """
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]

    def part(lo, hi):
        """Bits lo to hi of the 128, hashed where they straddle the words."""
        pieces = []
        for word, base in (("lo", 0), ("hi", 64)):
            a, b = max(lo - base, 0), min(hi - base, 64)
            if a < b:
                mask = (1 << (b - a)) - 1
                mask = mask - (1 << 64) if mask >= 1 << 63 else mask
                pieces.append(F.shiftrightunsigned(F.col(word), a).bitwiseAND(F.lit(mask)))
        return pieces[0] if len(pieces) == 1 else F.xxhash64(*pieces)

    tables = F.array(*[F.struct(F.lit(i).alias("table"), part(*cuts[i:i + 2]).alias("key")) for i in range(radius + 1)])
    rows = prints.select("id", "hi", "lo", F.inline(tables))
    counts = rows.groupBy("table", "key").count().where("count > 1")
    rows = rows.join(counts.select("table", "key", F.ceil(F.col("count") / block).alias("blocks")), ["table", "key"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("table", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "hi", "lo", "own")

    def compare(group: pa.Table):
        ids, own = group.column("id").to_numpy(), group.column("own").to_numpy()
        words = np.stack([group.column(c).to_numpy() for c in ("lo", "hi")], axis=1).view(np.uint64)
        crossed = own.min() != own.max()
        found = []
        for k in range(len(ids) - 1):
            far = np.bitwise_count(words[k] ^ words[k + 1:]).sum(axis=1)
            ok = far <= radius
            if crossed:
                ok &= own[k + 1:] != own[k]
            at = np.flatnonzero(ok)
            other = ids[k + 1:][at]
            found.append((np.minimum(ids[k], other), np.maximum(ids[k], other), far[at].astype(np.int32)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b", "distance"])

    return map_groups(rows, ["table", "key", "i", "j"], compare, "a long, b long, distance int").distinct()


def with_classes(table: DataFrame, radius: int = 3) -> DataFrame:
    """``table`` with class_id: the smallest doc_id reachable over fingerprints within the radius.

    Texts without words share the all-zero fingerprint and hence a class; a class without
    any doc_id has none. Equal fingerprints are one node, so copies are never paired.
    """
    prints = saved(table.groupBy("hi", "lo").agg(F.min("doc_id").alias("id")), "prints")
    roots = components(radius_pairs(prints.where("id IS NOT NULL"), radius), "classes")
    named = prints.join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "hi", "lo", F.coalesce("component", "id").alias("class_id"))
    return table.join(saved(named, "named"), ["hi", "lo"], "left")

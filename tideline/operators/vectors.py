"""Sentence vectors without a pretrained model: co-occurrence, randomised SVD, weighted means.

Words that stand near each other are counted, counts become positive pointwise mutual
information, and block power iteration finds the leading directions of that symmetric
matrix.

Texts are coded in slices of about a million words; a word's string is shuffled once for
each slice it occurs in. Pairs are sorted and counted per slice, and only the differences
of the sorted pairs are shuffled, once, to the band of rows they belong to. After that
nothing is shuffled: words have numbers without gaps, the matrix lies in blocks (part of
the rows, strip of the columns) and the directions in strips of rows, and a product gives
each task a part, which reads one strip of the directions after the other from the shared
folder. A task holds the strip, its own rows and the cells of one block. Only the small
matrix of inner products of the directions reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.scratch import parted as _parted
from tideline.operators.scratch import read_parts, removed, written
from tideline.session import shuffles_removed, small_batches

REACH = 4  # words on each side that count as near
LEAST = 2  # occurrences of a word of the vocabulary
SPARE = 8  # directions more than wanted while iterating
ROUNDS = 4
COMMON = 1e-3  # share of all words at which a word counts half
SLICE_WORDS = 1 << 20  # words of texts that are coded together; a longer text alone
BAND_BITS, STRIP_BITS = 14, 17  # words of a band of rows and of a strip of columns, as powers of two
BAND, STRIP = 1 << BAND_BITS, 1 << STRIP_BITS
MERGED = 1 << 22  # pairs of a band that wait before they are merged
CELLS = 1 << 16  # cells multiplied at once
SLICES_AT_ONCE = 8  # slices of texts that share one reading of the directions


# ---- numbers in bytes, tables in folders

def _squeezed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes; small ones take little."""
    octets = values.astype("<i8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(octets.T).tobytes())


def _numbers(data: bytes) -> np.ndarray:
    octets = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(octets.T).view("<i8").reshape(-1)


def _rows(folder: str) -> Iterator[dict]:
    """The rows of the Parquet files of a folder, which need not exist."""
    for table in read_parts(folder):
        yield from table.to_pylist()


def _strip(folder: str, strip: int, rows: int, width: int) -> np.ndarray:
    """The values of one strip of a table (strip, first, q); rows that it lacks are zero."""
    out = np.zeros((rows, width))
    for r in _rows(f"{folder}/strip={strip}"):
        q = np.frombuffer(r["q"]).reshape(-1, width)
        at = r["first"] - strip * STRIP
        out[at:at + len(q)] = q
    return out


# ---- texts as codes, words as numbers

def _coded(df: DataFrame, words: str, key: str | None) -> DataFrame:
    """Written slices of texts: slice, keys, words (the different ones), codes (of all words), sizes (of the texts)."""
    kind = df.schema[key].dataType if key else None
    keys = F.col(key) if key else F.lit(None).cast("long")
    schema = f"slice long, keys array<{kind.simpleString() if kind else 'long'}>, words array<string>, codes binary, sizes binary"
    frame = df.select(F.spark_partition_id().cast("long").alias("part"), keys.alias("key"), F.col(words).alias("words"))

    def run(batches):
        done = 0
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy().astype(np.int64)
            total = np.cumsum(sizes)
            lo = 0
            while lo < batch.num_rows:
                before = total[lo] - sizes[lo]
                hi = max(lo + 1, int(np.searchsorted(total, before + SLICE_WORDS, "right")))
                flat = batch.column("words").slice(lo, hi - lo).flatten()
                flat = flat.dictionary_encode() if len(flat) else pa.DictionaryArray.from_arrays(pa.array([], pa.int32()), pa.array([], pa.string()))
                codes = pc.fill_null(flat.indices, -1).to_numpy().astype(np.int64)
                column = batch.column("key").slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([
                    pa.array([(batch.column("part")[lo].as_py() << 32) + done], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), pa.concat_arrays([column])),
                    pa.ListArray.from_arrays(pa.array([0, len(flat.dictionary)], pa.int32()), flat.dictionary.cast(pa.string())),
                    pa.array([_squeezed(codes + 1)]), pa.array([_squeezed(sizes[lo:hi])])],
                    ["slice", "keys", "words", "codes", "sizes"])
                done, lo = done + 1, hi

    return written(frame.mapInArrow(run, schema), "vector_texts", rows_per_file=4)


def _vocabulary(df: DataFrame, words: str, least: int) -> DataFrame:
    """Written table (word, n, id)."""
    vocabulary = df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    counted = written(vocabulary, "vector_words")
    vocabulary = written(counted.withColumn("id", F.monotonically_increasing_id()), "vector_words")
    removed(counted)
    return vocabulary


def _bases(vocabulary: DataFrame) -> list[int]:
    """For each partition of the vocabulary, how many words those before it have."""
    found = {r.p: r["count"] for r in vocabulary.groupBy(F.shiftright("id", 33).alias("p")).count().collect()}
    sizes = [found.get(p, 0) for p in range(max(found, default=-1) + 1)]
    return [sum(sizes[:p]) for p in range(len(sizes) + 1)]


def _place(bases: list[int]) -> Column:
    """A word's number without gaps, in the order of the ids."""
    return F.element_at(F.lit(bases), (F.shiftright("id", 33) + 1).cast("int")) + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))


def _ids(places: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """The ids of words by their numbers."""
    part = np.searchsorted(bases, places, "right") - 1
    return (part << 33) + places - bases[part]


def _placed(coded: DataFrame, vocabulary: DataFrame, bases: list[int]) -> DataFrame:
    """The slices with, for each code, the number of its word: arrays code and place, of words of the vocabulary alone."""
    named = coded.select("slice", F.posexplode("words").alias("code", "word"))
    named = named.join(vocabulary.select("word", _place(bases).alias("place")), "word")
    named = named.groupBy("slice").agg(F.collect_list(F.struct("code", "place")).alias("m"))  # the different words of a slice
    return coded.drop("words").join(named.select("slice", F.col("m.code").alias("code"), F.col("m.place").alias("place")), "slice")


def _places(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of every word of a slice: its number (-1 without one) and its text."""
    codes, sizes = _numbers(row["codes"]) - 1, _numbers(row["sizes"])
    of = np.full(max(int(codes.max(initial=-1)), int(row["code"].max(initial=-1))) + 2, -1, np.int64)  # the last stands for -1
    of[row["code"]] = row["place"]
    return of[codes], np.repeat(np.arange(len(sizes)), sizes)


def _slices(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {"keys": batch.column("keys")[i].values} | {c: batch.column(c)[i].as_py() for c in ("codes", "sizes")} | {
                c: batch.column(c)[i].values.to_numpy() for c in ("code", "place")}


# ---- the matrix in blocks

@dataclass
class Blocks:
    """Where the matrix lies: counts by part and strip, and the sums of the rows by strip."""

    counts: str
    size: int
    per: int  # bands of a part
    bases: np.ndarray
    sums: str = ""
    whole: float = 0.0

    @property
    def bands(self) -> int:
        return -(-self.size // BAND)

    @property
    def parts(self) -> int:
        return -(-self.bands // self.per)

    def strips(self) -> Iterator[tuple[int, int]]:
        """Strips and how many rows each has."""
        for s in range(-(-self.size // STRIP)):
            yield s, min(STRIP, self.size - s * STRIP)

    def cells(self, part: int, strip: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row (in its part), column (in its strip) and count of the cells of a block, a band at a time, by rows."""
        for r in _rows(f"{self.counts}/part={part}/strip={strip}"):
            key = np.cumsum(_numbers(r["cells"]))
            yield (key >> STRIP_BITS) + (r["band"] - part * self.per) * BAND, key & (STRIP - 1), _numbers(r["n"])

    def own(self, folder: str, part: int, width: int) -> np.ndarray:
        """The rows of a part out of a table in strips."""
        first, last = part * self.per * BAND, min((part + 1) * self.per * BAND, self.size)
        s = first >> STRIP_BITS
        return _strip(folder, s, min(STRIP, self.size - s * STRIP), width)[first - s * STRIP:last - s * STRIP]

    def values(self, part: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Strip, row, column and value of the positive cells of a part."""
        rows = self.own(self.sums, part, 1)[:, 0]
        for s, n in self.strips():
            columns = _strip(self.sums, s, n, 1)[:, 0]
            for a, b, n_pairs in self.cells(part, s):
                v = np.log(n_pairs * self.whole / (rows[a] * columns[b]))
                keep = v > 0
                yield s, a[keep], b[keep], v[keep]

    def each(self, spark: SparkSession, work: Callable[[int], np.ndarray], name: str) -> DataFrame:
        """What ``work`` gives for the rows of every part, as a written table in strips."""
        per = self.per

        def run(batches):
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    first = part * per * BAND
                    found = work(part)
                    for lo in range(0, len(found), BAND):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([(first + lo) >> STRIP_BITS], pa.int32()), pa.array([first + lo]),
                             pa.array([np.ascontiguousarray(found[lo:lo + BAND], np.float64).tobytes()])], ["strip", "first", "q"])

        tasks = spark.range(0, self.parts, 1, max(1, self.parts))
        return _parted(tasks.mapInArrow(run, "strip int, first long, q binary"), name, "strip")


def _counted(placed: DataFrame, reach: int, per: int) -> DataFrame:
    """Written table (part, strip, band, cells, n): how often two words are near, both ways."""
    def pairs(batches):
        for row in _slices(batches):
            place, text = _places(row)
            found = []
            for d in range(1, reach + 1):
                a, b = place[:-d], place[d:]
                near = (text[:-d] == text[d:]) & (a >= 0) & (b >= 0)
                a, b = a[near], b[near]
                for x, y in ((a, b), (b, a)):
                    # band, strip, row, column; the band is cut off below
                    found.append(((x >> BAND_BITS) << 46) | ((y >> STRIP_BITS) << 31) | ((x & (BAND - 1)) << STRIP_BITS) | (y & (STRIP - 1)))
            key, n = np.unique(np.concatenate(found), return_counts=True)
            band = key >> 46
            cuts = np.flatnonzero(np.diff(band, prepend=-1, append=-1)) if len(key) else np.zeros(1, np.int64)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([band[lo]], pa.int32()), pa.array([_squeezed(np.diff(key[lo:hi] - (band[lo] << 46), prepend=0))]),
                     pa.array([_squeezed(n[lo:hi])])], ["band", "cells", "n"])

    def merged(keys, counts):
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")  # runs that are in order already
        key, n = key[order], np.concatenate(counts)[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return key[first], np.add.reduceat(n, first)

    def pieces(band, keys, counts):
        key, n = merged(keys, counts)
        strip = key >> 31
        cuts = np.flatnonzero(np.diff(strip, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield pa.RecordBatch.from_arrays(
                [pa.array([band // per], pa.int32()), pa.array([strip[lo]], pa.int32()), pa.array([band], pa.int32()),
                 pa.array([_squeezed(np.diff(key[lo:hi] - (strip[lo] << 31), prepend=0))]), pa.array([_squeezed(n[lo:hi])])],
                ["part", "strip", "band", "cells", "n"])

    def sums(batches):
        held, keys, counts = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if held is not None and r["band"] != held:
                    yield from pieces(held, keys, counts)
                    keys, counts = [], []
                held = r["band"]
                keys.append(np.cumsum(_numbers(r["cells"])))
                counts.append(_numbers(r["n"]))
                if sum(map(len, keys[1:])) > max(MERGED, len(keys[0])):
                    key, n = merged(keys, counts)
                    keys, counts = [key], [n]
        if held is not None:
            yield from pieces(held, keys, counts)

    dealt = placed.mapInArrow(pairs, "band int, cells binary, n binary").repartition("band").sortWithinPartitions("band")
    return _parted(dealt.mapInArrow(sums, "part int, strip int, band int, cells binary, n binary"), "vector_pairs", "part", "strip")


def _matrix(placed: DataFrame, vocabulary: DataFrame, bases: list[int], reach: int) -> DataFrame:
    """(a, b, v): positive mutual information, read from blocks; they are its attribute ``blocks``."""
    spark, size = vocabulary.sparkSession, bases[-1]
    per = 1
    while per * BAND < STRIP and -(-size // BAND) // (per * 2) >= spark.sparkContext.defaultParallelism:
        per *= 2
    counts = _counted(placed, reach, per)
    blocks = Blocks(counts.scratch, size, per, np.array(bases, np.int64))

    def row_sums(part):
        out = np.zeros((min(blocks.per * BAND, size - part * blocks.per * BAND), 1))
        for s, _ in blocks.strips():
            for a, _, n in blocks.cells(part, s):
                out[:, 0] += np.bincount(a, weights=n, minlength=len(out))
        return out

    sums = blocks.each(spark, row_sums, "vector_sums")

    def totals(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(sum(np.frombuffer(q).sum() for q in batch.column("q").to_pylist()))])], ["x"])

    whole = sums.select("q").mapInArrow(totals, "x double").agg(F.sum("x")).first()[0]
    blocks = Blocks(counts.scratch, size, per, blocks.bases, sums.scratch, whole or 0.0)

    def run(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                for s, a, b, v in blocks.values(part):
                    a, b = (_ids(x, blocks.bases) for x in (a + part * blocks.per * BAND, b + s * STRIP))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(v)], ["a", "b", "v"])

    matrix = spark.range(0, blocks.parts, 1, max(1, blocks.parts)).mapInArrow(run, "a long, b long, v double")
    matrix.blocks, matrix.backing = blocks, [counts, sums]
    return matrix


def cooccurrence(df: DataFrame, words: str, reach: int = REACH, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Tables (word, id, n) and (a, b, v): the vocabulary and positive mutual information of near words, both ways.

    A pair of different words is one cell above and one below the diagonal; a pair of
    equal words counts for both ways.
    """
    vocabulary, coded = _vocabulary(df, words, least), _coded(df, words, None)
    bases = _bases(vocabulary)
    matrix = _matrix(_placed(coded, vocabulary, bases), vocabulary, bases, reach)
    removed(coded)
    return vocabulary, matrix


# ---- directions

def _inner(block: DataFrame, width: int, other: DataFrame | None = None) -> np.ndarray:
    """The sum of q q^T over all rows, or of q and the same rows of ``other``: a small matrix, in part in every task."""
    folder = None if other is None else other.scratch

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for strip, first, q in zip(*(batch.column(c).to_pylist() for c in ("strip", "first", "q"))):
                q = o = np.frombuffer(q).reshape(-1, width)
                if folder:
                    at = first - strip * STRIP
                    o = _strip(folder, strip, STRIP, width)[at:at + len(q)]
                total += q.T @ o
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["i", "x"])

    with shuffles_removed(block.sparkSession), small_batches(block.sparkSession):
        sums = block.select("strip", "first", "q").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(width * width)
    for r in sums:
        out[r.i] = r.x
    return out.reshape(width, width)


def _turned(block: DataFrame, turn: np.ndarray) -> DataFrame:
    width = len(turn)

    def run(batches):
        for batch in batches:
            q = [(np.frombuffer(x).reshape(-1, width) @ turn).tobytes() for x in batch.column("q").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("strip"), batch.column("first"), pa.array(q, pa.binary())], ["strip", "first", "q"])

    return _parted(block.select("strip", "first", "q").mapInArrow(run, "strip int, first long, q binary"), "vector_block", "strip")


def _product(spark: SparkSession, blocks: Blocks, block: DataFrame, width: int) -> DataFrame:
    """The matrix times a block of column vectors."""
    folder = block.scratch

    def work(part):
        out = np.zeros((min(blocks.per * BAND, blocks.size - part * blocks.per * BAND), width))
        at, q = -1, None
        for s, a, b, v in blocks.values(part):
            if s != at:
                at, q = s, _strip(folder, s, min(STRIP, blocks.size - s * STRIP), width)
            for lo in range(0, len(a), CELLS):
                row = a[lo:lo + CELLS]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                out[row[first]] += np.add.reduceat(q[b[lo:lo + CELLS]] * v[lo:lo + CELLS, None], first, axis=0)
        return out

    return blocks.each(spark, work, "vector_block")


def _start(vocabulary_ids: Callable[[np.ndarray], np.ndarray], blocks: Blocks, spark: SparkSession, width: int, seed: int) -> DataFrame:
    """Start vectors from a hash of the row's id; rows without cells are zero."""
    draw = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.pmod(F.xxhash64(F.lit(seed), i, F.col("id")), F.lit(1 << 20)) / F.lit(float(1 << 19)) - 1.0)

    def ids(batches):
        for batch in batches:
            place = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(vocabulary_ids(place))], ["place", "id"])

    def run(batches):
        for batch in batches:
            place = batch.column("place").to_numpy()
            q = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            cuts = np.flatnonzero((np.diff(place, prepend=-9) != 1) | (place % STRIP == 0)).tolist() + [len(place)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place[lo] >> STRIP_BITS], pa.int32()), pa.array([place[lo]]), pa.array([q[lo:hi].tobytes()])], ["strip", "first", "q"])

    drawn = spark.range(0, blocks.size, 1, max(1, blocks.parts)).mapInArrow(ids, "place long, id long").select("place", draw.alias("q"))
    drawn = _parted(drawn.mapInArrow(run, "strip int, first long, q binary"), "vector_block", "strip")
    folder = drawn.scratch

    def work(part):
        out = blocks.own(folder, part, width)
        met = np.zeros(len(out), bool)
        for _, a, _, _ in blocks.values(part):
            met[a] = True
        return out * met[:, None]

    block = blocks.each(spark, work, "vector_block")
    removed(drawn)
    return block


def _directions(blocks: Blocks, spark: SparkSession, size: int, rounds: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """The leading directions in strips, and their values."""
    width, bases = size + SPARE, blocks.bases
    block = _start(lambda place: _ids(place, bases), blocks, spark, width, seed)

    def orthonormal(block):
        values, turn = np.linalg.eigh(_inner(block, width))
        keep = values > values.max(initial=0.0) * 1e-13
        scale = np.where(keep, 1.0 / np.sqrt(np.where(keep, values, 1.0)), 0.0)
        return _turned(block, turn * scale)

    for _ in range(rounds):
        for step in (orthonormal, orthonormal, lambda b: _product(spark, blocks, b, width)):  # twice, for the digits that one pass loses
            after = step(block)
            removed(block)
            block = after
    for _ in range(2):
        after = orthonormal(block)
        removed(block)
        block = after
    image = _product(spark, blocks, block, width)
    small = _inner(block, width, image)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values))[:size]
    out = _turned(block, turn[:, order])
    removed(block, image)
    return out, values[order]


def leading_directions(matrix: DataFrame, size: int, rounds: int = ROUNDS, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(id, q) and values: the ``size`` largest eigenvalues in absolute value of the matrix of :func:`cooccurrence` and their vectors.

    Start vectors follow from a hash of the row's id, so the result repeats.
    """
    block, values = _directions(matrix.blocks, matrix.sparkSession, size, rounds, seed)
    bases, width = matrix.blocks.bases, size

    def run(batches):
        for batch in batches:
            for first, q in zip(batch.column("first").to_pylist(), batch.column("q").to_pylist()):
                q = np.frombuffer(q).reshape(-1, width)
                at = np.flatnonzero(q.any(axis=1))  # words without cells have no row
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_ids(first + at, bases)), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(q[at].ravel()))],
                    ["id", "q"])

    out = written(block.select("first", "q").mapInArrow(run, "id long, q array<double>"), "vector_directions")
    removed(block)
    return out, values


# ---- texts

def _weights(vocabulary: DataFrame, bases: list[int]) -> DataFrame:
    """How much a word counts, in strips like the directions."""
    whole = vocabulary.agg(F.sum("n").cast("double")).scalar()
    named = vocabulary.select(_place(bases).alias("place"), (COMMON / (COMMON + F.col("n") / whole)).alias("x"))

    def run(batches):
        for batch in batches:
            place, x = (batch.column(c).to_numpy() for c in ("place", "x"))
            cuts = np.flatnonzero((np.diff(place, prepend=-9) != 1) | (place % STRIP == 0)).tolist() + [len(place)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place[lo] >> STRIP_BITS], pa.int32()), pa.array([place[lo]]), pa.array([x[lo:hi].tobytes()])], ["strip", "first", "q"])

    return _parted(named.mapInArrow(run, "strip int, first long, q binary"), "vector_weights", "strip")


def sentence_vectors(df: DataFrame, words: str, key: str = "review_id", size: int = 32, reach: int = REACH, seed: int = 42) -> DataFrame:
    """(key, embedding): a vector of length one for every text, null for texts without a word of the vocabulary.

    A word's vector is its row of the leading directions, each scaled by the root of its
    value; a text's is their mean, in which frequent words count less. Rows that share a key are one text.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    vocabulary, coded = _vocabulary(df, words, LEAST), _coded(df, words, key)
    bases = _bases(vocabulary)
    placed = written(_placed(coded, vocabulary, bases), "vector_places", rows_per_file=4)
    removed(coded)
    matrix = _matrix(placed, vocabulary, bases, reach)
    blocks = matrix.blocks
    directions, values = _directions(blocks, spark, size, ROUNDS, seed)
    removed(*matrix.backing)
    weights = _weights(vocabulary, bases)
    q_at, w_at, root = directions.scratch, weights.scratch, np.sqrt(np.abs(values))

    def run(batches):
        def summed(slices):
            read = [(r["keys"], *_places(r)) for r in slices]
            out = [np.zeros((len(keys), size)) for keys, _, _ in read]
            order = [np.argsort(place, kind="stable") for _, place, _ in read]
            for s, n in blocks.strips():
                q = _strip(q_at, s, n, size) * root * _strip(w_at, s, n, 1)
                for (_, place, text), total, by in zip(read, out, order):
                    lo, hi = np.searchsorted(place, [s * STRIP, (s + 1) * STRIP], sorter=by)
                    at = np.sort(by[lo:hi])
                    for k in range(0, len(at), CELLS):
                        some = at[k:k + CELLS]
                        first = np.flatnonzero(np.diff(text[some], prepend=-1))
                        total[text[some][first]] += np.add.reduceat(q[place[some] - s * STRIP], first, axis=0)
            for (keys, place, text), total in zip(read, out):
                known = np.zeros(len(keys), bool)
                known[text[place >= 0]] = True
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * size), pa.array(total.ravel()))],
                    ["key", "s"]).filter(pa.array(known))

        held = []
        for row in _slices(batches):
            held.append(row)
            if len(held) == SLICES_AT_ONCE:
                yield from summed(held)
                held = []
        if held:
            yield from summed(held)

    rows = placed.mapInArrow(run, f"key {kind}, s array<double>")
    sums = F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(size)])
    found = written(rows.groupBy(F.col("key").alias(key)).agg(sums.alias("s")), "sentence_vectors")
    removed(vocabulary, placed, directions, weights)
    length = F.sqrt(F.aggregate("s", F.lit(0.0), lambda t, x: t + x * x))
    unit = found.select(key, F.when(length > 0, F.transform("s", lambda x: x / length)).alias("embedding"))
    return df.select(key).join(unit, key, "left")

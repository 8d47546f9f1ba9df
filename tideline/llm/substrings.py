"""Substring dedup by difference-cover anchors.

Every pair of residues modulo 21 has a common shift into the cover {0, 1, 4, 14, 16}: for
word positions i and j there is a d < 21 with i + d and j + d both at cover positions. So
two equal windows of at least 21 + w - 1 words share an aligned anchor, a run of w words
that starts at a cover position in both places, and only a quarter of all runs is hashed
into the shuffle. Repeated anchors are then extended: every window that contains one is
hashed whole and counted, which is linear however often a passage occurs.

Equal texts are read as one; each window of theirs occurs elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm import words as W
from tideline.llm.tables import bits_hold, id_bits, maybe_in, saved

PERIOD = 21
COVER = (0, 1, 4, 14, 16)  # the differences of these give every residue modulo 21


def _anchors_of(words: W.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the anchors of texts long enough for a window."""
    found, begin = words.windows(words.hashes(), width - PERIOD + 1)
    place = begin - words.first[:-1][words.row[begin]]
    use = np.isin(np.arange(PERIOD), COVER)[place % PERIOD] & (words.per_row[words.row[begin]] >= width)
    return found[use], begin[use]


def _posted(texts: DataFrame, width: int, without: np.ndarray | None = None) -> DataFrame:
    """(anchor, key) of every anchor of every text, but for texts that ``without`` may hold."""
    bits = texts.sparkSession.sparkContext.broadcast(without)

    def run(batches):
        for batch in batches:
            if bits.value is not None:
                batch = batch.filter(pa.array(~bits_hold(batch.column("h1"), bits.value)))
            key = batch.column("key").to_numpy()
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                words = W.words_of(data, offsets)
                found, begin = _anchors_of(words, width)
                yield pa.RecordBatch.from_arrays(
                    [W.longs(found), pa.array(key[lo:hi][words.row[begin]])], ["anchor", "key"])

    return texts.select("key", "text", "h1").mapInArrow(run, "anchor long, key int")


def _windows(texts: DataFrame, width: int) -> DataFrame:
    """(hash, check, h1, h2, place) of the windows that contain one of a text's repeated anchors."""
    length = width - PERIOD + 1

    def run(batches):
        for batch in batches:
            hits = batch.column("anchors")
            h_at, h = hits.offsets.to_numpy(), hits.values.to_numpy(zero_copy_only=False).view(np.uint64)
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                words = W.words_of(data, offsets)
                found, begin = _anchors_of(words, width)
                hit = np.isin(found, h[h_at[lo]:h_at[hi]])
                marks = np.zeros(len(words.start) + 2, np.int64)
                marks[begin[hit] + 1] = 1
                before = np.cumsum(marks)
                hashes = words.hashes()
                whole, begin = words.windows(hashes, width)
                use = before[begin + width - length + 1] > before[begin]  # an anchor starts and ends inside
                whole, begin = whole[use], begin[use]
                second = W.run_hashes(W.mix(~hashes), begin, begin + width)
                row = words.row[begin]
                yield pa.RecordBatch.from_arrays([
                    W.longs(whole), pa.array(second.astype(np.uint32).view(np.int32)),
                    pa.array(h1[lo:hi][row]), pa.array(h2[lo:hi][row]),
                    pa.array((begin - words.first[:-1][row]).astype(np.int32)),
                ], ["hash", "check", "h1", "h2", "place"])

    return texts.select("h1", "h2", "text", "anchors").mapInArrow(
        run, "hash long, check int, h1 long, h2 long, place int")


def _joined(words: W.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of each row's kept words, joined by one blank."""
    row = words.row[keep]
    lead = np.zeros(len(row), np.int64)  # 1 where a blank precedes
    lead[1:] = row[1:] == row[:-1]
    sizes = (words.end - words.start)[keep] + lead
    flat = W.gather(np.concatenate([[np.uint8(32)], words.data]), words.start[keep] + 1 - lead, sizes).copy()
    flat[(np.cumsum(sizes) - sizes)[lead == 1]] = 32
    ends = np.bincount(row, weights=sizes, minlength=len(words.first) - 1).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(ends)])


def _cut(docs: DataFrame, width: int, schema: T.StructType, without: np.ndarray | None = None) -> DataFrame:
    """docs with kept_text, n_words, n_removed from __gone and __starts, the words of windows that go."""
    names = schema.names
    bits = docs.sparkSession.sparkContext.broadcast(without)

    def run(batches):
        for batch in batches:
            if bits.value is not None:
                batch = batch.filter(pa.array(~bits_hold(batch.column("__h1"), bits.value)))
            gone = batch.column("__gone").to_numpy(zero_copy_only=False)
            marks = batch.column("__starts")
            m_at, m = marks.offsets.to_numpy(), marks.values.to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                words = W.words_of(data, offsets)
                cover = np.zeros(len(words.start) + width + 1, np.int64)
                at = m[m_at[lo]:m_at[hi]] + np.repeat(words.first[:-1], np.diff(m_at[lo:hi + 1]))
                np.add.at(cover, at, 1)
                np.add.at(cover, at + width, -1)
                removed = np.cumsum(cover)[:len(words.start)] > 0
                removed |= (gone[lo:hi] & (words.per_row >= width))[words.row]
                flat, ends = _joined(words, ~removed)
                columns = dict(zip(batch.schema.names, batch.slice(lo, hi - lo).columns))
                columns |= {"kept_text": W.as_text(flat, ends), "n_words": W.longs(words.per_row),
                            "n_removed": W.longs(np.bincount(words.row[removed], minlength=hi - lo))}
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return docs.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """docs with kept_text, n_words and n_removed: repeated windows of ``width`` words are cut out.

    A window is ``width`` consecutive words of one row's text; every word covered by a
    window whose words also start anywhere else, in the same row or another, is removed,
    judged on the input. Kept words are unchanged and joined by one blank. Null texts
    count as empty and give an empty kept_text. Only texts decide: rows are told apart by
    nothing else, so repeated rows, equal or null ids are ordinary rows. Other columns are
    passed on; those named like the new ones are replaced. ``width`` is at least 21.
    """
    if width < PERIOD:
        raise ValueError(f"width must be at least {PERIOD} words")
    docs = docs.select(*[c for c in docs.columns if c not in ("kept_text", "n_words", "n_removed")])
    h1 = F.xxhash64("text")
    texts = docs.where("text IS NOT NULL").select(
        "text", h1.alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.hash("text").alias("key"))
    copies = saved(texts.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "copies")
    many = id_bits(copies, "h1")
    repeated = maybe_in(texts, "h1", many).dropDuplicates(["h1", "h2"])
    posted = _posted(texts, width, many).unionByName(_posted(repeated, width))
    often = posted.groupBy("anchor").count().where("count > 1").select("anchor")
    hits = posted.join(often, "anchor", "left_semi").groupBy("key").agg(F.collect_set("anchor").alias("anchors"))
    hits = saved(hits, "hits")
    known = id_bits(hits, "key")
    # copies of a text are one again, whether or not they were told apart above
    read = maybe_in(texts, "key", known).dropDuplicates(["h1", "h2"]).join(hits, "key")
    windows = saved(_windows(read, width), "windows")
    twice = windows.groupBy("hash", "check").count().where("count > 1").select("hash", "check")
    starts = windows.join(twice, ["hash", "check"], "left_semi").groupBy("h1", "h2").agg(
        F.collect_list("place").alias("__starts"))
    gone = starts.join(copies.withColumn("__gone", F.lit(True)), ["h1", "h2"], "full")
    gone = saved(gone.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"),
                             F.coalesce("__gone", F.lit(False)).alias("__gone"),
                             F.coalesce("__starts", F.array().cast("array<int>")).alias("__starts")), "gone")

    schema = T.StructType([*docs.schema.fields, T.StructField("kept_text", T.StringType()),
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    keyed = docs.withColumns({"__h1": h1, "__h2": F.xxhash64(F.lit(1), "text")})
    touched = id_bits(gone, "__h1")
    rest = keyed.withColumns({"__gone": F.lit(False), "__starts": F.array().cast("array<int>")})
    hit = maybe_in(keyed, "__h1", touched).join(gone, ["__h1", "__h2"], "left").withColumns(
        {"__gone": F.coalesce("__gone", F.lit(False)), "__starts": F.coalesce("__starts", F.array().cast("array<int>"))})
    return _cut(rest, width, schema, touched).unionByName(_cut(hit, width, schema))

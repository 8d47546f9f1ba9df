"""Byte-level BPE encoding and decoding by batched merge rounds in numpy.

The symbols of all words that a worker has not met yet lie in one flat array. In a round
every neighbouring pair is looked up by binary search among the sorted keys of the merge
table; every word merges all places of its lowest-ranked pair, from left to right where
they overlap; finished words leave the array. A merge makes a symbol that no earlier merge
makes, so merging all places of a pair at once equals merging them one by one. After the
first round only pairs beside a merge are looked up again.

Texts are cut into words on arrays of code points: by runs of letters, numbers, white space
and other characters, a blank joining the word after it, and the seven short endings after
an apostrophe. Added tokens of the vocabulary found in a text are one id each.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tideline.llm import words as W

LETTER, NUMBER, OTHER, SPACE, ADDED = range(5)
# Bytes that stand for themselves in the vocabulary, as ranges; the others follow from U+0100 on.
PLAIN_BYTES = [(33, 126), (161, 172), (174, 255)]
# Endings after an apostrophe that are words of their own.
SHORT_ENDINGS = ("s", "t", "m", "d")
LONG_ENDINGS = ("re", "ve", "ll")
NO_RANK = np.iinfo(np.int32).max
REMEMBERED = 400_000  # words that a worker remembers
SLICE = 1 << 19


@dataclass
class Vocabulary:
    """Ids of single bytes, the sorted merge table, the bytes of every id, added tokens, and character classes."""

    byte_ids: np.ndarray
    keys: np.ndarray  # left id * 2**32 + right id, ascending
    ranks: np.ndarray  # of the keys
    merged: np.ndarray  # id by rank
    flat: np.ndarray
    offsets: np.ndarray
    added: dict[str, int]
    classes: np.ndarray

    @property
    def name(self) -> str:
        return f"bpe_{zlib.crc32(self.flat.tobytes())}_{zlib.crc32(self.keys.tobytes())}"


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every code point, as the tokenizers library sees it.

    Letters and numbers follow from the general category. Only characters that Python's
    tables do not have yet, and the regex module's have, are tried on the library itself.
    """
    from tokenizers import pre_tokenizers

    classes = np.full(0x110000, OTHER, np.uint8)
    fresh = []
    newer = regex.compile(r"[\p{L}\p{N}]")
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            classes[c] = LETTER
        elif kind[0] == "N":
            classes[c] = NUMBER
        elif kind == "Cn" and newer.match(chr(c)):
            fresh.append(c)
    spaces = [c for c in range(0x3001) if regex.match(r"\s", chr(c))]
    classes[spaces] = SPACE
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    starts = {a for _, (a, _) in cut.pre_tokenize_str("".join(f"\na{chr(c)}1" for c in fresh))}
    for i, c in enumerate(fresh):
        if 4 * i + 2 not in starts:
            classes[c] = LETTER
        elif 4 * i + 3 not in starts:
            classes[c] = NUMBER
    return classes


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a tokenizers file: byte-level BPE without normaliser, prefix blank or dropout."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    model, cut = content["model"], content["pre_tokenizer"] or {}
    plain = (model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
             and content["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
             and not cut.get("add_prefix_space") and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix")))
    added = {t["content"]: t["id"] for t in content["added_tokens"]}
    if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in content["added_tokens"]):
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
    octet = {chr(b): b for a, z in PLAIN_BYTES for b in range(a, z + 1)}
    octet |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(octet.values())))}
    ids = model["vocab"]
    spelled: list[bytes] = [b""] * (max([*ids.values(), *added.values()]) + 1)
    for token, i in ids.items():
        spelled[i] = bytes(octet[c] for c in token) if all(c in octet for c in token) else token.encode()
    for token, i in added.items():
        spelled[i] = token.encode()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    by_byte = {b: c for c, b in octet.items()}
    return Vocabulary(
        np.array([ids[by_byte[b]] for b in range(256)], np.int64), keys[order], order.astype(np.int32),
        np.array([ids[a + b] for a, b in pairs], np.int64), np.frombuffer(b"".join(spelled), np.uint8),
        np.concatenate([[0], np.cumsum([len(s) for s in spelled])]), added, character_classes())


def word_starts(codes: np.ndarray, classes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where words begin among code points of ``classes``; ``edge`` marks the first of a text or added token."""
    n = len(codes)
    start = edge.copy()
    start[1:] |= classes[1:] != classes[:-1]
    # White space before another character: its last one goes alone, or with the word if it is a blank.
    after = 1 + np.flatnonzero(~edge[1:] & (classes[1:] < SPACE) & (classes[:-1] == SPACE))
    start[after - 1] = True
    start[after] = codes[after - 1] != 32
    mark = np.flatnonzero((codes == 39) & start)
    if len(mark):
        def next_is(step, letters):
            at = np.minimum(mark + step, n - 1)
            return (mark + step < n) & ~edge[at] & np.isin(codes[at], [ord(c) for c in letters])

        short = next_is(1, SHORT_ENDINGS)
        long = np.zeros(len(mark), bool)
        for one, two in LONG_ENDINGS:
            long |= next_is(1, one) & next_is(2, two)
        start[mark[short | long] + 1] = False
        end = np.concatenate([mark[short] + 2, mark[long] + 3])
        start[end[end < n]] = True
    return np.flatnonzero(start)


def _lookup(vocabulary: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ranks of pairs; a pair that never merges has none."""
    wanted = left << 32 | right
    place = np.minimum(np.searchsorted(vocabulary.keys, wanted), len(vocabulary.keys) - 1)
    return np.where(vocabulary.keys[place] == wanted, vocabulary.ranks[place], NO_RANK).astype(np.int32)


def merge_words(vocabulary: Vocabulary, octets: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words given as their bytes one after the other and their sizes: flat ids, and how many each has."""
    symbol = vocabulary.byte_ids[octets]
    word = np.repeat(np.arange(len(size)), size)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    if not len(vocabulary.keys):
        return symbol.astype(np.uint32), size.astype(np.int64)
    rank = np.full(len(symbol), NO_RANK, np.int32)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner] = _lookup(vocabulary, symbol[inner], symbol[inner + 1])
    while len(symbol):
        first = np.concatenate([[0], 1 + np.flatnonzero(word[1:] != word[:-1])])
        lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
        over = lowest == NO_RANK
        if over.any():
            done.append((word[over], symbol[over]))
            on = ~over
            word, symbol, rank, lowest = word[on], symbol[on], rank[on], lowest[on]
            if not len(word):
                break
        at = np.flatnonzero(rank == lowest)
        fresh = np.ones(len(at), bool)
        fresh[1:] = at[1:] != at[:-1] + 1
        head = np.flatnonzero(fresh)
        at = at[(np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))) % 2 == 0]  # every other of a run
        symbol[at] = vocabulary.merged[rank[at]]
        stay = np.ones(len(symbol), bool)
        stay[at + 1] = False
        symbol, word, rank = symbol[stay], word[stay], rank[stay]
        new = at - np.arange(len(at))
        touched = np.unique(np.concatenate([new, new[new > 0] - 1]))
        rank[touched] = NO_RANK
        touched = touched[touched + 1 < len(word)]
        touched = touched[word[touched] == word[touched + 1]]
        rank[touched] = _lookup(vocabulary, symbol[touched], symbol[touched + 1])
    if not done:
        return np.zeros(0, np.uint32), np.zeros(len(size), np.int64)
    owner = np.concatenate([w for w, _ in done])
    flat = np.concatenate([s for _, s in done])
    return flat[np.argsort(owner, kind="stable")].astype(np.uint32), np.bincount(owner, minlength=len(size)).astype(np.int64)


def _as_utf8(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


class Encoder:
    """Encodes texts word by word and remembers words; the oldest are forgotten when there are too many."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pattern = regex.compile("|".join(regex.escape(t) for t in sorted(vocabulary.added, key=len, reverse=True))) if vocabulary.added else None
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where words begin, and the added id that a word is, or -1."""
        text = data.tobytes().decode()
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begin = np.flatnonzero((data & 0xC0) != 0x80)  # of every character
        edge = np.zeros(len(codes) + 1, bool)
        first = np.searchsorted(begin, offsets)
        edge[first] = True
        classes = self.vocabulary.classes[codes]
        own = {}
        if self.pattern is not None and self.pattern.search(text):
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                for m in self.pattern.finditer(text[a:b]):
                    lo, hi = a + m.start(), a + m.end()
                    classes[lo:hi] = ADDED
                    edge[[lo, hi]] = True
                    own[lo] = self.vocabulary.added[m.group()]
        start = word_starts(codes, classes, edge[:-1])
        added = np.full(len(start), -1, np.int64)
        if own:
            added[np.searchsorted(start, list(own))] = list(own.values())
        return begin[start], added

    def _remember(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        at = len(self.flat) + np.cumsum(size) - size
        where = np.searchsorted(self.keys, keys)
        self.flat = np.concatenate([self.flat, ids])
        self.keys, self.at, self.size = (np.insert(a, where, b) for a, b in ((self.keys, keys), (self.at, at), (self.size, size)))

    def _keep(self, keys: np.ndarray) -> None:
        """Forget all words but those of ``keys``."""
        held = np.isin(self.keys, keys)
        self.flat = W.gather(self.flat, self.at[held], self.size[held])
        self.keys, self.size = self.keys[held], self.size[held]
        self.at = np.cumsum(self.size) - self.size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has; bytes that are no UTF-8 are replaced."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        try:
            start, added = self.words(data, offsets)
        except UnicodeDecodeError:
            data, offsets = _as_utf8(data, offsets)
            start, added = self.words(data, offsets)
        end = np.append(start[1:], len(data))
        table = W.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        hashes = W.run_hashes(table[data], start, end)
        hashes[added >= 0] ^= np.uint64(0x5851F42D4C957F2D)
        keys, first, group = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > REMEMBERED:
            self._keep(keys)
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(place, len(self.keys) - 1)] != keys
        if new.any():
            one = first[new]
            plain = added[one] < 0
            length = np.where(plain, end[one] - start[one], 0)
            ids, count = merge_words(self.vocabulary, W.gather(data, start[one], length), length)
            before = np.cumsum(count)[~plain]
            self._remember(keys[new], np.insert(ids, before, added[one][~plain].astype(np.uint32)), np.where(plain, count, 1))
        place = np.searchsorted(self.keys, keys)
        at, size = self.at[place][group], self.size[place][group]
        row = np.searchsorted(offsets, start, "right") - 1
        return W.gather(self.flat, at, size), np.bincount(row, weights=size, minlength=len(offsets) - 1).astype(np.int64)


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Texts of runs of ids, bytes that are no UTF-8 replaced; ids beyond the vocabulary have no bytes."""
    size = np.diff(vocabulary.offsets)
    known = ids < len(size)
    ids = np.where(known, ids, 0)
    length = np.where(known, size[ids], 0)
    raw = W.gather(vocabulary.flat, vocabulary.offsets[:-1][ids], length).tobytes()
    ends = np.concatenate([[0], np.cumsum(length)])[bounds]
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with the ids of every whole text as little-endian unsigned 32-bit integers in one binary.

    Null and empty texts have no ids. Rows are encoded where they are read, without a
    shuffle; repeated rows stay. Other columns pass unread, one named like the new one is
    replaced. A single word of n bytes takes a round for each different pair that it merges.
    """
    docs = docs.select(*[c for c in docs.columns if c != to])
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.BinaryType())])

    def run(batches):
        own = held.value
        encoder = W.worker_cache(own.name, lambda: Encoder(own))
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column(text), SLICE):
                ids, n = encoder.encode(data, offsets)
                bounds = np.concatenate([[0], np.cumsum(4 * n)])
                column = W.as_text(ids.astype("<u4").view(np.uint8), bounds, pa.large_binary()).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, column], schema.names)

    return docs.mapInArrow(run, schema)


def decode_texts(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """docs with the text of the ids, added tokens included; null ids give an empty text."""
    docs = docs.select(*[c for c in docs.columns if c != to])
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.StringType())])

    def run(batches):
        for batch in batches:
            column = batch.column(ids).cast(pa.large_binary())
            filled = column.fill_null(b"")
            at = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset:filled.offset + len(filled) + 1]
            lo = 0
            while lo < len(filled):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE, "right")) - 1)
                values = np.frombuffer(filled.buffers()[2], np.uint8)[at[lo]:at[hi]].view("<u4") if at[hi] > at[lo] else np.zeros(0, "<u4")
                texts = decode_ids(held.value, values, (at[lo:hi + 1] - at[lo]) // 4)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(texts, pa.string())], schema.names)
                lo = hi

    return docs.mapInArrow(run, schema)

"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings that are significantly more frequent in
toxic training texts. Words are compared without punctuation, in lower case and with
look-alike digits as letters, so that common obfuscations fall together. Features are
rates and counts only; nothing of a text's label, language, source or id enters them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm import words as W
from tideline.llm.tables import saved

SAMPLE_ROWS = 20_000  # labelled rows that the model is fitted on, at most (in expectation)
LEXICON_SIZE = 2_000  # entries of the learned lexicon, at most
LEAST_G = 25.0  # likelihood-ratio statistic an entry must reach
STEMS = (4, 5, 6, 7)  # bytes of the word beginnings in the lexicon
NEAR = 5  # words between an entry and a second person that count as near
# Second-person words, and digits that stand for letters.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine tu te toi ton ta vous votre tú ti usted vosotros".split()
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
FEATURES = ["log_words", "entry_rate", "entry_count", "entry_kinds", "entry_weight", "stem_rate", "stem_count", "stem_weight",
            "top_weight", "near_you_rate", "near_you", "you_rate", "capital_rate", "shout_rate", "mark_rate",
            "exclaim_rate", "digit_rate", "obfuscated_rate", "word_bytes"]


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Byte map to comparable letters, and which bytes are letters after it."""
    to = np.arange(256, dtype=np.uint8)
    to[65:91] += 32
    for a, b in LOOK_ALIKE.items():
        to[ord(a)] = ord(b)
    return to, ((to >= 97) & (to <= 122)) | (to >= 128)


def _byte_hashes(data, start, end):
    table = W.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return W.run_hashes(table[data], start, end)


def _plain_words(words: W.Words) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hash of each word's letters, and of its beginnings; 0 where there is none."""
    to, letter = _letters()
    mapped = to[words.data]
    keep = letter[mapped]
    before = np.concatenate([[0], np.cumsum(keep)])
    start, end = before[words.start], before[words.end]
    flat = mapped[keep]
    whole = np.where(end > start, _byte_hashes(flat, start, end), np.uint64(0))
    stems = []
    for size in STEMS:
        cut = np.minimum(start + size, end)
        stems.append(np.where(end - start >= size, _byte_hashes(flat, start, cut) ^ np.uint64(size), np.uint64(0)))
    return whole, stems


def _term_counts(docs: DataFrame) -> DataFrame:
    """(stem, term, toxic, rows): in how many toxic and other texts each word and beginning occurs."""
    def run(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for lo, hi, data, offsets in W.slices(batch.column("text"), W.SMALL_BYTES):
                words = W.words_of(data, offsets)
                whole, stems = _plain_words(words)
                for kind, terms in enumerate([whole, *stems]):
                    once, bounds = W.sorted_sets(terms, words.first)
                    row = np.repeat(np.arange(hi - lo), np.diff(bounds))
                    term, group = np.unique(once, return_inverse=True)
                    rows = np.bincount(group, minlength=len(term))
                    bad = np.bincount(group, weights=toxic[lo:hi][row], minlength=len(term)).astype(np.int64)
                    real = term != 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(int(real.sum()), kind > 0)), W.longs(term[real]), W.longs(bad[real]), W.longs(rows[real])],
                        ["stem", "term", "toxic", "rows"])

    counts = docs.select("text", "toxic").mapInArrow(run, "stem boolean, term long, toxic long, rows long")
    return counts.groupBy("stem", "term").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows"))


def _entries(counts: DataFrame, bad: int, total: int) -> DataFrame:
    """The strongest significant terms and their log odds."""
    k, n, p = F.col("toxic"), F.col("rows"), bad / total
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    g = 2 * (part(k, n * p) + part(n - k, n * (1 - p)))
    odds = F.log((k + 0.5) / (bad + 1)) - F.log((n - k + 0.5) / (total - bad + 1))
    scored = counts.select("stem", "term", g.alias("g"), odds.alias("odds")).where((F.col("g") >= LEAST_G) & (F.col("odds") > 1))
    return scored.orderBy(F.desc("g"), "term").limit(LEXICON_SIZE)


def _find(terms: np.ndarray, entries: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(entries):
        return np.zeros(len(terms))
    at = np.minimum(np.searchsorted(entries, terms), len(entries) - 1)
    return np.where(entries[at] == terms, weights[at], 0.0)


def _feature_rows(data, offsets, lexicon) -> np.ndarray:
    words = W.words_of(data, offsets)
    n, row, count = words.per_row, words.row, len(words.start)
    rows = len(n)
    per = lambda v: np.bincount(row, weights=v, minlength=rows)
    (entry, entry_w), (stem, stem_w) = lexicon
    whole, stems = _plain_words(words)
    hit = _find(whole, entry, entry_w)
    begun = np.max([_find(s, stem, stem_w) for s in stems], axis=0) if count else hit
    top = np.zeros(rows)
    np.maximum.at(top, row, np.maximum(hit, begun))
    found = np.flatnonzero(hit)
    pairs = np.unique(np.stack([row[found].astype(np.uint64), whole[found]]), axis=1)[0].astype(np.int64)
    kinds = np.bincount(pairs, minlength=rows)

    you = np.sort(_byte_hashes(*_listed(SECOND_PERSON)))
    second = _find(whole, you, np.ones(len(you))) > 0
    place = np.arange(count)
    marks = np.flatnonzero(second)
    near = np.zeros(count, bool)
    if len(marks):
        nxt = np.searchsorted(marks, place)
        for m in (marks[np.minimum(nxt, len(marks) - 1)], marks[np.maximum(nxt - 1, 0)]):
            near |= (np.abs(m - place) <= NEAR) & (row[m] == row)
    near &= (hit > 0) | (begun > 0)

    total = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    spans = lambda flags: (lambda t: t[words.end] - t[words.start])(total(flags))
    d = words.data
    capital, small = (d >= 65) & (d <= 90), (d >= 97) & (d <= 122)
    digit, high = (d >= 48) & (d <= 57), d >= 128
    mark = ~(capital | small | digit | high) & (d > 32)
    caps, letters, digits, odd = spans(capital), spans(capital | small | high), spans(digit), spans(mark | digit)
    size = words.end - words.start
    inner = np.zeros(len(d), bool)  # a sign or digit between two letters
    if len(d) > 2:
        alpha = capital | small | high
        inner[1:-1] = (mark | digit)[1:-1] & alpha[:-2] & alpha[2:]
    words_n, bytes_n = np.maximum(n, 1), np.maximum(per(size), 1)
    return np.stack([
        np.log1p(n), per(hit > 0) / words_n, per(hit > 0), kinds, per(hit) / words_n,
        per(begun > 0) / words_n, per(begun > 0), per(begun) / words_n, top,
        per(near) / words_n, per(near), per(second) / words_n,
        per(caps) / np.maximum(per(letters), 1), per((caps == letters) & (letters > 1)) / words_n,
        per(spans(mark)) / bytes_n, per(spans(d == 33)) / words_n, per(digits) / bytes_n,
        per((spans(inner) > 0) & (odd > 0)) / words_n, per(size) / words_n,
    ], axis=1)


def _listed(texts: list[str]):
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    return np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends


def with_features(docs: DataFrame, lexicon: list[tuple[bool, int, float]]) -> DataFrame:
    """docs with ``__features``, one array for each row."""
    def side(stem):
        chosen = sorted((np.uint64(t & (2**64 - 1)), w) for s, t, w in lexicon if s == stem)
        return np.array([t for t, _ in chosen], np.uint64), np.array([w for _, w in chosen], float)

    sides = side(False), side(True)
    schema = T.StructType([*docs.schema.fields, T.StructField("__features", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            done = [_feature_rows(data, offsets, sides) for _, _, data, offsets in W.slices(batch.column("text"))]
            flat = np.concatenate(done) if done else np.zeros((0, len(FEATURES)))
            bounds = np.arange(len(flat) + 1) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, W.lists(flat.ravel(), bounds, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)


@dataclass
class ToxicityModel:
    """A fitted model; ``trees`` is None where the labels held one class or none."""

    lexicon: list[tuple[bool, int, float]]
    rate: float
    trees: object = None
    calibration: object = None

    def score(self, docs: DataFrame) -> DataFrame:
        """docs with a double ``score``. Calibrated probabilities have ties; the trees' own order breaks them."""
        if self.trees is None:
            return docs.withColumn("score", F.lit(self.rate))
        rows = with_features(docs.drop("score"), self.lexicon).withColumn("__vector", array_to_vector("__features"))
        rows = self.trees.transform(rows).withColumn("__raw", vector_to_array("__probability")[1])
        score = F.col("__raw")
        if self.calibration is not None:
            rows = self.calibration.transform(rows)
            score = 0.99 * F.col("__calibrated") + 0.01 * F.col("__raw")
        kept = [c for c in docs.columns if c != "score"]
        return rows.select(*kept, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"))


def trainable(key: str = "doc_id") -> Column:
    """Whether a row's label may be learned from; the others are held out. A null id is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = 20,
                 depth: int = 3, seed: int = 7) -> ToxicityModel:
    """Fit on a bounded, hashed sample of labelled rows outside the held-out quarter.

    Three quarters of the sample grow the lexicon and the trees, the rest calibrates them.
    Rows of labels without id or label are left out; an id labelled twice counts as toxic
    if either says so. With one class only, every text gets that class's smoothed rate.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(trainable())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = known.count()
    share = min(1.0, sample_rows / max(total, 1))
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20))
    chosen = saved(known.where(place < math.ceil(share * (1 << 20))), "labelled")
    # sample_rows ids and labels in expectation, whatever the size of the tables
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = saved(rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(4))), "sample")
    fit = rows.where("fold > 0")
    n, bad = fit.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rate = (bad + 0.5) / (n + 1) if n else 0.0
    if bad in (0, n):
        return ToxicityModel([], rate)
    entries = _entries(_term_counts(fit), bad, n)
    lexicon = [(r.stem, r.term, r.odds) for r in entries.collect()]  # LEXICON_SIZE rows
    ready = with_features(rows, lexicon).select(
        array_to_vector("__features").alias("__vector"), F.col("toxic").cast("double").alias("toxic"), "fold")
    ready = saved(ready, "features")
    boosting = GBTClassifier(featuresCol="__vector", labelCol="toxic", predictionCol="__class", maxIter=trees, maxDepth=depth,
                             stepSize=0.3, seed=seed, minInstancesPerNode=5)
    boosting.setRawPredictionCol("__margin").setProbabilityCol("__probability")
    model = boosting.fit(ready.where("fold > 0").coalesce(2))
    held = model.transform(ready.where("fold = 0")).withColumn("__raw", vector_to_array("__probability")[1])
    both = held.agg(F.count("*"), F.sum("toxic")).first()
    calibration = None
    if both[0] and 0 < both[1] < both[0]:
        calibration = IsotonicRegression(featuresCol="__raw", labelCol="toxic", predictionCol="__calibrated").fit(held)
    return ToxicityModel(lexicon, rate, model, calibration)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 from ``threshold``), for every whole text.

    Null and empty texts are scored like a text without words. Existing columns with the
    new names are replaced; others are passed on, unread.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("held_out", "score", "predicted")])
    scored = fit_toxicity(docs, labels, **options).score(docs)
    return scored.select(*docs.columns, (~trainable()).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))

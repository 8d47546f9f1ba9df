"""Classifiers as count tables and joins: naive Bayes, language by letter groups, induced lexica, scoped polarity.

A model is a table with one row a feature, so its size is bounded by storage and not by a
driver or a broadcast; labels are few and stand side by side in an array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.labels import POLARITY_CUT, polarity_label
from tideline.functions.numbers import as_col, half_even

ALPHA = 1.0  # added to every count
GRAM = 3
# Parameters of scoped polarity.
NEGATION_REACH = 3  # words that a negation reaches
NEGATED = -0.5  # what it makes of a weight
NEGATIONS = ("not", "no", "never", "without", "nicht", "kein", "keine", "nie", "ohne", "ne", "pas", "jamais", "sans", "nunca", "sin", "non", "mai", "senza")
DEGREES = {"very": 1.3, "sehr": 1.3, "très": 1.3, "muy": 1.3, "molto": 1.3, "slightly": 0.5, "etwas": 0.5, "peu": 0.5, "poco": 0.5}
SPAN_ENDS = (".", ",", ";", ":", "!", "?", "but", "aber", "mais", "pero", "ma")


def word_counts(df: DataFrame, key: str, words: str, *others: str) -> DataFrame:
    """(key, others, feature, n): how often each word occurs in each row, counted where the row is read; rows that share a key stay apart.

    Null words are left out.
    """
    rows = df.select(key, *others, F.col(words).alias("words"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            lists = batch.column("words")
            size = lists.value_lengths().fill_null(0).to_numpy()
            flat = lists.flatten().dictionary_encode()
            some = flat.is_valid().to_numpy(zero_copy_only=False)
            names = flat.dictionary
            cells = np.repeat(np.arange(len(size)), size)[some] * np.int64(max(len(names), 1)) + flat.indices.drop_null().to_numpy()
            cells, n = np.unique(cells, return_counts=True)
            row, code = np.divmod(cells, max(len(names), 1))
            step = 1 << 16
            for at in range(0, len(cells), step):
                own = pa.array(row[at:at + step])
                kept = [batch.column(c).take(own) for c in (key, *others)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, names.take(pa.array(code[at:at + step])), pa.array(n[at:at + step].astype(np.int64))], [key, *others, "feature", "n"])

    return rows.mapInArrow(run, f"{kinds}, feature string, n long")


def feature_logs(counts: DataFrame, labels: list[str], by: tuple[str, ...] = (), alpha: float = ALPHA) -> DataFrame:
    """(by, feature, logs): ln P(feature | label) for each of ``labels``, from (by, feature, label, n).

    Every label shares out ``alpha`` to each feature seen with any label. Each value of
    ``by`` has a model of its own.
    """
    own = F.array(*[F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)) for x in labels])
    wide = counts.groupBy(*by, "feature").agg(own.alias("c"))
    sums = [F.sum(F.get("c", F.lit(i))) for i in range(len(labels))]
    totals = wide.groupBy(*by).agg(F.array(*sums).alias("t"), F.count("*").alias("v"))
    if by:
        both = wide.join(totals, list(by))
    else:  # one row: a scalar, not a join
        both = wide.withColumn("t", totals.select("t").scalar()).withColumn("v", totals.select("v").scalar())
    share = lambda c, t: F.log((c + alpha) / (t + alpha * F.col("v")))
    return both.select(*by, "feature", F.zip_with("c", "t", share).alias("logs"))


def log_sums(rows: DataFrame, logs: DataFrame, key: str, n_labels: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, sums): the logs of a key's features times their n; features that no model knows do not count."""
    known = rows.join(logs, [*by, "feature"])
    sums = F.array(*[F.sum(F.col("n") * F.get("logs", F.lit(i))) for i in range(n_labels)])
    return known.groupBy(key).agg(sums.alias("sums"))


def best_label(sums: Column | str, labels: list[str]) -> Column:
    """Struct (label, score): the label with the largest log, ties to the first, and its share of all labels."""
    sums = as_col(sums)
    best = F.array_max(sums)
    total = F.aggregate(sums, F.lit(0.0), lambda acc, x: acc + F.exp(x - best))
    names = F.array(*[F.lit(x) for x in labels])
    return F.struct(F.element_at(names, F.array_position(sums, best).cast("int")).alias("label"), (1.0 / total).alias("score"))


def naive_bayes(df: DataFrame, words: str, truth: str, train: Column, labels: list[str], key: str = "review_id",
                by: tuple[str, ...] = (), alpha: float = ALPHA) -> DataFrame:
    """df with predicted and probability from multinomial naive Bayes over words, one model for each ``by``.

    Rows where ``train`` is true and ``truth`` is one of ``labels`` teach; every row is
    scored. A text without a known word goes by the labels' shares alone; without a model
    for its ``by``, or a null there, both columns are null.
    """
    teach = df.where(train & F.col(truth).isin(labels))
    # Only a word's counts by label are needed, so they combine before the shuffle whatever the number of texts.
    counts = teach.select(*by, F.col(truth).alias("label"), F.explode(words).alias("feature"), F.lit(1).alias("n"))
    logs = feature_logs(counts, labels, by, alpha)
    shares = teach.groupBy(*by).agg(
        F.array(*[F.log((F.count_if(F.col(truth) == x) + alpha) / (F.count("*") + alpha * len(labels))) for x in labels]).alias("prior"))
    sums = log_sums(word_counts(df, key, words, *by), logs, key, len(labels), by)
    scored = df.join(sums, key, "left")
    scored = scored.join(shares, list(by), "left") if by else scored.withColumn("prior", shares.scalar())
    both = F.when(F.col("sums").isNull(), F.col("prior")).otherwise(F.zip_with("sums", "prior", lambda a, b: a + b))
    found = scored.withColumn("_b", best_label(both, labels))
    known = F.col("prior").isNotNull()
    return found.withColumns({"predicted": F.when(known, F.col("_b.label")), "probability": F.when(known, half_even("_b.score", 4))}).drop(
        "_b", "sums", "prior")


def letter_groups(word: Column | str, size: int = GRAM) -> Column:
    """All groups of ``size`` letters of a word with a blank at both ends."""
    padded = F.concat(F.lit(" "), as_col(word), F.lit(" "))
    starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - size + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substring(padded, i, F.lit(size)))


def language_by_letters(df: DataFrame, words: str, truth: str, train: Column, languages: list[str], key: str = "review_id") -> DataFrame:
    """df with language and language_score: profiles of letter groups learned from the rows where ``train`` is true.

    A word's logs are summed once, whatever the number of texts that hold it, so only words
    and counts are shuffled with texts. Languages count alike beforehand; texts without
    words get null.
    """
    counts = word_counts(df, key, words)
    taught = df.where(train & F.col(truth).isin(languages)).select(F.col(truth).alias("label"), F.explode(words).alias("word"))
    taught = taught.groupBy("label", "word").agg(F.count("*").alias("n"))
    groups = taught.select("label", "n", F.explode(letter_groups("word")).alias("feature"))
    logs = feature_logs(groups.groupBy("label", "feature").agg(F.sum("n").alias("n")), languages)
    different = counts.select(F.col("feature").alias("word")).distinct()
    spelled = different.select("word", F.explode(letter_groups("word")).alias("feature"), F.lit(1).alias("n"))
    by_word = log_sums(spelled, logs, "word", len(languages)).select(F.col("word").alias("feature"), F.col("sums").alias("logs"))
    sums = log_sums(counts, by_word, key, len(languages))
    found = df.join(sums, key, "left").withColumn("_b", F.when(F.col("sums").isNotNull(), best_label("sums", languages)))
    return found.withColumns({"language": F.col("_b.label"), "language_score": half_even("_b.score", 4)}).drop("_b", "sums")


def induced_lexicon(df: DataFrame, words: str, truth: str, positive: str, negative: str, least_z: float = 1.96,
                    prior: float = 0.1) -> DataFrame:
    """(word, weight, z): words that tell ``positive`` from ``negative`` texts, by log odds with a prior from both.

    z is the difference of log odds over its deviation; words of |z| below ``least_z`` are
    left out. The weight z / (1 + |z|) lies between -1 and 1.
    """
    rows = df.where(F.col(truth).isin(positive, negative)).select(F.col(truth).alias("label"), F.explode(words).alias("word"))
    c = rows.groupBy("word").agg(F.count_if(F.col("label") == positive).alias("p"), F.count_if(F.col("label") == negative).alias("q"))
    sums = c.agg(F.struct(F.sum("p").alias("p"), F.sum("q").alias("q")).alias("s")).scalar()
    c = c.withColumn("s", sums).withColumn("a", prior * (F.col("p") + F.col("q")))
    whole = prior * (F.col("s.p") + F.col("s.q"))

    def odds(n, total):
        return F.log((n + F.col("a")) / (total + whole - n - F.col("a")))

    z = (odds(F.col("p"), F.col("s.p")) - odds(F.col("q"), F.col("s.q"))) / F.sqrt(1 / (F.col("p") + F.col("a")) + 1 / (F.col("q") + F.col("a")))
    c = c.withColumn("z", half_even(z, 6)).where(F.abs("z") >= least_z)
    return c.select("word", half_even(F.col("z") / (1 + F.abs("z")), 6).alias("weight"), "z")


def spans(text: Column | str) -> Column:
    """Lower-case words and the marks that end a span."""
    return F.regexp_extract_all(F.lower(F.coalesce(as_col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+|[.,;:!?]"), F.lit(0))


def scoped_polarity(df: DataFrame, text: str, lexicon: DataFrame, key: str = "review_id", cut: float = POLARITY_CUT,
                    reach: int = NEGATION_REACH) -> DataFrame:
    """df with sentiment_label and sentiment_score from a lexicon (word, weight), read from left to right.

    A negation at most ``reach`` words before, in the same span, turns a weight by NEGATED; a degree word right
    before it multiplies it. The score is the mean over the words found, between -1 and 1,
    0 if none is. Only words that matter leave the text's row; the automaton then runs over
    them in their order.
    """
    listed = df.select(key, F.posexplode(spans(text)).alias("pos", "word")).join(lexicon.select("word", "weight"), "word", "left")
    table = F.create_map(*[F.lit(x) for pair in DEGREES.items() for x in pair])
    listed = listed.select(key, "pos", "weight", F.col("word").isin(*NEGATIONS).alias("no"), F.col("word").isin(*SPAN_ENDS).alias("end"),
                           F.try_element_at(table, F.col("word")).alias("degree"))
    listed = listed.where(F.col("no") | F.col("end") | F.col("degree").isNotNull() | F.col("weight").isNotNull())
    marks = listed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "weight", "no", "end", "degree"))).alias("m"))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(-1000).alias("no_at"), F.lit(-1000).alias("degree_at"), F.lit(1.0).alias("degree"))

    def step(acc, x):
        near = x["pos"] - acc["no_at"] <= reach
        strength = F.when(acc["degree_at"] == x["pos"] - 1, acc["degree"]).otherwise(F.lit(1.0))
        bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x["weight"] * strength))
        value = F.when(x["weight"].isNotNull(), bounded * F.when(near, F.lit(NEGATED)).otherwise(F.lit(1.0)))
        return F.struct(
            (acc["total"] + F.coalesce(value, F.lit(0.0))).alias("total"), (acc["n"] + x["weight"].isNotNull().cast("int")).alias("n"),
            F.when(x["end"], F.lit(-1000)).when(x["no"], x["pos"]).otherwise(acc["no_at"]).alias("no_at"),
            F.when(x["degree"].isNotNull(), x["pos"]).otherwise(acc["degree_at"]).alias("degree_at"),
            F.coalesce(x["degree"], acc["degree"]).alias("degree"))

    read = marks.select(key, F.aggregate("m", start, step).alias("r"))
    scored = read.select(key, F.coalesce(F.try_divide(F.col("r.total"), F.nullif(F.col("r.n"), F.lit(0)).cast("double")), F.lit(0.0)).alias("_p"))
    joined = df.join(scored, key, "left").withColumn("_p", F.coalesce("_p", F.lit(0.0)))
    return joined.withColumns({"sentiment_label": polarity_label("_p", cut), "sentiment_score": half_even("_p", 4)}).drop("_p")


def suffix_rules(pairs: DataFrame, longest: int = 5, least: int = 2) -> DataFrame:
    """(suffix, cut, add, n): how the ends of forms turn into those of their lemmas, from (form, lemma).

    A suffix of a form covers the part that changes and up to ``longest`` letters; its rule
    is the change seen most often with it, at least ``least`` times, ties to the shorter
    cut and then the smaller ending.
    """
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length("form"), F.length("lemma"))),
                           lambda i: F.substring("form", F.lit(1), i) == F.substring("lemma", F.lit(1), i)))
    change = pairs.distinct().where((F.length("form") > 0) & (F.length("lemma") > 0)).select("form", "lemma", same.alias("same")).select(
        "form", (F.length("form") - F.col("same")).alias("cut"), F.expr("substring(lemma, same + 1)").alias("add"))
    change = change.where(F.col("cut") <= longest)
    size = F.explode(F.sequence(F.greatest("cut", F.lit(1)), F.least(F.length("form"), F.lit(longest)))).alias("size")
    seen = change.select("form", "cut", "add", size).select(F.expr("right(form, size)").alias("suffix"), "cut", "add")
    counts = seen.groupBy("suffix", "cut", "add").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    best = counts.groupBy("suffix").agg(F.min(F.struct((-F.col("n")).alias("m"), "cut", "add")).alias("b"))
    return best.select("suffix", "b.cut", "b.add", (-F.col("b.m")).alias("n"))


def lemmas_by_rules(forms: DataFrame, rules: DataFrame, longest: int = 5) -> DataFrame:
    """(form, lemma) of distinct forms: the rule of the longest known suffix; a form without one, or that would vanish, stays."""
    size = F.explode(F.sequence(F.lit(1), F.least(F.length("form"), F.lit(longest)))).alias("size")
    ends = forms.where(F.length("form") > 0).select("form", size).select("form", "size", F.expr("right(form, size)").alias("suffix"))
    found = ends.join(rules, "suffix").groupBy("form").agg(F.max(F.struct("size", "cut", "add")).alias("r"))
    new = F.concat(F.expr("left(form, length(form) - r.cut)"), F.col("r.add"))
    named = found.select("form", new.alias("lemma"))
    return forms.join(named, "form", "left").select("form", F.when(F.length("lemma") > 0, F.col("lemma")).otherwise(F.col("form")).alias("lemma"))

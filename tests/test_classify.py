"""Classifiers, lexica, rules and topic descriptions on small cases with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import classify, topics
from tideline.plans.catalog import QUERIES


def test_naive_bayes_by_hand(spark):
    rows = [(1, "en", "good", ["fine", "fine", "room"]), (2, "en", "bad", ["dirty", "room"]), (3, "en", None, ["fine"]),
            (4, "en", None, ["unseen"]), (5, "de", None, ["fine"]), (6, None, None, ["fine"]), (7, "en", "good", []), (8, "en", "other", ["dirty"])]
    df = spark.createDataFrame(rows, "review_id long, lang string, truth string, words array<string>")
    got = {r.review_id: (r.predicted, r.probability) for r in classify.naive_bayes(
        df, "words", "truth", F.lit(True), ["bad", "good"], by=("lang",)).collect()}
    # vocabulary 3; good has 3 words in 2 texts, bad 2 words in 1
    bad, good = 2 / 5 * (1 / 5), 3 / 5 * (3 / 6)
    assert got[3] == ("good", round(good / (good + bad), 4)) and got[4] == ("good", 0.6)
    assert got[5] == (None, None) == got[6] and got[7][0] == "good" and len(got) == 8


def test_letter_groups_and_languages(spark):
    one = spark.range(1).select(classify.letter_groups(F.lit("abc")).alias("g")).first().g
    assert one == [" ab", "abc", "bc "]
    rows = [(i, ["the", "house", "three"], "en") for i in range(5)] + [(10 + i, ["das", "haus", "drei"], "de") for i in range(5)]
    rows += [(20, ["houses", "these"], "en"), (21, ["hausen", "drehen"], "de"), (22, [], "en"), (23, None, "en")]
    df = spark.createDataFrame(rows, "review_id long, words array<string>, lang string")
    got = {r.review_id: r.language for r in classify.language_by_letters(df, "words", "lang", F.col("review_id") < 20, ["de", "en"]).collect()}
    assert (got[20], got[21], got[22], got[23]) == ("en", "de", None, None) and len(got) == len(rows)


@pytest.mark.parametrize("words,score", [
    ("good", 0.8), ("not good", -0.4), ("not a very good", -0.5), ("not, good", 0.8), ("not a b c good", 0.8), ("very good", 1.0),
    ("slightly good", 0.4), ("good bad", 0.15), ("not bad but good", 0.525), ("", 0.0), (None, 0.0), ("plain words", 0.0), ("very plain good", 0.8)])
def test_scoped_polarity(spark, words, score):
    lexicon = spark.createDataFrame([("good", 0.8), ("bad", -0.5)], "word string, weight double")
    df = spark.createDataFrame([(1, words)], "review_id long, t string")
    got = classify.scoped_polarity(df, "t", lexicon).first()
    assert got.sentiment_score == pytest.approx(score, abs=1e-4)
    assert got.sentiment_label == ("positive" if score > .05 else "negative" if score < -.05 else "neutral")


def test_induced_lexicon_signs(spark):
    rows = [(i, ["fine"] * 3 + ["room"], "p") for i in range(40)] + [(i, ["awful"] * 3 + ["room"], "n") for i in range(40)] + [(99, ["x"], None)]
    df = spark.createDataFrame(rows, "review_id long, words array<string>, truth string")
    got = {r.word: r.weight for r in classify.induced_lexicon(df, "words", "truth", "p", "n").collect()}
    assert set(got) == {"fine", "awful"} and got["fine"] > .5 and got["awful"] < -.5


def test_suffix_rules(spark):
    pairs = [("cities", "city"), ("parties", "party"), ("walked", "walk"), ("talked", "talk"), ("was", "be"), ("houses", "house"), ("rooms", "room"),
             ("beds", "bed"), ("", "x"), (None, "x")]
    rules = classify.suffix_rules(spark.createDataFrame(pairs, "form string, lemma string"))
    got = {r.suffix: (r.cut, r.add) for r in rules.collect()}
    assert got["ies"] == (3, "y") and got["lked"] == (2, "") and got["s"] == (1, "")
    forms = spark.createDataFrame([(w,) for w in ("berries", "balked", "doors", "sky", "s", "")], "form string")
    lemmas = {r.form: r.lemma for r in classify.lemmas_by_rules(forms, rules).collect()}
    assert lemmas == {"berries": "berry", "balked": "balk", "doors": "door", "sky": "sky", "s": "s", "": ""}


def plain_merges(names, similar):
    groups, out = {n: [n] for n in names}, []
    gap = lambda a, b: np.mean([1 - similar.get((min(x, y), max(x, y)), 0.0) for x in groups[a] for y in groups[b]])
    while len(groups) > 1:
        d, a, b = min((round(gap(a, b), 12), a, b) for a in groups for b in groups if a < b)
        groups[a] += groups.pop(b)
        out.append((a, b, pytest.approx(d, abs=1e-9), len(groups[a])))
    return out


def test_merge_tree_against_plain_average_linkage():
    rng = np.random.default_rng(3)
    names = list(range(12))
    similar = {(a, b): float(rng.uniform()) for a in names for b in names if a < b and rng.uniform() < .8}
    assert topics.merge_tree(names, similar) == plain_merges(names, similar)


def test_merged_topics(spark):
    rows = [(0, ["sea", "sun", "sand"]), (1, ["sea", "sun", "wind"]), (2, ["soup", "fish", "wine"]), (3, ["soup", "fish", "bread"]), (-1, ["sea"])]
    df = spark.createDataFrame([(t, w * 5) for t, w in rows], "topic int, words array<string>")
    by_gap = {r.cluster: r.merged for r in topics.merged_topics(df, "topic", "words").collect()}
    assert by_gap == {0: 0, 1: 0, 2: 2, 3: 2}
    assert len({r.merged for r in topics.merged_topics(df, "topic", "words", 3).collect()}) == 3
    assert {r.merged for r in topics.merged_topics(df, "topic", "words", 1).collect()} == {0}


def test_topic_map_keeps_distances(spark):
    rows = [(0, ["a", "b"]), (1, ["a", "c"]), (2, ["d", "e"])]
    df = spark.createDataFrame(rows, "t int, words array<string>")
    gap = {(r.a, r.b): r.distance for r in topics.topic_distances(df, "t", "words").collect()}
    assert gap == {(0, 1): pytest.approx(math.log(2) / 2, abs=1e-6)}
    spot = {r.cluster: (r.x, r.y) for r in topics.topic_map(df, "t", "words").collect()}
    assert math.dist(spot[0], spot[1]) == pytest.approx(math.log(2) / 2, abs=1e-5)
    assert math.dist(spot[0], spot[2]) == pytest.approx(math.log(2), abs=1e-5)


def test_words_are_counted_where_rows_are_read(spark):
    rows = [(1, "en", ["b", "a", "b", None]), (1, "en", ["b"]), (None, "de", ["a"]), (2, None, []), (3, "en", None)]
    df = spark.createDataFrame(rows, "review_id long, lang string, words array<string>")
    counts = classify.word_counts(df, "review_id", "words", "lang")
    assert sorted(map(tuple, counts.where("review_id = 1").collect())) == [(1, "en", "a", 1), (1, "en", "b", 1), (1, "en", "b", 2)]
    assert [tuple(r) for r in counts.where("review_id is null").collect()] == [(None, "de", "a", 1)] and counts.count() == 4
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()


def test_forms_are_made_of_the_texts_once(spark, data):
    for name in ("suffix_rules", "lemmatize_rules"):
        assert not any("documents" in f for f in QUERIES[name](spark, data).inputFiles())

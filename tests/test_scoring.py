import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tideline.functions import text
from tideline.operators import evaluate, scoring, topics
from tideline.plans import samples

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_language_vote(spark):
    lists = {"it": ["il", "la", "di"], "en": ["the", "of", "la"]}
    df = spark.createDataFrame([(["il", "mare"],), (["the", "the", "of", "sea"],), (["the", "il"],), ([],), (["la"],)], "w array<string>")
    assert [r[0] for r in df.select(scoring.language_vote("w", lists)).collect()] == ["it", "en", "it", "it", "it"]


def test_collapse_language(spark):
    df = spark.createDataFrame([("x", "en"), ("x", "de"), (" ", "en"), (None, "it"), ("x", None)], "t string, l string")
    assert [r[0] for r in df.select(scoring.collapse_language("t", "l")).collect()] == ["en", "it", "unknown", "unknown", "it"]


def test_lexicon_forms_agree(spark):
    lexicon = {"bello": 0.5, "brutto": -1.0, "ok": 0.05}
    df = spark.createDataFrame([(1, ["bello", "bello", "mare"]), (2, ["brutto", "bello"]), (3, []), (4, ["ok"]), (5, ["mare"])],
                               "review_id long, w array<string>")
    a = scoring.lexicon_sentiment(df, "w", lexicon).orderBy("review_id").collect()
    table = spark.createDataFrame(list(lexicon.items()), "word string, weight double")
    b = scoring.lexicon_sentiment_table(df, "w", table).orderBy("review_id").collect()
    assert a == b
    assert [(r.sentiment_label, r.sentiment_score) for r in a] == [
        ("positive", 0.5), ("negative", -0.25), ("neutral", 0.0), ("neutral", 0.05), ("neutral", 0.0)]


def test_table_forms(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "review_id long, w array<string>")
    table = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "word string, weight double")
    got = {r.review_id: r.sentiment_score for r in scoring.lexicon_sentiment_table(df, "w", table).collect()}
    assert got == {1: 0.75, 2: 0.0}
    lemmas = spark.createDataFrame([("a", "A"), ("b", " ")], "form string, lemma string")
    assert {r.review_id: r.lemmas for r in scoring.lemmatize_table(df, "w", lemmas).collect()} == {1: ["A"], 2: ["c"]}


def test_lemma_table(spark):
    df = spark.createDataFrame([(1, ["camere", "blu", "camere"]), (2, [])], "review_id long, w array<string>")
    lemmas = spark.createDataFrame([("camere", "camera")], "form string, lemma string")
    got = {r.review_id: r.lemmas for r in scoring.lemmatize_table(df, "w", lemmas).collect()}
    assert got == {1: ["camera", "blu", "camera"], 2: []}


def test_emotion_by_language(spark):
    lexica = {"it": {"gioia": ["bello"], "rabbia": ["odio", "male"]}, "en": {"joy": ["nice"], "fear": ["afraid"]}}
    df = spark.createDataFrame([(["odio", "male", "bello"], "it"), (["nice"], "en"), (["nice"], "it"), (["bello"], "fr")],
                               "w array<string>, l string")
    got = df.select(scoring.emotion_by_language("w", "l", lexica).alias("e")).select("e.*").collect()
    assert [tuple(r) for r in got] == [("rabbia", 0.6667), ("joy", 1.0), ("unknown", 0.0), ("unknown", 0.0)]


def fake_model():
    return lambda texts: [[{"label": "X", "score": 0.1}, {"label": f"LEN{len(t)}", "score": 0.87654}] for t in texts]


def other_model():
    return lambda texts: [{"label": "OTHER", "score": 1.0} for _ in texts]


def test_score_text_keeps_whole_texts(spark):
    df = spark.createDataFrame([(1, "a" * 5000), (2, "  "), (3, None)], "i int, t string")
    got = {r.i: (r.label, r.score) for r in scoring.score_text(df, "t", fake_model, batch_size=2).collect()}
    assert got == {1: ("len5000", 0.87654), 2: ("len1", 0.87654), 3: ("len1", 0.87654)}
    cut = scoring.score_text(df, "t", fake_model, max_chars=2048).where("i = 1").first()
    assert cut.label == "len2048"


def test_score_by_language(spark):
    df = spark.createDataFrame([(i, "abc", l) for i, l in enumerate(["it", "en", "unknown", None, "it"])], "i int, t string, l string")
    got = scoring.score_by_language(df, "t", "l", {"it": fake_model, "en": other_model})
    assert [(r.emotion_label, r.emotion_score) for r in got.orderBy("i").collect()] == [
        ("len3", 0.8765), ("other", 1.0), ("unknown", 0.0), ("unknown", 0.0), ("len3", 0.8765)]


def test_embed_text(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    got = scoring.embed_text(df, "t", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert [list(r.embedding) for r in got] == [[2.0, 1.0], [1.0, 1.0]]


def pairs(spark, counts):
    rows = [(t, p) for t, p, n in counts for _ in range(n)]
    return spark.createDataFrame(rows, "truth string, predicted string")


@pytest.mark.parametrize("counts,accuracy,macro,weighted,negative,positive", [
    ([("negative", "negative", 2), ("negative", "positive", 1), ("positive", "positive", 85), ("positive", "negative", 62)],
     0.58, 0.395, 0.716, (0.031, 0.667, 0.060), (0.988, 0.578, 0.730)),
    ([("negative", "positive", 3), ("positive", "positive", 144), ("positive", "negative", 3)],
     0.96, 0.490, 0.960, (0.0, 0.0, 0.0), (0.980, 0.980, 0.980)),
])
def test_report_golden(spark, counts, accuracy, macro, weighted, negative, positive):
    df = pairs(spark, counts)
    got = {r.label: r for r in evaluate.class_report(df, "truth", "predicted", ["negative", "positive"]).collect()}
    for label, want in (("negative", negative), ("positive", positive)):
        r = got[label]
        assert tuple(round(x, 3) for x in (r.precision, r.recall, r.f1)) == want
    assert (got["accuracy"].f1, round(got["macro avg"].f1, 3), round(got["weighted avg"].f1, 3)) == (accuracy, macro, weighted)
    cells = evaluate.confusion(df, "truth", "predicted", ["negative", "positive"]).collect()
    assert len(cells) == 4 and sum(r.n for r in cells) == 150
    both = evaluate.compare_models(df.withColumn("same", F.col("truth")), "truth", {"a": "predicted", "b": "same"},
                                   ["negative", "positive"])
    by = {r.model: r for r in both.collect()}
    assert (by["a"].n_samples, by["a"].accuracy, by["b"].accuracy, by["b"].macro_f1) == (150, accuracy, 1.0, 1.0)


def test_report_counts_unlisted_labels(spark):
    df = pairs(spark, [("a", "a", 2), ("b", "a", 1), ("a", "z", 1), ("z", "b", 1)])
    got = {r.label: r for r in evaluate.class_report(df, "truth", "predicted", ["a", "b"]).collect()}
    assert (got["a"].precision, got["a"].recall, got["b"].precision, got["b"].support) == (0.6667, 0.6667, 0.0, 1)
    assert evaluate.label_list(df, "truth", "predicted") == ["a", "b", "z"]


def test_slices(spark):
    sizes = {"base-during": 15, "base-pre": 17, "during": 20, "post": 18, "pre": 17}
    df = spark.createDataFrame([(w, "x", "x" if i < n else "y") for w, n in sizes.items() for i in range(30)],
                               "w string, truth string, predicted string")
    slices = evaluate.accuracy_by_slice(df, "truth", "predicted", "w")
    assert {r.w: round(r.accuracy, 3) for r in slices.collect()} == {
        "base-during": .5, "base-pre": .567, "during": .667, "post": .6, "pre": .567}
    assert round(evaluate.mean_slice_accuracy(slices).first().mean_accuracy, 3) == 0.58


# ---- topics

@pytest.fixture(scope="module")
def split_docs(spark):
    sea, food = ["mare", "spiaggia", "sole", "vista"], ["cibo", "pasta", "vino", "pesce"]
    rows = [(i, (sea if i % 2 else food) * 6) for i in range(60)] + [(60, []), (61, ["solo"])]
    return spark.createDataFrame(rows, "review_id long, words array<string>")


def test_vocabulary(spark):
    df = spark.createDataFrame([(["a", "b", "b"],), (["a", "b"],), (["a", "c"],), ([],)], "w array<string>")
    got = [(r.term, r.tf, r.df) for r in topics.vocabulary(df, "w").collect()]
    assert got == [("b", 3, 2)]  # a is in every text, c in one
    assert [r.term for r in topics.vocabulary(df, "w", max_df=1.0, limit=1).collect()] == ["a"]


def test_lda_finds_the_split(spark, split_docs):
    found = topics.lda_topics(split_docs, "words", 2, top=4, iterations=30)
    got = {r.review_id: (r.topic, r.prob) for r in found.assignments.collect()}
    assert len(got) == 62 and got[60] == (-1, 0.0)
    assert len({got[i][0] for i in range(0, 60, 2)}) == 1 and len({got[i][0] for i in range(1, 60, 2)}) == 1
    assert got[0][0] != got[1][0] and all(0.5 < got[i][1] <= 1 for i in range(60))
    assert got[61] == (0, 0.5)  # no known word: evenly spread
    words = found.top_words.collect()
    assert sorted({r["rank"] for r in words}) == [1, 2, 3, 4] and len(words) == 8
    assert {r.word for r in words if r.topic == got[1][0]} == {"mare", "spiaggia", "sole", "vista"}


def test_lda_without_texts(spark):
    df = spark.createDataFrame([(1, []), (2, [])], "review_id long, words array<string>")
    found = topics.lda_topics(df, "words", 3)
    assert [tuple(r) for r in found.assignments.orderBy("review_id").collect()] == [(1, -1, 0.0), (2, -1, 0.0)]
    assert found.top_words.count() == 0
    assert topics.choose_k(df, "words")[0] == 6


def test_choose_k(spark, split_docs):
    k, grid = topics.choose_k(split_docs, "words", topics=(2, 3), decays=(0.7,), iterations=3)
    rows = grid.collect()
    assert k == max(rows, key=lambda r: r.mean_log_likelihood).k and len(rows) == 2


def test_subsets(spark, split_docs):
    df = split_docs.withColumn("city", F.when(F.col("review_id") < 55, "t").otherwise("c"))
    sizes = {r.city: (r.n, r.n_valid, r.modelled) for r in topics.subset_sizes(df, ["city"], "words", least=50).collect()}
    assert sizes == {"t": (55, 55, True), "c": (7, 6, False)}
    words = topics.per_subset(df, ["city"], "words", k=2, least=50)
    assert {r.city for r in words.collect()} == {"t"} and words.where("error is not null").count() == 0


def test_subset_errors_stay_inside(spark):
    rows = [(i, "a", [f"w{i}"]) for i in range(60)] + [(100 + i, "b", ["x", "y", f"z{i % 2}"]) for i in range(60)]
    df = spark.createDataFrame(rows, "review_id long, city string, words array<string>")
    got = topics.per_subset(df, ["city"], "words", k=2, least=50).collect()
    assert [r.error is not None for r in got if r.city == "a"] == [True]
    assert any(r.city == "b" and r.word for r in got)


def test_embedding_topics(spark):
    rows = [(i, [1.0, 0.01 * (i % 5), 0.0]) for i in range(30)] + [(100 + i, [0.0, 0.01 * i, 1.0]) for i in range(12)]
    df = spark.createDataFrame(rows + [(200, None), (201, [0.0, 0.0, 0.0])], "review_id long, v array<double>")
    got = {r.review_id: (r.topic, r.prob) for r in topics.embedding_topics(df, "v", 2).collect()}
    assert {got[i][0] for i in range(30)} == {0} and {got[100 + i][0] for i in range(12)} == {1}
    assert got[200] == got[201] == (-1, 0.0) and all(0 <= p <= 1 for _, p in got.values())
    few = topics.embedding_topics(df.limit(5), "v", 2, least=10).collect()
    assert all(r.topic == -1 for r in few)
    strict = topics.embedding_topics(df, "v", 2, min_similarity=1.1).collect()
    assert all(r.topic == -1 for r in strict)


def test_hashed_embedding(spark, split_docs):
    got = topics.hashed_embedding(split_docs, "words", 16).where("review_id = 1").first()
    assert len(got.embedding) == 16 and sum(x * x for x in got.embedding) == pytest.approx(1, abs=1e-5)


def test_class_tfidf_leaves_outliers_out(spark):
    df = spark.createDataFrame([(0, ["a", "a", "b"]), (1, ["b", "c"]), (-1, ["a", "z"])], "t int, w array<string>")
    got = topics.class_tfidf(df, "t", "w", 1).collect()
    assert {(r.cluster, r.word) for r in got} == {(0, "a"), (1, "c")}


def test_term_frequency(spark):
    df = spark.createDataFrame([("x", ["a", "b", "a"]), ("x", ["b"]), ("x", []), ("y", ["c"])], "g string, w array<string>")
    got = {(r.g, r.word): (r["count"], r["rank"], r.n_texts) for r in topics.term_frequency(df, ["g"], "w", 2).collect()}
    assert got == {("x", "a"): (2, 1, 2), ("x", "b"): (2, 2, 2), ("y", "c"): (1, 1, 1)}


def test_sample_model(spark):
    df = spark.createDataFrame([("eee",), ("aaa",)], "t string")
    assert [r.label for r in scoring.score_text(df, "t", samples.letter_model).collect()] == ["positive", "negative"]
    assert text.stopwords("english") == sorted(set(text.stopwords("english")))

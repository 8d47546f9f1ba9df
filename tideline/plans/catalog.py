"""Every operator as a named query over the test tables: (spark, folder) to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import dates, labels, numbers, text
from tideline.operators import (aggregates, classify, compare, density, evaluate, joins, quantiles, sampling, scoring, topics,
                                vectors)
from tideline.plans import samples, stages
from tideline.session import scratch_path
from tideline.sources import ledger, pages, reviews
from tideline.sources.adapters import OBS_DESIGN, observations, table, texts
from tideline.streaming.ingest import committed, resumable_step, stream_reviews

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

VOTE_LANGUAGES = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}
LANGUAGES = ["de", "en", "es", "fr"]
SEGMENTS = ["automobile", "building", "furniture", "household", "machinery"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
STARS = [1, 2, 3, 4, 5]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def word_docs(spark: SparkSession, root: str) -> DataFrame:
    return texts(spark, root).withColumn("words", text.word_tokens("text_positive"))


def vote_lists(least: int = 1) -> dict[str, list[str]]:
    """Stop-words of at least ``least`` characters for each language code."""
    return {code: [w for w in text.stopwords(name) if len(w) >= least] for code, name in VOTE_LANGUAGES.items()}


def voted(spark: SparkSession, root: str) -> DataFrame:
    """Documents with the language vote on all stop-words and on those of three characters or more."""
    docs = texts(spark, root).withColumn("words", text.tokens(text.clean_text("text_positive")))
    return docs.withColumns({
        "predicted": scoring.language_vote("words", vote_lists()),
        "predicted_long": scoring.language_vote("words", vote_lists(3)),
    })


# ---- sources, sinks, ingestion

@query
def union_by_name(spark, root):
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    talk = table(spark, root, "conversations").select(F.col("conv_id").alias("id"), "turn", "role", "text")
    return reviews.union_by_name(docs, talk)


@query
def roundtrip_stage(spark, root):
    folder = scratch_path(spark, "stage")
    obs = observations(spark, root).select("review_id", "city", "rating", "temporal_window")
    reviews.write_stage(obs, folder, "processed", ["temporal_window"])
    return reviews.read_stage(spark, folder, "processed").select("review_id", "city", "rating", "temporal_window")


@query
def incremental_pending(spark, root):
    all_pages = table(spark, root, "pages").select("page_id", "url")
    done = all_pages.where(F.startswith("url", F.lit("http://"))).select("url")
    return ledger.pending(all_pages, done)


@query
def stream_ingest(spark, root):
    folder = scratch_path(spark, "stream")
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    for _ in range(2):  # the second run finds nothing new
        stream_reviews(spark, root, f"{folder}/out", f"{folder}/log", schema,
                       options={"pathGlobFilter": "events.parquet"})
    return spark.read.schema(schema).parquet(f"{folder}/out").select("event_id", "user_id", "event_type", "value")


@query
def resumable_ingest(spark, root):
    folder = scratch_path(spark, "resumable")
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    for _ in range(2):  # the second run finds nothing new
        resumable_step(spark, root, f"{folder}/out", f"{folder}/ledger", f"{folder}/log", schema, "event_id",
                       transform=lambda rows: rows.where(F.col("event_type") != "error"), options={"pathGlobFilter": "events.parquet"})
    done = spark.read.parquet(f"{folder}/ledger").select("event_id", F.lit(True).alias("noted"))
    rows = committed(spark, f"{folder}/out", f"{folder}/ledger")
    return rows.join(done, "event_id", "left").select("event_id", "user_id", "event_type", "value", "noted")


@query
def read_reviews_headers(spark, root):
    """Documents written as CSV under two headers of different columns, read back by name."""
    folder = scratch_path(spark, "exports")
    docs = table(spark, root, "documents").select("doc_id", "lang", "source", "n_chars")
    docs.where("doc_id % 2 = 0").select("doc_id", "lang", "source").write.option("header", True).mode("append").csv(folder)
    docs.where("doc_id % 2 = 1").select("lang", "n_chars", "doc_id").write.option("header", True).mode("append").csv(folder)
    return reviews.read_reviews(spark, folder).select("doc_id", "lang", "source", "n_chars")


@query
def append_report(spark, root):
    folder = scratch_path(spark, "report")
    sizes = table(spark, root, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    for fresh in (True, True, False):  # the second run starts anew, the third adds to it
        reviews.append_report(sizes, folder, fresh)
    return spark.read.parquet(folder)


@query
def tag_by_file(spark, root):
    folder = scratch_path(spark, "files")
    table(spark, root, "orders").select("o_orderkey", "o_orderstatus").coalesce(1).write.parquet(folder)
    files = spark.read.parquet(folder).select(F.col("_metadata.file_name")).distinct().collect()  # one file
    tagged = reviews.tag_by_file(spark.read.parquet(folder), {r[0]: "pre" for r in files})
    return tagged.groupBy("temporal_window", "o_orderstatus").agg(F.count("*").alias("n"))


@query
def column_names(spark, root):
    """An alias resolved, an absent column taken from another, and only the present ones kept."""
    docs = table(spark, root, "documents").withColumnRenamed("source", "scrape_source")
    docs = reviews.fallback_column(reviews.resolve_alias(docs, "source"), "language", "lang")
    docs = reviews.fallback_column(docs, "rating", "absent", "double")
    return reviews.select_present(docs, ["doc_id", "source", "language", "rating", "not_there"])


@query
def page_cards(spark, root):
    return pages.extract_cards(table(spark, root, "pages"), pages.ARTICLES)


@query
def review_cards(spark, root):
    """Documents written as review pages and read back with the profile of review cards."""
    n = F.col("doc_id")
    parts = ['<html><div data-testid="rating-squares" aria-label="', n % 5 + 1, ' stelle"></div><div data-testid="review-card"><h4 data-testid="review-title">',
             F.col("source"), '</h4><div data-testid="review-score">', n % 10, ",", n % 7, '</div><div data-testid="review-positive-text">« ',
             F.col("lang"), " ", n, ' »</div><span data-testid="review-num-nights">', n % 9 + 1, " notti</span></div></html>"]
    html = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    url = F.concat(F.lit("https://x.example/hotel/it/house-"), F.col("lang"), F.lit(".it.html"))
    made = table(spark, root, "documents").select(n.alias("page_id"), url.alias("url"), html.alias("html"))
    rows = pages.review_rows(made, F.lit("here"), F.lit("made"))
    return rows.select("page_id", "card", "city", "property", "property_stars", "rating", "review_title", "nights_stayed", "text_positive", "text_negative")


@query
def page_links(spark, root):
    return pages.extract_links(table(spark, root, "pages"), "https://site.example", path_mark="/")


@query
def url_parts(spark, root):
    name = text.property_from_url("url", "https://", ".example.")
    return table(spark, root, "pages").select("page_id", name.alias("property"))


@query
def benchmark_labels(spark, root):
    docs = table(spark, root, "documents").join(table(spark, root, "labels"), "doc_id")
    return reviews.load_benchmark(docs, "doc_id", "text", "quality", {"0": "negative", "1": "positive"},
                                  keep=["positive"])


def _annotated(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "lang")
    marks = table(spark, root, "labels")
    mark = F.when(F.col("toxic") == 1, " mixed").when(F.col("quality") == 1, " Positive ").when(
        F.col("quality") == 0, "NEGATIVE")
    return docs.join(marks, "doc_id", "left").select("doc_id", "lang", mark.alias("annotation"))


@query
def gold_rejects(spark, root):
    return reviews.gold_rejects(_annotated(spark, root))


@query
def gold_rows(spark, root):
    return reviews.load_gold(_annotated(spark, root))


@query
def head_n(spark, root):
    return sampling.head_sample(table(spark, root, "orders"), "o_orderkey", 100).select("o_orderkey", "o_custkey")


@query
def random_n(spark, root):
    return sampling.random_sample(table(spark, root, "orders"), "o_orderkey", 100).select("o_orderkey", "o_custkey")


# ---- projections and filters

@query
def placeholder_null(spark, root):
    return texts(spark, root).select("review_id", text.null_placeholder("text_negative").alias("text_negative"))


@query
def date_range_keep_null(spark, root):
    keep = dates.in_date_range("review_date", date(1997, 4, 1), date(1998, 6, 15))
    return observations(spark, root).where(keep).select("review_id", "review_date")


@query
def takewhile_recent(spark, root):
    day = F.when(F.col("event_type") != "error", F.date_add(F.lit(date(2024, 1, 1)), F.floor("value").cast("int")))
    listed = table(spark, root, "events").select("event_id", "user_id", day.alias("day"))
    return joins.until_first_below(listed, "user_id", "event_id", "day", date(2024, 1, 3))


@query
def valid_docs(spark, root):
    return table(spark, root, "conversations").where(text.is_valid_text("text")).select("conv_id", "turn")


@query
def canonical_group(spark, root):
    return table(spark, root, "nation").select(
        "n_nationkey", text.canonical_group("n_name").alias("key"), text.display_group("n_name").alias("name")
    )


@query
def coerce_numeric(spark, root):
    rows = table(spark, root, "events").select(
        "event_id", F.regexp_extract("props", r"(\d+)", 1).alias("number"), "event_type"
    )
    return numbers.coerce_numeric(rows, ["number", "event_type", "absent"])


# ---- scalar functions

@query
def italian_dates(spark, root):
    months = F.array(*[F.lit(m) for m in dates.IT_MONTHS])
    day = F.to_date("o_orderdate")
    written = F.concat(
        F.lit("Recensito il "), F.dayofmonth(day), F.lit("º "), F.initcap(F.element_at(months, F.month(day))),
        F.lit(" "), F.year(day),
    )
    return table(spark, root, "orders").select("o_orderkey", dates.italian_date(written).alias("review_date"))


@query
def strict_dates(spark, root):
    months = F.array(*[F.lit(m) for m in dates.EN_MONTHS])
    day = F.to_date("o_orderdate")
    written = F.concat(F.dayofmonth(day), F.lit(" "), F.element_at(months, F.month(day)), F.lit(" "), F.year(day),
                       F.when(F.col("o_orderstatus") == "P", F.lit(" late")).otherwise(F.lit("")))
    return table(spark, root, "orders").select("o_orderkey", dates.strict_italian_date(written).alias("review_date"))


@query
def assign_window(spark, root):
    return observations(spark, root).select("review_id", "temporal_window")


@query
def clean_text(spark, root):
    return texts(spark, root).select("review_id", text.clean_text("text_positive").alias("clean"))


@query
def stopword_filter(spark, root):
    words = text.tokens(text.clean_text("text_positive"))
    kept = text.remove_words(words, text.stopwords("italian", "english"))
    return texts(spark, root).select("review_id", F.array_join(kept, " ").alias("kept"))


@query
def lemmatize_dict(spark, root):
    lemmas = text.lemmatize(text.tokens(text.clean_text("text_positive")), samples.LEMMAS)
    return texts(spark, root).select("review_id", F.array_join(lemmas, " ").alias("lemmas"))


@query
def review_features(spark, root):
    docs = texts(spark, root).withColumn("text_negative", text.null_placeholder("text_negative"))
    return text.add_features(docs).select("review_id", "review_length", "has_negative")


@query
def parse_rating(spark, root):
    written = F.concat(F.col("p_size"), F.lit(","), F.col("p_partkey") % 10, F.lit(" punti"))
    return table(spark, root, "part").select("p_partkey", numbers.parse_rating(written).alias("rating"))


@query
def parse_int_prefix(spark, root):
    status = F.concat(F.substring("o_orderpriority", 1, 1), F.lit(" Notti"), F.col("o_orderstatus"))
    return table(spark, root, "orders").select(
        "o_orderkey", numbers.parse_count("o_orderpriority").alias("stars"), numbers.parse_nights(status).alias("nights"),
        numbers.parse_nights("o_orderpriority").alias("none"),
    )


@query
def strip_quotes(spark, root):
    quoted = F.concat(F.lit(" « "), F.col("text"), F.lit(" »\n"))
    return table(spark, root, "documents").select("doc_id", text.strip_quotes(quoted).alias("text"))


@query
def slugs(spark, root):
    return table(spark, root, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


@query
def top_class(spark, root):
    share = (F.col("p_size") % 3).cast("double")
    guesses = F.array(*[F.struct(F.lit(name).alias("label"), score.alias("score"))
                        for name, score in (("SMALL", F.lit(1.0)), ("Mid", share), ("big", F.lit(0.5)))])
    best = labels.top_class(guesses)
    return table(spark, root, "part").select("p_partkey", best["label"].alias("label"), best["score"].alias("score"))


@query
def star_sentiment(spark, root):
    return observations(spark, root).select("review_id", "sentiment_label", "sentiment_score")


@query
def normalise_labels(spark, root):
    return observations(spark, root).select(
        "review_id",
        labels.normalise_three_class(F.upper("stars")).alias("three_class"),
        labels.normalise_binary_stars(F.concat(F.lit(" "), F.col("stars"))).alias("two_class"),
        labels.normalise_binary_label(F.concat(F.lit("LABEL_"), F.col("topic") % 2)).alias("binary"),
    )


# ---- scoring

@query
def language_vote(spark, root):
    return voted(spark, root).select("review_id", "predicted", "predicted_long")


@query
def language_collapse(spark, root):
    docs = voted(spark, root)
    return docs.select("review_id", scoring.collapse_language("text_positive", "predicted").alias("language"))


@query
def lexicon_sentiment(spark, root):
    scored = scoring.lexicon_sentiment(word_docs(spark, root), "words", samples.LEXICON)
    return scored.select("review_id", "sentiment_label", "sentiment_score")


@query
def lexicon_sentiment_table(spark, root):
    lexicon = spark.createDataFrame(list(samples.LEXICON.items()), "word string, weight double")
    scored = scoring.lexicon_sentiment_table(word_docs(spark, root), "words", F.broadcast(lexicon))  # a short list
    return scored.select("review_id", "sentiment_label", "sentiment_score")


@query
def emotion_dispatch(spark, root):
    talk = table(spark, root, "conversations").withColumn("words", text.tokens(text.clean_text("text")))
    talk = talk.withColumn("language", scoring.language_vote("words", vote_lists()))
    emotion = scoring.emotion_by_language("words", "language", samples.EMOTIONS)
    return talk.select("conv_id", "turn", emotion["label"].alias("emotion_label"), emotion["score"].alias("emotion_score"))


@query
def score_text_stub(spark, root):
    docs = texts(spark, root)
    return scoring.score_text(docs, "text_positive", samples.letter_model).select("review_id", "label", "score")


@query
def sentiment_scored(spark, root):
    docs = voted(spark, root)
    scored = scoring.lexicon_sentiment(docs, "words", samples.LEXICON)
    language = scoring.collapse_language("text_positive", "predicted")
    return scored.select("review_id", "sentiment_label", "sentiment_score", language.alias("detected_language"))


def _held_out():
    return F.col("review_id") % 5 == 0


def _judged(spark, root):
    """Documents with words and, where there is one, their label as a sentiment."""
    marks = table(spark, root, "labels").select(
        F.col("doc_id").alias("review_id"), F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").alias("truth"))
    return word_docs(spark, root).join(marks, "review_id", "left")


def _by_letters(spark, root):
    return classify.language_by_letters(word_docs(spark, root), "words", "lang", ~_held_out(), LANGUAGES)


@query
def language_letters(spark, root):
    return _by_letters(spark, root).select("review_id", "language", "language_score")


@query
def language_quality(spark, root):
    """Both ways of telling languages on the documents that taught neither."""
    docs = voted(spark, root).where(_held_out()).select("review_id", "lang", "predicted")
    letters = _by_letters(spark, root).select("review_id", F.coalesce("language", F.lit("unknown")).alias("language"))
    models = {"stop-words": "predicted", "letters": "language"}
    return evaluate.compare_models(docs.join(letters, "review_id"), "lang", models, LANGUAGES)


def _lexicon(spark, root):
    return classify.induced_lexicon(_judged(spark, root).where(~_held_out()), "words", "truth", "positive", "negative")


@query
def induced_lexicon(spark, root):
    return _lexicon(spark, root)


@query
def scoped_polarity(spark, root):
    scored = classify.scoped_polarity(texts(spark, root), "text_positive", _lexicon(spark, root))
    return scored.select("review_id", "sentiment_label", "sentiment_score")


def _fitted(spark, root):
    return classify.naive_bayes(_judged(spark, root), "words", "truth", ~_held_out(), ["negative", "positive"], by=("lang",))


@query
def sentiment_fitted(spark, root):
    return _fitted(spark, root).select("review_id", "predicted", "probability")


@query
def sentiment_quality(spark, root):
    docs = _fitted(spark, root).where(_held_out()).select("truth", F.coalesce("predicted", F.lit("none")).alias("predicted"))
    return evaluate.compare_models(docs, "truth", {"naive Bayes": "predicted"}, ["negative", "positive"])


def _forms(spark, root):
    """Forms and how often they occur; kept, so that the texts are read once, whatever reads their words, and not before."""
    forms = word_docs(spark, root).select(F.explode("words").alias("form")).groupBy("form").agg(F.count("*").alias("tf"))
    return forms.persist(StorageLevel.MEMORY_AND_DISK)


def _rules(forms):
    """Rules learned from the documents' own words: a form and a more frequent word that lacks its last letters."""
    stems = forms.select(F.col("form").alias("lemma"), F.col("tf").alias("often"))
    shorter = F.explode(F.array(*[F.expr(f"left(form, length(form) - {n})") for n in (1, 2)])).alias("lemma")
    pairs = forms.where(F.length("form") >= 6).select("form", "tf", shorter).join(stems, "lemma")
    return classify.suffix_rules(pairs.where(F.col("often") > F.col("tf")).select("form", "lemma"))


@query
def suffix_rules(spark, root):
    return _rules(_forms(spark, root))


@query
def lemmatize_rules(spark, root):
    forms = _forms(spark, root)
    return classify.lemmas_by_rules(forms.select("form"), _rules(forms))


# ---- topics

@query
def topic_similarity(spark, root):
    return topics.topic_similarity(topics.class_weights(word_docs(spark, root), "source", "words"))


@query
def merged_topics(spark, root):
    return topics.merged_topics(word_docs(spark, root), "source", "words", 8, outlier="none")


@query
def topic_relevance(spark, root):
    return topics.topic_relevance(word_docs(spark, root), "lang", "words")


@query
def topic_distances(spark, root):
    return topics.topic_distances(word_docs(spark, root), "source", "words")


@query
def topic_map(spark, root):
    return topics.topic_map(word_docs(spark, root), "source", "words")


@query
def vocabulary(spark, root):
    return topics.vocabulary(word_docs(spark, root), "words")


@query
def lda_topics(spark, root):
    return topics.lda_topics(word_docs(spark, root), "words", 4).assignments


@query
def lda_top_words(spark, root):
    return topics.lda_topics(word_docs(spark, root), "words", 4).top_words


@query
def lda_grid(spark, root):
    return topics.choose_k(word_docs(spark, root), "words")[1]


@query
def embedding_topics(spark, root):
    return topics.embedding_topics(table(spark, root, "embeddings"), "embedding", 8, "vec_id", min_similarity=0.25)


@query
def sentence_vectors(spark, root):
    return vectors.sentence_vectors(word_docs(spark, root), "words")


@query
def sentence_topics(spark, root):
    """Density topics of the documents' own sentence vectors."""
    found = vectors.sentence_vectors(word_docs(spark, root), "words", size=16)
    return density.density_topics(found, "embedding", min_cluster=10, min_samples=5)


@query
def both_models(spark, root):
    """LDA and embedding topics of both polarities, side by side."""
    return stages.model_texts(texts(spark, root), k=3).assignments


@query
def density_topics(spark, root):
    return density.density_topics(table(spark, root, "embeddings"), "embedding", "vec_id", min_cluster=10, min_samples=5)


@query
def class_tfidf(spark, root):
    return topics.class_tfidf(word_docs(spark, root), "lang", "words", outlier="none")


@query
def subset_sizes(spark, root):
    return topics.subset_sizes(word_docs(spark, root), ["lang", "source"], "words", least=10)


@query
def subset_topics(spark, root):
    return topics.per_subset(word_docs(spark, root), ["lang"], "words")


@query
def term_frequency(spark, root):
    return topics.term_frequency(word_docs(spark, root), ["lang", "source"], "words")


@query
def topic_distribution(spark, root):
    obs = observations(spark, root).withColumn("stay", F.lower("stay_type"))
    return aggregates.topic_distribution(obs, "temporal_window", {"topic": STARS, "stay": ["f", "o", "p"]})


# ---- aggregates and comparisons

@query
def sentiment_window(spark, root):
    return aggregates.sentiment_by(observations(spark, root), "temporal_window", emotion="emotion_label",
                                   emotions=SEGMENTS)


@query
def sentiment_group(spark, root):
    return aggregates.sentiment_by(observations(spark, root), "city", emotion="emotion_label", emotions=SEGMENTS)


@query
def emotion_pivot(spark, root):
    return aggregates.emotion_pivot(table(spark, root, "events"), ["user_id"], "event_type", EVENT_TYPES)


@query
def volumetric(spark, root):
    return compare.volumetric(observations(spark, root), OBS_DESIGN)


@query
def window_counts(spark, root):
    return compare.window_counts(observations(spark, root))


@query
def sentiment_change(spark, root):
    return compare.sentiment_change(observations(spark, root), OBS_DESIGN)


@query
def sentiment_change_emotion(spark, root):
    return compare.sentiment_change(observations(spark, root), OBS_DESIGN, emotion="emotion_label", emotions=SEGMENTS)


@query
def target_vs_control(spark, root):
    return compare.target_vs_control(observations(spark, root), OBS_DESIGN)


@query
def category_share_window(spark, root):
    return compare.category_share_by_window(observations(spark, root), OBS_DESIGN, "topic")


@query
def category_share_group(spark, root):
    return compare.category_share_by_group(observations(spark, root), OBS_DESIGN, "topic")


@query
def top3_categories(spark, root):
    shares = compare.category_share_by_window(observations(spark, root), OBS_DESIGN, "topic")
    return compare.top_categories(shares, ["window", "year"])


@query
def key_findings(spark, root):
    return compare.key_findings(observations(spark, root), OBS_DESIGN, "topic")


@query
def temporal_summary(spark, root):
    return aggregates.temporal_summary(observations(spark, root), OBS_DESIGN)


@query
def box_stats(spark, root):
    obs = joins.in_windows(observations(spark, root), OBS_DESIGN.event_labels)
    stats = quantiles.box_stats(obs, ["city", "temporal_window"], "rating")
    figures = ("mean", "q1", "median", "q3", "whisker_low", "whisker_high")
    return stats.withColumns({c: numbers.half_even(c, 4) for c in figures})


@query
def box_outliers(spark, root):
    items = table(spark, root, "lineitem").withColumn("l_price", F.col("l_extendedprice") / F.col("l_quantity"))
    return quantiles.box_outliers(items, ["l_returnflag"], "l_price", whisker=0.5)


@query
def year_compare(spark, root):
    out = aggregates.year_compare(observations(spark, root), OBS_DESIGN)
    return out.withColumns({c: numbers.half_even(c, 4) for c in ("rating", "sentiment")})


# ---- sampling and evaluation

@query
def stratified_sample(spark, root):
    docs = texts(spark, root)
    return sampling.stratified_sample(docs, "lang", "review_id", columns=["review_id", "lang", "absent"])


@query
def sample_stats(spark, root):
    return sampling.sample_stats(voted(spark, root), "source", "text_positive", "predicted", wanted="en")


@query
def confusion_matrix(spark, root):
    return evaluate.confusion(voted(spark, root), "lang", "predicted_long", LANGUAGES)


@query
def class_report(spark, root):
    return evaluate.class_report(voted(spark, root), "lang", "predicted_long", LANGUAGES)


@query
def accuracy_by_slice(spark, root):
    return evaluate.accuracy_by_slice(voted(spark, root), "lang", "predicted_long", "source")


@query
def mean_slice_accuracy(spark, root):
    slices = evaluate.accuracy_by_slice(voted(spark, root), "lang", "predicted_long", "source")
    mean = evaluate.mean_slice_accuracy(slices)
    return mean.withColumn("mean_accuracy", numbers.half_even("mean_accuracy", 6))


@query
def model_comparison(spark, root):
    models = {"all words": "predicted", "long words": "predicted_long"}
    return evaluate.compare_models(voted(spark, root), "lang", models, LANGUAGES)


@query
def label_union(spark, root):
    docs = voted(spark, root).withColumn("predicted", scoring.collapse_language("text_positive", "predicted"))
    return evaluate.label_union(docs, "lang", "predicted")


# ---- joins

@query
def stage_join(spark, root):
    stage = table(spark, root, "labels").select(F.col("doc_id").alias("review_id"), F.lit("x").alias("lang"),
                                                "quality", "toxic")
    return joins.stage_join(texts(spark, root).select("review_id", "lang"), stage)


def _copies(spark, root):
    left = texts(spark, root).select("review_id", "lang", "text_positive", "text_negative")
    return left, texts(spark, root)


@query
def natural_key_join(spark, root):
    left, right = _copies(spark, root)
    out = joins.natural_key_join(left, right, ["lang", "text_positive", "text_negative"], "review_id")
    return out.select("review_id", "lang", "source")


@query
def natural_key_fanout(spark, root):
    left, right = _copies(spark, root)
    out = joins.natural_key_join(left, right, ["lang", "text_positive", "text_negative"], "review_id", fanout=True)
    return out.groupBy("lang").agg(F.count("*").alias("n_rows"), F.sum("n_matches").alias("n_joined"))


@query
def window_range_join(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("order_day"))
    return joins.window_range_join(orders, "order_day", OBS_DESIGN)


@query
def semi_windows(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("order_day"))
    return joins.semi_windows(orders, "order_day", OBS_DESIGN)

"""The study end to end: raw reviews to stages to results, each stage a written table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.design import StudyDesign
from tideline.functions import text
from tideline.functions.dates import italian_date
from tideline.functions.numbers import coerce_numeric, half_even
from tideline.operators import aggregates, compare, joins, quantiles, scoring, topics
from tideline.operators.scoring import Factory
from tideline.sources import reviews

# Text and date columns of a review, and its numeric columns.
TEXT_COLUMNS = ["text_positive", "text_negative", "review_title"]
DATE_COLUMNS = ["review_date", "stay_date"]
NUMBER_COLUMNS = ["rating", "sentiment_score", "property_stars", "nights_stayed"]
POLARITIES = ["positive", "negative"]
FIXED_TOPICS = 10


@dataclass
class Resources:
    """Word lists and models. Without models the word lists score.

    Large lists are tables: ``lexicon`` may be one of (word, weight), and ``lemma_table``
    one of (language, form, lemma), used in place of ``lemmas``.
    """

    languages: dict[str, str] = field(default_factory=lambda: {"it": "italian", "en": "english"})
    lemmas: dict[str, dict[str, str]] = field(default_factory=dict)
    lexicon: dict[str, float] | DataFrame = field(default_factory=dict)
    lemma_table: DataFrame | None = None
    emotion_lists: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    star_model: Factory | None = None
    emotion_models: dict[str, Factory] = field(default_factory=dict)
    batch_size: int = 8
    max_chars: int | None = None

    def word_lists(self) -> dict[str, list[str]]:
        return {code: text.stopwords(name) for code, name in self.languages.items()}


def preprocess(raw: DataFrame, design: StudyDesign, resources: Resources) -> DataFrame:
    """Placeholders, dates, windows, clean words, lemmas and features: one pass, no shuffle.

    The language is voted on all words of a text, before stop-words are removed. Rows
    without a key get one; it is final once the stage is written.
    """
    df = raw
    for name in reviews.ALIASES:
        if any(c in df.columns for c in reviews.ALIASES[name]):
            df = reviews.resolve_alias(df, name)
    if "review_id" not in df.columns:
        df = df.withColumn("review_id", F.monotonically_increasing_id())
    if "city" in df.columns:
        df = df.withColumn("city", text.canonical_group("city"))
    if "text_negative" in df.columns:
        df = df.withColumn("text_negative", text.null_placeholder("text_negative"))
    df = df.withColumns({c: italian_date(c) for c in DATE_COLUMNS if c in df.columns})
    df = df.withColumn("temporal_window", design.assign("review_date"))
    lists = resources.word_lists()
    drop = sorted({w for members in lists.values() for w in members})
    present = [c for c in TEXT_COLUMNS if c in df.columns]
    df = df.withColumns({f"{c}_words": text.tokens(text.clean_text(c)) for c in present})
    df = df.withColumns({f"{c}_language": scoring.language_vote(f"{c}_words", lists) for c in present})
    df = df.withColumns({f"{c}_clean": text.remove_words(f"{c}_words", drop) for c in present})
    if resources.lemma_table is None:
        df = df.withColumns({f"{c}_lemma": _lemma(f"{c}_clean", f"{c}_language", resources) for c in present})
    else:
        for c in present:
            df = scoring.lemmatize_table(df, f"{c}_clean", resources.lemma_table, out=f"{c}_lemma", language=f"{c}_language")
    df = text.add_features(df)
    return df.drop(*[f"{c}_words" for c in present])


def _lemma(words: str, language: str, resources: Resources):
    out = None
    for code, lemmas in resources.lemmas.items():
        mapped = text.lemmatize(words, lemmas)
        test = F.col(language) == code
        out = F.when(test, mapped) if out is None else out.when(test, mapped)
    return F.col(words) if out is None else out.otherwise(F.col(words))


def score(processed: DataFrame, resources: Resources, column: str = "text_positive") -> DataFrame:
    """Language, sentiment and emotion of one text column; the others are not scored."""
    df = reviews.fallback_column(processed, column, "")
    lemma = f"{column}_lemma"
    if lemma not in df.columns:
        df = df.withColumn(lemma, text.tokens(text.clean_text(column)))
    if f"{column}_language" not in df.columns:
        words = text.tokens(text.clean_text(column))
        df = df.withColumn(f"{column}_language", scoring.language_vote(words, resources.word_lists()))
    df = df.withColumn("_text", F.array_join(lemma, " "))
    df = df.withColumn("detected_language", scoring.collapse_language("_text", f"{column}_language"))
    if resources.star_model is not None:
        df = scoring.score_text(df, "_text", resources.star_model, resources.batch_size, resources.max_chars, "_stars", "_star_score")
        df = scoring.star_sentiment(df, "_stars").drop("_stars", "_star_score")
    elif isinstance(resources.lexicon, DataFrame):
        df = scoring.lexicon_sentiment_table(df, lemma, resources.lexicon)
    else:
        df = scoring.lexicon_sentiment(df, lemma, resources.lexicon)
    if resources.emotion_models:
        df = scoring.score_by_language(df, "_text", "detected_language", resources.emotion_models,
                                       resources.batch_size, resources.max_chars)
    elif resources.emotion_lists:
        emotion = scoring.emotion_by_language(lemma, "detected_language", resources.emotion_lists)
        df = df.withColumn("_e", emotion).withColumns({
            "emotion_label": F.col("_e.label"), "emotion_score": half_even("_e.score", 4)
        }).drop("_e")
    else:
        df = df.withColumns({"emotion_label": F.lit(scoring.NO_EMOTION), "emotion_score": F.lit(0.0)})
    return df.drop("_text")


@dataclass
class ModelledTexts:
    """Both topic models of both polarities by row key, and their words."""

    assignments: DataFrame
    lda_words: DataFrame
    embedding_words: DataFrame


def model_texts(processed: DataFrame, k: int | None = None, key: str = "review_id", top: int = topics.TOP_WORDS,
                embedder=None, iterations: int = topics.FIT_ITERATIONS, **grid) -> ModelledTexts:
    """LDA and embedding topics of the positive and the negative texts.

    The topic number comes from the likelihood grid unless ``k`` fixes it. Without an
    ``embedder`` the vectors are hashed words.
    """
    out, lda_words, embedding_words = processed.select(key), None, None
    for polarity in POLARITIES:
        lemma = f"text_{polarity}_lemma"
        docs = processed
        if lemma not in docs.columns:
            docs = reviews.fallback_column(docs, f"text_{polarity}", "")
            docs = docs.withColumn(lemma, text.tokens(text.clean_text(f"text_{polarity}")))
        docs = docs.select(key, F.coalesce(lemma, F.array().cast("array<string>")).alias("words"))
        chosen = k if k is not None else topics.choose_k(docs, "words", key, **grid)[0]
        lda = topics.lda_topics(docs, "words", chosen, key, top, iterations=iterations)
        if embedder is None:
            vectors = topics.hashed_embedding(docs, "words")
        else:
            vectors = scoring.embed_text(docs.withColumn("_t", F.array_join("words", " ")), "_t", embedder)
        vectors = vectors.select(key, F.when(F.size("words") > 0, F.col("embedding")).alias("embedding"))
        clusters = topics.embedding_topics(vectors, "embedding", chosen, key)
        named = docs.join(clusters, key)
        words = topics.class_tfidf(named, "topic", "words", top).select(
            F.col("cluster").alias("topic"), "word", "rank", F.lit(polarity).alias("polarity")
        )
        lda_named = lda.top_words.withColumn("polarity", F.lit(polarity))
        lda_words = lda_named if lda_words is None else lda_words.unionByName(lda_named)
        embedding_words = words if embedding_words is None else embedding_words.unionByName(words)
        for model, found in (("lda", lda.assignments), ("embedding", clusters)):
            name = f"{model}_topic_{polarity}"
            out = out.join(found.select(key, F.col("topic").alias(name), F.col("prob").alias(f"{name}_prob")), key, "left")
    return ModelledTexts(out, lda_words, embedding_words)


def topic_columns(df: DataFrame) -> dict[str, list]:
    """Topic columns present and their values."""
    names = [f"{m}_topic_{p}" for p in POLARITIES for m in ("lda", "embedding") if f"{m}_topic_{p}" in df.columns]
    return {n: aggregates.label_values(df, n) for n in names}


def analysis_table(spark: SparkSession, root: str) -> DataFrame:
    """The written stages joined on the row key; absent stages are skipped."""
    out = None
    for name in ("processed", "sentiment", "topics"):
        stage = reviews.read_stage(spark, root, name)
        if stage is not None:
            out = stage if out is None else joins.stage_join(out, stage)
    if out is None:
        raise FileNotFoundError(f"no stages under {root}")
    return coerce_numeric(out, NUMBER_COLUMNS)


def comparisons(df: DataFrame, design: StudyDesign, topic: str = "lda_topic_positive") -> dict[str, DataFrame]:
    """The five comparisons and the findings; those whose columns are absent are left out."""
    have = set(df.columns)
    out = {}
    if {"city", "temporal_window"} <= have:
        out["volumetric"] = compare.volumetric(df, design)
    elif "temporal_window" in have:
        out["volumetric"] = compare.window_counts(df)
    if {"city", "temporal_window", "sentiment_score", "sentiment_label"} <= have:
        emotion = "emotion_label" if "emotion_label" in have else None
        out["sentiment_windows"] = compare.sentiment_change(df, design, emotion=emotion)
        out["sentiment_places"] = compare.target_vs_control(df, design)
    if {"temporal_window", topic} <= have:
        out["topic_windows"] = compare.category_share_by_window(df, design, topic)
        if "city" in have:
            out["topic_places"] = compare.category_share_by_group(df, design, topic)
    if {"city", "temporal_window", "sentiment_score", "sentiment_label", topic} <= have:
        out["key_findings"] = compare.key_findings(df, design, topic)
    return out


def descriptions(df: DataFrame, design: StudyDesign) -> dict[str, DataFrame]:
    """Summaries by window and city, box statistics and the year comparison of the target."""
    events = joins.in_windows(df, design.event_labels)
    places = events.where(F.col("city").isin(design.target, design.control))
    out = {
        "sentiment_by_window": aggregates.sentiment_by(df, "temporal_window", emotion="emotion_label"),
        "sentiment_by_city": aggregates.sentiment_by(df, "city", emotion="emotion_label"),
        "temporal_summary": aggregates.temporal_summary(df, design),
        "year_compare": aggregates.year_compare(df, design),
        "rating_boxes": quantiles.box_stats(places, ["city", "temporal_window"], "rating"),
        "sentiment_boxes": quantiles.box_stats(places, ["city", "temporal_window"], "sentiment_score"),
    }
    found = topic_columns(df)
    if found:
        out["topics_by_window"] = aggregates.topic_distribution(df, "temporal_window", found)
        out["topics_by_city"] = aggregates.topic_distribution(df, "city", found)
    return out


def run_study(spark: SparkSession, raw: DataFrame, root: str, design: StudyDesign, resources: Resources,
              k: int | None = FIXED_TOPICS, **modelling) -> dict[str, DataFrame]:
    """All stages and results, written under ``root``; returns the results.

    Each stage is written before the next reads it, so a lost executor costs one stage at
    most and no plan grows over the whole study.
    """
    reviews.write_stage(preprocess(raw, design, resources), root, "processed", ["temporal_window"])
    processed = reviews.read_stage(spark, root, "processed")
    scored = score(processed, resources)
    reviews.write_stage(scored.select(
        "review_id", "sentiment_label", "sentiment_score", "detected_language", "emotion_label", "emotion_score"
    ), root, "sentiment")
    modelled = model_texts(processed, k, **modelling)
    reviews.write_stage(modelled.assignments, root, "topics")
    reviews.write_result(modelled.lda_words, root, "results/lda_top_words")
    reviews.write_result(modelled.embedding_words, root, "results/embedding_top_words")
    # Every result reads this table, so the stages are joined once and texts left behind.
    joined = analysis_table(spark, root)
    narrow = [f.name for f in joined.schema.fields if f.name not in TEXT_COLUMNS and f.dataType.typeName() != "array"]
    reviews.write_stage(joined.select(*narrow), root, "analysis", ["temporal_window"])
    joined = reviews.read_stage(spark, root, "analysis")
    results = {**comparisons(joined, design), **descriptions(joined, design)}
    for name, frame in results.items():
        reviews.write_result(frame, root, f"results/{name}")
    return results

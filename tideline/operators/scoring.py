"""Language, sentiment and emotion scoring.

Word-list scorers are column expressions and stay in the JVM. Models go through
:func:`score_text`, which sends only the text column to Python and loads a model once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tideline.functions.labels import POLARITY_CUT, polarity_label, star_to_label, star_to_score
from tideline.functions.numbers import as_col, half_even
from tideline.functions.text import count_in, is_valid_text

# Languages kept, the language of any other text, and the label of blank text.
KEPT_LANGUAGES = ("it", "en")
OTHER_LANGUAGE = "it"
NO_LANGUAGE = "unknown"
NO_EMOTION = "unknown"

Model = Callable[[list[str]], list[dict]]
Factory = Callable[[], Model]


def language_vote(words: Column | str, lists: dict[str, list[str]]) -> Column:
    """Language with the most distinct words of the text in its list.

    Ties, and texts that hit no list, go to the language named first.
    """
    def vote(distinct: Column) -> Column:
        return F.array_max(F.array(*[
            F.struct(count_in(distinct, members).alias("hits"), F.lit(-i).alias("order"), F.lit(language).alias("lang"))
            for i, (language, members) in enumerate(lists.items())
        ]))["lang"]

    # Bound once as a lambda variable, so the distinct words are not built per language.
    return F.transform(F.array(F.array_distinct(as_col(words))), vote)[0]


def collapse_language(text: Column | str, language: Column | str, kept: tuple[str, ...] = KEPT_LANGUAGES,
                      other: str = OTHER_LANGUAGE) -> Column:
    """Kept languages as they are, any other or none as ``other``, blank text as ``unknown``."""
    language = as_col(language)
    return (
        F.when(~is_valid_text(text), F.lit(NO_LANGUAGE))
        .when(language.isin(*kept), language)
        .otherwise(F.lit(other))
    )


def lexicon_polarity(words: Column | str, lexicon: dict[str, float]) -> Column:
    """Mean weight of the words found in a word list held as configuration; 0 if none is.

    Words of equal weight share one set test.
    """
    levels: dict[float, list[str]] = {}
    for word, weight in lexicon.items():
        levels.setdefault(float(weight), []).append(word)

    def weight_of(token: Column) -> Column:
        out = None
        for weight, members in levels.items():
            out = F.when(token.isin(members), F.lit(weight)) if out is None else out.when(token.isin(members), F.lit(weight))
        return out

    found = F.filter(F.transform(as_col(words), weight_of), lambda w: w.isNotNull())
    total = F.aggregate(found, F.lit(0.0), lambda acc, w: acc + w)
    return F.coalesce(F.try_divide(total, F.nullif(F.size(found), F.lit(0)).cast("double")), F.lit(0.0))


def lexicon_sentiment(df: DataFrame, words: str, lexicon: dict[str, float], cut: float = POLARITY_CUT) -> DataFrame:
    """sentiment_label by the polarity cuts and sentiment_score rounded to 4 places."""
    return _polarity_columns(df.withColumn("_polarity", lexicon_polarity(words, lexicon)), cut)


def lexicon_sentiment_table(df: DataFrame, words: str, lexicon: DataFrame, key: str = "review_id",
                            cut: float = POLARITY_CUT) -> DataFrame:
    """The same from a lexicon table (word, weight) of any size.

    Adaptive execution broadcasts a small lexicon and splits skewed words. Partial sums per
    text leave each task before the shuffle, since all words of a text start in the same one.
    """
    hits = df.select(key, F.explode(words).alias("word")).join(lexicon, "word")
    scores = hits.groupBy(key).agg(F.avg("weight").alias("_polarity"))
    joined = df.join(scores, key, "left").withColumn("_polarity", F.coalesce("_polarity", F.lit(0.0)))
    return _polarity_columns(joined, cut)


def _polarity_columns(df: DataFrame, cut: float) -> DataFrame:
    return df.withColumns({
        "sentiment_label": polarity_label("_polarity", cut),
        "sentiment_score": half_even("_polarity", 4),
    }).drop("_polarity")


def lemmatize_table(df: DataFrame, words: str, lemmas: DataFrame, key: str = "review_id",
                    out: str = "lemmas", language: str | None = None) -> DataFrame:
    """Lemma of each word from a table (form, lemma) of any size; unknown words stay.

    With ``language``, a column of df, the table also has a language, which must agree.
    """
    same = [F.col(language).alias("language")] if language else []
    exploded = df.select(key, *same, F.posexplode(words).alias("pos", "form"))
    joined = exploded.join(lemmas, ["form", "language"] if language else "form", "left")
    mapped = joined.withColumn("lemma", F.coalesce("lemma", "form")).where(F.trim("lemma") != "")
    # One text's own words only: the list is as long as the text.
    lists = mapped.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "lemma"))).alias("_l"))
    joined = df.join(lists.select(key, F.col("_l.lemma").alias(out)), key, "left")
    return joined.withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def emotion_lexicon(words: Column | str, lists: dict[str, list[str]]) -> Column:
    """Struct (label, score): the emotion with most words in the text and its share of all hits."""
    counts = [
        F.struct(count_in(words, members).alias("n"), F.lit(-i).alias("order"), F.lit(label).alias("label"))
        for i, (label, members) in enumerate(lists.items())
    ]
    ranked = F.array(*counts)
    total = F.aggregate(ranked, F.lit(0), lambda acc, c: acc + c["n"])
    best = F.array_max(ranked)
    return F.struct(
        F.when(total > 0, best["label"]).otherwise(F.lit(NO_EMOTION)).alias("label"),
        F.when(total > 0, half_even(best["n"].cast("double") / F.nullif(total, F.lit(0)).cast("double"), 4))
        .otherwise(F.lit(0.0)).alias("score"),
    )


def emotion_by_language(words: Column | str, language: Column | str,
                        lexica: dict[str, dict[str, list[str]]]) -> Column:
    """Emotion from the word lists of the text's language; none for other languages."""
    out = None
    for code, lists in lexica.items():
        test, value = as_col(language) == F.lit(code), emotion_lexicon(words, lists)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.struct(F.lit(NO_EMOTION).alias("label"), F.lit(0.0).alias("score")))


def model_input(text: Column | str, max_chars: int | None = None) -> Column:
    """Text for a model: blank becomes one space; cut only for a model with an input limit."""
    text = as_col(text)
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    return F.when(is_valid_text(text), text).otherwise(F.lit(" "))


def score_text(df: DataFrame, text: str, factory: Factory, batch_size: int = 8, max_chars: int | None = None,
               label: str = "label", score: str = "score") -> DataFrame:
    """Add the label (lower case) and score a model gives to each text.

    ``factory`` runs once per task and returns a callable from a list of texts to a list
    of dicts with ``label`` and ``score``; a list of such dicts per text takes its best.
    """
    @pandas_udf("label string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for texts in batches:
            yield _predict(model, texts.tolist(), batch_size)

    scored = df.withColumn("_s", run(model_input(text, max_chars)))
    return scored.withColumns({label: F.lower("_s.label"), score: F.col("_s.score")}).drop("_s")


def score_by_language(df: DataFrame, text: str, language: str, factories: dict[str, Factory], batch_size: int = 8,
                      max_chars: int | None = None, label: str = "emotion_label",
                      score: str = "emotion_score") -> DataFrame:
    """Score each text with the model of its language, in one pass over the rows.

    Texts of a language without a model, and blank ones, get (``unknown``, 0.0).
    """
    @pandas_udf("label string, score double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        models: dict[str, Model] = {}
        for texts, languages in batches:
            out = pd.DataFrame({"label": NO_EMOTION, "score": 0.0}, index=texts.index)
            for code, part in texts.groupby(languages):
                if code not in factories:
                    continue
                if code not in models:
                    models[code] = factories[code]()
                found = _predict(models[code], part.tolist(), batch_size)
                out.loc[part.index, ["label", "score"]] = found[["label", "score"]].to_numpy()
            out["score"] = out["score"].astype("float64")
            yield out

    scored = df.withColumn("_s", run(model_input(text, max_chars), as_col(language)))
    return scored.withColumns({label: F.lower("_s.label"), score: half_even("_s.score", 4)}).drop("_s")


def _predict(model: Model, texts: list[str], batch_size: int) -> pd.DataFrame:
    labels, scores = [], []
    for start in range(0, len(texts), batch_size):
        for found in model(texts[start:start + batch_size]):
            best = max(found, key=lambda p: p["score"]) if isinstance(found, list) else found
            labels.append(best["label"])
            scores.append(float(best["score"]))
    return pd.DataFrame({"label": labels, "score": scores})


def star_sentiment(df: DataFrame, stars: str) -> DataFrame:
    """sentiment_label and sentiment_score of a star label."""
    return df.withColumns({"sentiment_label": star_to_label(stars), "sentiment_score": star_to_score(stars)})


def embed_text(df: DataFrame, text: str, factory: Callable[[], Callable[[list[str]], list]], batch_size: int = 8,
               out: str = "embedding") -> DataFrame:
    """Add the vector a model gives to each text."""
    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            values = texts.tolist()
            vectors = []
            for start in range(0, len(values), batch_size):
                vectors.extend(list(map(float, v)) for v in model(values[start:start + batch_size]))
            yield pd.Series(vectors)

    return df.withColumn(out, run(model_input(text)))

from datetime import date

import pytest
from pyspark.sql import functions as F

from tideline import StudyDesign
from tideline.functions import dates, labels, numbers, text

DESIGN = StudyDesign.two_years("target", "control", 2026, 2025)


def test_italian_date(values):
    texts = ["4º marzo 2023", "17 agosto 2022", "3° GIUGNO 2025", "visto il 2 luglio 2024, poi 3 agosto 2024",
             "31 febbraio 2026", "5 foo 2026", "0 aprile 2025", "", None, "12 maggio 2026"]
    assert values(dates.italian_date("v"), texts) == [
        date(2023, 3, 4), date(2022, 8, 17), date(2025, 6, 3), date(2024, 7, 2), None, None, None, None, None,
        date(2026, 5, 12)]


def test_strict_date(values):
    texts = ["20 maggio 2026", " 1ª maggio 2026 ", "x 20 maggio 2026", "20 Maggio 2026", "20 May 2026", "31 aprile 2026", None]
    assert values(dates.strict_italian_date("v"), texts) == [
        date(2026, 5, 20), date(2026, 5, 1), None, None, date(2026, 5, 20), None, None]


def test_range_keeps_undated(values):
    days = [date(2026, 5, 24), date(2026, 5, 25), date(2026, 6, 15), date(2026, 6, 16), None]
    assert values(dates.in_date_range("v", date(2026, 5, 25), date(2026, 6, 15)), days, "date") == [False, True, True, False, True]
    assert values(dates.in_date_range("v", None, None), days, "date") == [True] * 5


@pytest.mark.parametrize("day,label", [
    ((2026, 4, 1), "pre"), ((2026, 5, 20), "pre"), ((2026, 5, 21), "during"), ((2026, 5, 24), "during"),
    ((2026, 5, 25), "post"), ((2026, 6, 15), "post"), ((2026, 6, 16), "outside"), ((2026, 3, 31), "outside"),
    ((2025, 4, 1), "baseline_pre"), ((2025, 5, 24), "baseline_during"), ((2025, 6, 15), "baseline_post"),
    ((2024, 5, 1), "outside"),
])
def test_windows(values, day, label):
    assert values(DESIGN.assign("v"), [date(*day)], "date") == [label]


def test_window_unknown_and_order(values):
    assert values(DESIGN.assign("v"), [None], "date") == ["unknown"]
    assert values(DESIGN.ordinal("v"), ["pre", "during", "post"]) == [1, 2, 3]
    assert DESIGN.day_count() == 2 * (50 + 4 + 22)


def test_clean_text(values):
    texts = ["Perché NO?!  Sì,\tcamera_2 n.3", "  ", None, "---", "più bello…"]
    clean = values(text.clean_text("v"), texts)
    assert clean == ["perché no sì camera_2 n 3", "", "", "", "più bello"]
    assert values(text.clean_text("v"), clean) == clean


def test_tokens_and_stopwords(values):
    assert values(text.tokens("v"), ["", "a b a"]) == [[], ["a", "b", "a"]]
    drop = text.stopwords("italian", "english")
    assert values(text.remove_words(text.tokens("v"), drop), ["the mare the sole e mare"]) == [["mare", "sole", "mare"]]
    assert values(text.lemmatize(text.tokens("v"), {"camere": "camera", "gone": " "}), ["camere gone blu"]) == [["camera", "blu"]]


def test_sql_needs_no_spark_install(monkeypatch, tmp_path):
    import pyspark
    from tideline.plans import oracle

    monkeypatch.setattr(pyspark, "__file__", str(tmp_path / "__init__.py"))
    assert len(oracle.oracle_sql()) >= 70
    for language in ("italian", "english", "french", "german", "spanish"):
        assert len(text.stopwords(language)) > 100


def test_lengths_and_blanks(values):
    texts = ["una  bella\ncamera ", "", None, "   ", "a b"]
    assert values(text.word_count("v"), texts) == [3, 0, 0, 0, 2]
    assert values(text.is_valid_text("v"), texts) == [True, False, False, False, True]


def test_missing_tokens(values):
    assert values(text.null_tokens("v"), ["None", "N/A", "", "nothing", "none"]) == [None, None, None, "nothing", "none"]
    assert values(text.null_placeholder("v"), ["---", "--- ", None]) == [None, "--- ", None]


def test_numbers(values):
    assert values(numbers.parse_rating("v"), ["8,5", "Voto 9.0 su 10", "85", "10", "nessuno", None]) == [8.5, 9.0, 8.5, 10.0, None, None]
    assert values(numbers.parse_count("v"), ["4 su 5", "stelle: 3", "x", None]) == [4, 3, None, None]
    assert values(numbers.parse_nights("v"), ["3 notti · maggio", "1 NOTTE", "circa 3 notti", None]) == [3, 1, None, None]
    assert values(numbers.to_number("v"), ["1.5", "x", None]) == [1.5, None, None]


@pytest.mark.parametrize("new,old,want", [
    (333, 184, 80.98), (5090, 4256, 19.60), (942, 1452, -35.12), (5, 0, None), (0, 4, -100.0), (0, -0.5, 100.0),
    (0.563, 0.794, -29.09), (0.631, 0.794, -20.53),
])
def test_pct_change(spark, new, old, want):
    df = spark.createDataFrame([(float(new), float(old))], "n double, o double")
    assert df.select(numbers.pct_change("n", "o")).first()[0] == want


def test_half_even(values):
    assert values(numbers.half_even("v", 2), [3.125, 0.135, -3.125, None], "double") == [3.12, 0.14, -3.12, None]


def test_strings(values):
    assert values(text.strip_quotes("v"), [" «Bello » ", "«»", "no"]) == ["Bello", "", "no"]
    assert values(text.strip_date_prefix("v"), ["Data della recensione: 20 maggio 2026"]) == ["20 maggio 2026"]
    assert values(text.property_from_url("v"), ["https://h.example/hotel/it/b-b-l-angolo4you.it.html?x=1", "https://h.example/x", None]) == [
        "B B L Angolo4You", "unknown", "unknown"]
    assert values(text.slug("v"), ["Città Pre-Evento!"]) == ["città_pre_evento"]
    assert values(text.display_group("v"), ["  VALLE d'oro "]) == ["Valle D'Oro"]
    found = text.stay_type(F.lit(None).cast("string"), F.split("v", ";"))
    assert values(found, ["x;Coppia;Solo", "x"]) == ["Coppia", ""]


def test_labels(values):
    stars = ["1 star", "2 STARS", "3 stars", "4 stars", "5 stars", "6 stars"]
    assert values(labels.star_to_label("v"), stars) == ["negative", "negative", "neutral", "positive", "positive", "neutral"]
    assert values(labels.star_to_score("v"), stars) == [-1.0, -0.5, 0.0, 0.5, 1.0, 0.0]
    assert values(labels.normalise_three_class("v"), stars) == ["negative", "negative", "neutral", "positive", "positive", "positive"]
    assert values(labels.normalise_binary_stars("v"), stars) == ["negative", "negative"] + ["positive"] * 4
    assert values(labels.normalise_binary_label("v"), [" LABEL_1", "Positive", "label_0", "x"]) == ["positive", "positive", "negative", "negative"]
    assert values(labels.polarity_label("v"), [0.05, 0.06, -0.05, -0.06], "double") == ["neutral", "positive", "neutral", "negative"]


def test_top_class(spark):
    df = spark.createDataFrame([([("A", 0.2), ("B", 0.5), ("C", 0.5)],)], "p array<struct<label:string,score:double>>")
    assert tuple(df.select(labels.top_class("p").alias("t")).select("t.*").first()) == ("b", 0.5)

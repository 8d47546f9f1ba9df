import sys
from datetime import date, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tideline import StudyDesign
from tideline.plans.stages import Resources, analysis_table, preprocess, run_study, score
from tideline.sources import reviews

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DESIGN = StudyDesign.two_years("cala", "monte", 2026, 2025)
MONTHS = ["aprile", "maggio", "giugno"]
RESOURCES = Resources(
    lemmas={"it": {"camere": "camera", "belle": "bello"}},
    lexicon={"bello": 1.0, "rumorosa": -1.0, "pulita": 0.5},
    emotion_lists={"it": {"gioia": ["bello"], "rabbia": ["rumorosa"]}},
)


def raw_rows():
    sea, town = "le camere belle con la vista sul mare e la spiaggia", "la piazza era rumorosa ma il centro è vicino"
    out = []
    for i in range(240):
        year, month, day = 2025 + i % 2, 4 + i % 3, 1 + i % 24
        good = i % 4 < 2
        out.append({
            "city": " Cala" if i % 3 else "MONTE", "property_name": f"casa {i % 7}", "rating": str(6 + i % 4),
            "review_date": f"{day}º {MONTHS[month - 4]} {year}" if i % 50 else "ieri",
            "text_positive": sea if good else town, "text_negative": "---" if i % 2 else ("stanza fredda e piccola" if good else "bagno vecchio e sporco"),
            "review_title": "Ottimo" if good else "Mah",
        })
    return out


@pytest.fixture(scope="module")
def raw(spark):
    names = list(raw_rows()[0])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in raw_rows()], ", ".join(f"{n} string" for n in names))


def test_preprocess(spark, raw):
    df = preprocess(raw, DESIGN, RESOURCES)
    first = df.where("text_positive like 'le camere%' and review_date is not null").first()
    assert first["text_positive_language"] == "it" and first["review_length"] == 11
    assert first["text_positive_lemma"] == ["camera", "bello", "vista", "mare", "spiaggia"]
    assert df.where("text_negative is null").count() == df.where("not has_negative").count() == 120
    assert df.where("temporal_window = 'unknown'").count() == df.where("review_date is null").count() == 5
    assert {r.city for r in df.select("city").distinct().collect()} == {"cala", "monte"} and "property" in df.columns
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_tables_give_what_lists_give(spark, raw):
    lemmas = spark.createDataFrame([("it", k, v) for k, v in RESOURCES.lemmas["it"].items()], "language string, form string, lemma string")
    lexicon = spark.createDataFrame(list(RESOURCES.lexicon.items()), "word string, weight double")
    tables = Resources(lemma_table=lemmas, lexicon=lexicon, emotion_lists=RESOURCES.emotion_lists)
    kept = ["review_id", "text_positive_lemma", "sentiment_label", "sentiment_score"]
    fixed = raw.withColumn("review_id", F.monotonically_increasing_id()).cache()
    one, two = (score(preprocess(fixed, DESIGN, r), r).select(*kept).orderBy("review_id").collect() for r in (RESOURCES, tables))
    assert one == two


def stars():
    return lambda texts: [{"label": "5 stars" if "bello" in t else "1 star", "score": 0.9} for t in texts]


def test_score_with_model_and_without(spark, raw):
    processed = preprocess(raw, DESIGN, RESOURCES)
    lexical = score(processed, RESOURCES).groupBy("sentiment_label").count().collect()
    assert {r.sentiment_label: r["count"] for r in lexical} == {"positive": 120, "negative": 120}
    modelled = score(processed, Resources(star_model=stars))
    got = {(r.sentiment_label, r.sentiment_score, r.emotion_label) for r in modelled.select(
        "sentiment_label", "sentiment_score", "emotion_label").distinct().collect()}
    assert got == {("positive", 1.0, "unknown"), ("negative", -1.0, "unknown")}


def test_study(spark, raw, tmp_path):
    root = str(tmp_path)
    results = run_study(spark, raw, root, DESIGN, RESOURCES, k=2, iterations=5)
    table = analysis_table(spark, root)
    assert table.count() == 240 and table.select("review_id").distinct().count() == 240
    for polarity in ("positive", "negative"):
        assert table.where(F.col(f"lda_topic_{polarity}").isNull()).count() == 0
    assert table.where("lda_topic_negative = -1").count() == 120
    # windows partition the rows
    windows = {r.temporal_window: r.review_count for r in results["sentiment_by_window"].collect()}
    assert sum(windows.values()) == 240 and windows["unknown"] == 5
    want = {}
    for i, r in enumerate(raw_rows()):
        day = date(2025 + i % 2, 4 + i % 3, 1 + i % 24)
        if i % 50 and r["city"] == " Cala" and day.year == 2026 and date(2026, 4, 1) <= day <= date(2026, 5, 20):
            want["n"] = want.get("n", 0) + 1
    pre = results["volumetric"].where("city = 'cala' and window_event = 'pre'").first()
    assert pre.reviews_event == want["n"]
    assert set(results) >= {"volumetric", "sentiment_windows", "sentiment_places", "topic_windows", "topic_places",
                            "key_findings", "temporal_summary", "rating_boxes", "topics_by_window"}
    saved = spark.read.csv(f"{root}/results/volumetric", header=True)
    assert saved.count() == results["volumetric"].count() == 6
    words = spark.read.csv(f"{root}/results/lda_top_words", header=True)
    assert {r.polarity for r in words.collect()} == {"positive", "negative"}


def test_missing_stages(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        analysis_table(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "8.5", "pre")], "review_id long, rating string, temporal_window string")
    reviews.write_stage(df, str(tmp_path), "processed")
    assert analysis_table(spark, str(tmp_path)).first().rating == 8.5
    assert DESIGN.windows[0].end - DESIGN.windows[0].start == timedelta(days=49)


def test_step_killed_between_its_writes_is_repeated_whole(spark, tmp_path, monkeypatch):
    from tideline.streaming import ingest

    schema = "url string, n int"
    for i in range(3):
        spark.createDataFrame([(f"u{i}{j}", j) for j in range(5)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    run = lambda: ingest.resumable_step(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/done", f"{tmp_path}/log", schema, "url",
                                        files_per_batch=1)
    kept, calls = ingest.write_batch, []

    def killed(rows, folder, number):
        calls.append(folder)
        if len(calls) == 4:  # results of the second batch are written, its keys are not
            raise RuntimeError("killed")
        kept(rows, folder, number)

    monkeypatch.setattr(ingest, "write_batch", killed)
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(ingest, "write_batch", kept)
    half = ingest.committed(spark, f"{tmp_path}/out", f"{tmp_path}/done")
    assert half.count() == 5
    for _ in range(2):
        run()
    rows = ingest.committed(spark, f"{tmp_path}/out", f"{tmp_path}/done")
    assert sorted(r.url for r in rows.collect()) == [f"u{i}{j}" for i in range(3) for j in range(5)]
    done = spark.read.parquet(f"{tmp_path}/done")
    assert done.count() == done.select("url").distinct().count() == 15

from datetime import date

import pytest
from pyspark.sql import functions as F

from tideline.functions.dates import italian_date
from tideline.session import scratch_path
from tideline.sources import ledger, pages, reviews
from tideline.streaming.ingest import stream_reviews


def write(path, content):
    path.write_text(content, encoding="utf-8")


def test_read_reviews_binds_by_name(spark, tmp_path):
    write(tmp_path / "a.csv", 'city,rating,text_positive\nx,"8,5","due\nrighe, con ""virgolette"""\ny,9,None\n')
    write(tmp_path / "b.csv", "text_positive,city,text_negative\nbello,z,---\n")
    write(tmp_path / "notes.txt", "no\n")
    got = {r.city: r.asDict() for r in reviews.read_reviews(spark, str(tmp_path)).collect()}
    assert got["x"]["text_positive"] == 'due\nrighe, con "virgolette"' and got["x"]["rating"] == "8,5"
    assert got["y"]["text_positive"] is None and got["z"]["text_positive"] == "bello"
    assert got["z"]["rating"] is None and got["x"]["text_negative"] is None
    kept = reviews.read_reviews(spark, str(tmp_path), na_as_null=False).where("city = 'y'").first()
    assert kept.text_positive == "None"


def test_read_reviews_empty_folder(spark, tmp_path):
    got = reviews.read_reviews(spark, str(tmp_path))
    assert got.count() == 0 and "text_positive" in got.columns


def test_stages(spark, tmp_path):
    root = str(tmp_path)
    assert reviews.read_stage(spark, root, "nothing") is None
    df = spark.createDataFrame([(1, "pre"), (2, "post")], "review_id long, temporal_window string")
    reviews.write_stage(df, root, "s", ["temporal_window"])
    reviews.write_stage(df, root, "s", ["temporal_window"])
    back = reviews.read_stage(spark, root, "s")
    assert back.count() == 2
    plan = back.where("temporal_window = 'pre'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(temporal_window" in plan
    reviews.write_result(df, root, "r")
    assert spark.read.csv(f"{root}/r", header=True).count() == 2


def test_report_appends_and_restarts(spark, tmp_path):
    row = spark.createDataFrame([("m", 0.5)], "model string, accuracy double")
    path = str(tmp_path / "report")
    for fresh, want in ((True, 1), (False, 2), (True, 1)):
        reviews.append_report(row, path, fresh)
        assert spark.read.parquet(path).count() == want


def test_columns_by_presence(spark):
    df = spark.createDataFrame([("x", "t")], "property_city string, text_positive string")
    assert reviews.resolve_alias(df, "city").columns == ["city", "text_positive"]
    with pytest.raises(ValueError):
        reviews.resolve_alias(df, "property")
    filled = reviews.fallback_column(df, "lemma", "text_positive").first()
    assert filled.lemma == "t" and reviews.fallback_column(df, "a", "b").first().a is None
    assert reviews.select_present(df, ["text_positive", "zzz"]).columns == ["text_positive"]


def test_tag_by_file(spark, tmp_path):
    write(tmp_path / "one.csv", "a\n1\n")
    write(tmp_path / "two.csv", "a\n2\n")
    write(tmp_path / "three.csv", "a\n3\n")
    df = spark.read.csv(str(tmp_path), header=True)
    got = reviews.tag_by_file(df, {"one.csv": "pre", "two.csv": "post"}).collect()
    assert {(r.a, r.temporal_window) for r in got} == {("1", "pre"), ("2", "post")}


def test_benchmark_takes_integer_codes(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 2), (3, None, 1), (4, "d", 9), (5, "e", None)], "id int, text string, code int")
    names = {"0": "negative", "1": "neutral", "2": "positive"}
    got = reviews.load_benchmark(df, "id", "text", "code", names).collect()
    assert {(r.id, r.label) for r in got} == {(1, "negative"), (2, "positive")}
    assert reviews.load_benchmark(df, "id", "text", "code", names, keep=["positive"], most=None).count() == 1


def test_gold(spark):
    df = spark.createDataFrame([(" Positive",), ("NEGATIVE",), ("",), ("nan",), (None,), ("boh",)], "annotation string")
    assert {r.annotation for r in reviews.load_gold(df).collect()} == {"positive", "negative"}
    assert {r.status: r.n for r in reviews.gold_rejects(df).collect()} == {"valid": 2, "blank": 3, "invalid": 1}


def test_ledger_resumes(spark, tmp_path):
    root = str(tmp_path)
    items = spark.createDataFrame([("u1",), ("u2",), ("u2",), ("u3",)], "url string")
    assert ledger.pending(items, ledger.read_ledger(spark, root, "done")).count() == 4
    ledger.commit_done(items.where("url = 'u2'"), root, "done")
    ledger.commit_done(items.where("url = 'u1'"), root, "done")
    assert [r.url for r in ledger.pending(items, ledger.read_ledger(spark, root, "done")).collect()] == ["u3"]
    ledger.clear_ledger(spark, root, "done")
    assert ledger.pending(items, ledger.read_ledger(spark, root, "done")).count() == 4


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("review_date", F.lit("12 maggio 2026"))
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    src, dst, log = (str(tmp_path / n) for n in ("src", "dst", "log"))
    parse = lambda df: df.withColumn("review_date", italian_date("review_date"))
    half = F.col("event_id") < 500
    for part in (events.where(half), events.where(~half), None):
        if part is not None:
            part.write.mode("append").parquet(src)
        stream_reviews(spark, src, dst, log, schema, transform=parse)
    got = spark.read.parquet(dst)
    assert got.count() == events.count() == got.select("event_id").distinct().count()
    assert got.first().review_date == date(2026, 5, 12)


def test_scratch_paths_differ(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


CARD = """
<html><body><div data-testid="rating-squares" aria-label="4 su 5"></div>
<div data-testid="review-card">
 <div data-testid="review-avatar"><div class="x b08850ce41 y">Anna</div></div>
 <img src="/images-flags/it.png" alt="Italia">
 <h4 data-testid="review-title">«Ottimo soggiorno»</h4>
 <div data-testid="review-score"><div>Voto</div> 8,5</div>
 <span data-testid="review-date">Data della recensione: 9 ottobre 2021</span>
 <span>Coppia</span><span>3 notti · maggio</span>
 <div data-testid="review-positive-text"><script>x()</script> <b>Bella</b> vista &amp; mare</div>
 <div data-testid="review-negative-text">«---»</div>
</div>
<div data-testid="review-card"><div data-testid="review-negative-text">solo male</div></div>
</body></html>"""
OLDER = """
<div data-testid="quality-rating"><span aria-hidden="true"></span><span aria-hidden="true"></span></div>
<div itemprop="review"><p data-testid="featuredreview-text">Comodo</p><p class="a review-score-x">85</p>
<i data-testid="review-stay-date">maggio</i><i data-testid="review-num-nights">2 notti</i>
<i data-testid="review-stay-type">Solo</i></div><div itemprop="review"><br></div>"""


def test_review_cards(spark):
    df = spark.createDataFrame([
        (1, "https://h.example/hotel/it/casa-blu.it.html", CARD), (2, "https://h.example/", OLDER),
        (3, "u", None), (4, "u", "<p>no cards"),
    ], "page_id long, url string, html string")
    rows = pages.review_rows(df, F.lit("x"), F.lit("web"))
    got = {r.page_id: r.asDict() for r in pages.with_review_day(rows).collect()}
    assert set(got) == {1, 2}
    a, b = got[1], got[2]
    assert (a["property"], a["property_stars"], a["rating"], a["review_title"]) == ("Casa Blu", 4, 8.5, "Ottimo soggiorno")
    assert (a["stay_type"], a["nights_stayed"], a["reviewer"], a["reviewer_country"]) == ("Coppia", 3, "Anna", "Italia")
    assert (a["text_positive"], a["text_negative"], a["review_date"]) == ("Bellavista & mare", "---", "9 ottobre 2021")
    assert a["review_day"] == date(2021, 10, 9)
    assert (b["property"], b["property_stars"], b["rating"], b["stay_type"], b["nights_stayed"]) == ("unknown", 2, 8.5, "Solo", 2)
    assert (b["text_positive"], b["review_date"], b["review_day"]) == ("Comodo", "maggio", None)


def test_links(spark):
    cards = ('<div data-testid="property-card"><a data-testid="title-link" href="/hotel/it/a.html?x=1&amp;y=2">A</a>'
             '<a href="/hotel/it/zz.html">photo</a></div><div data-testid="property-card"><a href="https://h/b" data-testid="title-link">B</a></div>')
    plain = '<a class="k" href="/hotel/it/c.html">C</a><a href="/about">?</a><a href="https://h/b/hotel/">D</a><a href="/hotel/it/c.html">again</a>'
    df = spark.createDataFrame([(1, cards), (2, plain), (3, cards)], "page_id long, html string")
    got = [(r.url, r.first_page, r.first_pos) for r in
           pages.extract_links(df, "https://h").orderBy("first_page", "first_pos").collect()]
    assert got == [("https://h/hotel/it/a.html?x=1&y=2", 1, 0), ("https://h/b", 1, 1), ("https://h/hotel/it/c.html", 2, 0),
                   ("https://h/b/hotel/", 2, 1)]
    assert pages.extract_links(df, "https://h", most=2).count() == 2


def test_a_page_that_is_no_markup_has_no_cards():
    from tideline.sources import markup, pages

    assert markup.read_cards("<![foo<article><h1>x</h1>", pages.ARTICLES) == []

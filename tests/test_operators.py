from datetime import date
from statistics import stdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import StudyDesign
from tideline.functions.labels import star_to_label
from tideline.operators import aggregates, compare, joins, quantiles, sampling, skew
from tideline.operators.skew import number_rows, top_per_group

DESIGN = StudyDesign.two_years("t", "c", 2026, 2025)
SCHEMA = "review_id long, city string, temporal_window string, sentiment_score double, sentiment_label string, rating double, topic int, emotion_label string"


def rows(spark, cells):
    """cells: (city, window, count, score, label)."""
    out, i = [], 0
    for city, window, n, score, label in cells:
        for _ in range(n):
            out.append((i, city, window, score, label, 8.0, i % 3, "joy"))
            i += 1
    return spark.createDataFrame(out, SCHEMA)


def as_map(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_volumetric_golden(spark):
    df = rows(spark, [
        ("t", "pre", 5090, 1.0, "positive"), ("t", "baseline_pre", 4256, 1.0, "positive"),
        ("t", "during", 333, 1.0, "positive"), ("t", "baseline_during", 184, 1.0, "positive"),
        ("t", "post", 942, 1.0, "positive"), ("t", "baseline_post", 1452, 1.0, "positive"),
        ("c", "during", 86, 1.0, "positive"), ("c", "outside", 5, 1.0, "positive"), (None, "pre", 3, 1.0, "positive"),
    ])
    got = as_map(compare.volumetric(df, DESIGN), "city", "window_event")
    assert [got["t", w]["pct_change"] for w in ("pre", "during", "post")] == [19.6, 80.98, -35.12]
    assert got["c", "during"]["reviews_event"] == 86 and got["c", "during"]["pct_change"] is None
    assert len(got) == 6


def test_change_with_missing_sides(spark):
    df = rows(spark, [
        ("t", "pre", 3, 0.5, "positive"), ("t", "baseline_during", 2, 0.5, "positive"),
        ("t", "baseline_post", 2, -0.5, "negative"), ("t", "post", 4, 0.25, "positive"),
    ])
    got = as_map(compare.sentiment_change(df, DESIGN), "window")
    assert got["pre",]["pct_change_mean_sentiment"] is None
    assert got["during",]["pct_change_mean_sentiment"] == -100.0
    assert got["post",]["pct_change_mean_sentiment"] == 150.0
    assert got["pre",]["review_count_baseline"] is None
    strict = as_map(compare.sentiment_change(df, DESIGN, missing_as_zero=False), "window")
    assert strict["during",]["pct_change_mean_sentiment"] is None


def test_weighted_means_golden(spark):
    for (n, a), (m, b), want in [((333, .563), (86, .895), .631), ((5090, .702), (2048, .683), .697), ((942, .736), (1028, .477), .601)]:
        df = rows(spark, [("t", "pre", n, a, "positive"), ("c", "pre", m, b, "positive")])
        mean = aggregates.sentiment_by(df, "temporal_window").first()
        assert round(mean["mean_sentiment"], 3) == want and mean["review_count"] == n + m


def test_target_vs_control(spark):
    df = rows(spark, [("t", "pre", 3, 1.0, "positive"), ("t", "pre", 1, -1.0, "negative"), ("c", "pre", 2, 0.5, "positive"),
                      ("c", "pre", 2, 0.0, "neutral"), ("t", "post", 2, 0.5, "positive"), ("x", "pre", 9, 1.0, "positive")])
    got = as_map(compare.target_vs_control(df, DESIGN), "temporal_window", "city")
    assert set(got) == {("pre", "t"), ("pre", "c"), ("post", "t")}
    assert got["pre", "t"]["diff_mean_sentiment"] == 0.25 == got["pre", "c"]["diff_mean_sentiment"]
    assert got["pre", "t"]["diff_pct_positive"] == 50.0 and got["pre", "t"]["diff_pct_negative"] is None
    assert got["post", "t"]["diff_mean_sentiment"] is None


def test_cells_equal_rows(spark):
    df = rows(spark, [("t", "pre", 7, 0.5, "positive"), ("t", "baseline_pre", 5, -0.5, "negative"), ("c", "pre", 3, 0.0, "neutral"),
                      ("t", "unknown", 2, 1.0, "positive")]).withColumn(
        "topic", F.when(F.col("review_id") % 4 != 0, F.col("topic")))
    cells = compare.compact(df, "topic")
    for f in (compare.volumetric, compare.sentiment_change, compare.target_vs_control):
        assert sorted(map(str, f(df, DESIGN).collect())) == sorted(map(str, f(cells, DESIGN).collect()))
    for f in (compare.category_share_by_window, compare.category_share_by_group):
        assert sorted(map(str, f(df, DESIGN, "topic").collect())) == sorted(map(str, f(cells, DESIGN, "topic").collect()))


def test_shares_sum_to_100(spark):
    df = rows(spark, [("t", "pre", 50, 0.5, "positive"), ("t", "baseline_pre", 31, 0.5, "positive")])
    shares = compare.category_share_by_window(df, DESIGN, "topic")
    for r in shares.groupBy("window", "year").agg(F.sum("pct").alias("s")).collect():
        assert r["s"] == pytest.approx(100, abs=0.05)


def test_emotion_by_group_option(spark):
    df = rows(spark, [("t", "pre", 2, 0.5, "positive"), ("c", "pre", 3, 0.5, "positive")])
    both = as_map(compare.sentiment_change(df, DESIGN, emotion="emotion_label"), "city", "window")
    apart = as_map(compare.sentiment_change(df, DESIGN, emotion="emotion_label", emotions_by_group=True), "city", "window")
    assert both["t", "pre"]["emotion_joy"] == 5 and apart["t", "pre"]["emotion_joy"] == 2


def test_too_many_labels(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("l"))
    with pytest.raises(ValueError):
        aggregates.label_values(df, "l", 10)


@pytest.mark.parametrize("make", [
    lambda rng: rng.normal(size=5000), lambda rng: rng.integers(1, 11, 5000).astype(float),
    lambda rng: np.concatenate([np.full(4000, 7.0), rng.pareto(1.0, 1000)]), lambda rng: np.array([3.0]),
    lambda rng: np.array([1.0, 2.0]), lambda rng: rng.normal(size=7),
])
@pytest.mark.parametrize("accuracy", [50, 100_000])
def test_exact_quantiles(spark, make, accuracy):
    data = make(np.random.default_rng(3))
    df = spark.createDataFrame([("g", float(v)) for v in data] + [("g", None)], "g string, v double").repartition(3)
    got = quantiles.exact_quantiles(df, ["g"], "v", {"a": .25, "b": .5, "c": .75, "d": .99}, accuracy).first()
    assert got["n"] == len(data)
    want = np.percentile(data, [25, 50, 75, 99])
    assert np.allclose([got[c] for c in "abcd"], want, rtol=1e-12, atol=1e-12)


def test_box_stats(spark):
    values = [1.0, 2.0, 2.5, 3.0, 4.0, 100.0, -80.0]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = quantiles.box_stats(df, ["g"], "v").first()
    q1, med, q3 = np.percentile(values, [25, 50, 75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    kept = [v for v in values if low <= v <= high]
    assert (got["q1"], got["median"], got["q3"]) == (q1, med, q3)
    assert (got["whisker_low"], got["whisker_high"], got["n_outliers"]) == (min(kept), max(kept), 2)
    assert sorted(r["v"] for r in quantiles.box_outliers(df, ["g"], "v").collect()) == [-80.0, 100.0]


def test_natural_key_join(spark):
    left = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "x"), (4, "c", "y")], "review_id long, p string, q string")
    right = spark.createDataFrame([(1, "a", None, 10), (2, "a", None, 20), (3, "b", "x", 30), (9, "b", "z", 40)],
                                  "review_id long, p string, q string, topic int")
    got = joins.natural_key_join(left, right, ["p", "q"], "review_id", fanout=True)
    assert {r.review_id: (r.topic, r.n_matches) for r in got.collect()} == {1: (10, 2), 2: (10, 2), 3: (30, 1), 4: (None, 1)}
    plain = left.join(right, left.p.eqNullSafe(right.p) & left.q.eqNullSafe(right.q), "left").count()
    assert got.agg(F.sum("n_matches")).first()[0] == plain


def test_fanout_weights_reproduce_joined_figures(spark):
    ratings = [(1, 3, 8.0), (2, 1, 6.0), (3, 2, 9.5), (4, 2, None)]
    df = spark.createDataFrame([(i, "t", "pre", r, 0.5, m) for i, m, r in ratings],
                               "review_id long, city string, temporal_window string, rating double, sentiment_score double, n_matches long")
    got = aggregates.temporal_summary(df, DESIGN, weight="n_matches").first()
    flat = [r for _, m, r in ratings if r is not None for _ in range(m)]
    assert got["n"] == len(flat)
    assert got["rating_mean"] == round(sum(flat) / len(flat), 3) and got["rating_std"] == round(stdev(flat), 3)


def test_windows_partition_rows_and_join_agrees(spark):
    df = spark.range(800).select("id", F.date_add(F.lit(date(2025, 1, 1)), F.col("id").cast("int")).alias("d"))
    df = df.unionByName(spark.createDataFrame([(900, None)], "id long, d date"))
    joined = joins.window_range_join(df, "d", DESIGN).withColumn("w", DESIGN.assign("d"))
    assert joined.count() == 801 and joined.where(F.col("w") != F.col("window_label")).count() == 0
    assert joins.semi_windows(df, "d", DESIGN).count() == DESIGN.day_count()


def test_until_first_below(spark):
    listed = [("a", 1, date(2026, 5, 3)), ("a", 2, None), ("a", 3, date(2026, 4, 1)), ("a", 4, date(2026, 5, 2)),
              ("b", 1, None), ("b", 2, date(2026, 5, 9)), ("c", 1, date(2026, 1, 1))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(listed)], "id long, p string, pos int, d date")
    got = joins.until_first_below(df, "p", "pos", "d", date(2026, 5, 1))
    assert sorted((r.p, r.pos) for r in got.collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_top_per_group_cuts_before_the_shuffle(spark):
    df = spark.range(1000).select("id", (F.col("id") % 2).alias("g"))
    top = top_per_group(df, ["g"], [F.desc("id")], 3)
    assert sorted(r.id for r in top.collect()) == [994, 995, 996, 997, 998, 999]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_top_per_group_beyond_the_limit(spark, monkeypatch):
    monkeypatch.setattr(skew, "GROUP_LIMIT", 5)
    df = spark.range(1000).select("id", (F.col("id") % 2).alias("g"))
    top = top_per_group(df, ["g"], [F.desc("id")], 10)
    assert sorted(r.id for r in top.collect()) == list(range(980, 1000))
    assert {r["rank"] for r in top.collect()} == set(range(1, 11)) and top.columns == ["id", "g", "rank"]


def test_number_rows(spark):
    df = spark.range(500).withColumn("h", F.md5(F.col("id").cast("string")))
    numbered = number_rows(df, "h", "n")
    got = {r.h: r.n for r in numbered.collect()}
    assert [got[h] for h in sorted(got)] == list(range(1, 501)) and dict(numbered.dtypes)["n"] == "bigint"


def test_samples(spark):
    key = F.col("id").alias("key")
    df = spark.range(200).select(key, F.when(F.col("id") < 150, "a").when(F.col("id") < 155, "b").otherwise("c").alias("w"))
    got = sampling.stratified_sample(df, "w", "key", n=10).collect()
    assert sorted(r["id"] for r in got) == list(range(1, 26))
    assert [sum(r["w"] == w for r in got) for w in "abc"] == [10, 5, 10]
    again = sampling.stratified_sample(df.repartition(7), "w", "key", n=10).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sampling.random_sample(df, "key", 500).count() == 200
    assert [r.key for r in sampling.head_sample(df, "key", 3).collect()] == [0, 1, 2]


def test_sample_stats(spark):
    df = spark.createDataFrame([("a", "molto bello davvero", "it"), ("a", "corto", "it"), ("a", " ", "it"), ("a", None, None),
                                ("b", "a very nice place", "en")], "w string, t string, l string")
    got = as_map(sampling.sample_stats(df, "w", "t", "l"), "w")
    assert (got["a",]["n_raw"], got["a",]["n_eligible"], got["a",]["n_sampled"]) == (2, 1, 1)
    assert (got["b",]["n_raw"], got["b",]["n_eligible"]) == (1, 0)


def test_star_column_feeds_scores(spark):
    df = spark.createDataFrame([("1 star",), ("5 stars",)], "s string")
    assert [r[0] for r in df.select(star_to_label("s")).collect()] == ["negative", "positive"]

"""Every registered query against its SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as entry_point
import check
from tideline.plans import catalog, oracle

SQL = oracle.oracle_sql()
ROWS_ONLY = {"lda_topics", "lda_top_words", "lda_grid", "embedding_topics", "subset_topics", "density_topics",
             "merged_topics", "topic_map", "sentence_vectors", "sentence_topics", "both_models"}
# Fits of models, covered by their own tests.
PLANNED = sorted(set(SQL))


@pytest.fixture(scope="module")
def db(data):
    return check.connect(data)


def test_every_query_has_sql_or_a_reason():
    assert set(catalog.QUERIES) - set(SQL) == ROWS_ONLY
    assert set(SQL) <= set(catalog.QUERIES) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, data, name):
    state = check.compare(spark, db, data, name, catalog.QUERIES[name], SQL.get(name))
    assert state.startswith(("ok", "rows only")), state


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["city", "window_event", "window_baseline", "reviews_event", "reviews_baseline", "pct_change"]
    assert df.count() == 15


@pytest.mark.parametrize("name", PLANNED)
def test_no_pairing_join_and_no_row_python(spark, data, name):
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in plan


def test_scans_read_only_needed_columns(spark, data):
    plan = catalog.QUERIES["volumetric"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey" not in plan
    assert "o_totalprice" not in plan and "o_orderpriority" in plan


# Queries whose feature is a fit or a written table; all others must only plan.
ACTING = ROWS_ONLY | {"roundtrip_stage", "stream_ingest", "read_reviews_headers", "append_report", "tag_by_file",
                      "resumable_ingest", "key_findings"}


def test_building_a_query_only_reads_schemas(spark, data, monkeypatch):
    from pyspark.sql import DataFrameReader

    reads, parquet = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *a, **k: reads.append(a) or parquet(self, *a, **k))
    more = {}
    for name in sorted(set(catalog.QUERIES) - ACTING):
        reads.clear()
        spark.sparkContext.setJobGroup(f"build {name}", name)
        catalog.QUERIES[name](spark, data)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"build {name}"))
        if jobs > len(reads):
            more[name] = jobs
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert more == {}


def test_findings_read_the_table_once(spark, data):
    plan = catalog.QUERIES["key_findings"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" not in plan and "findings" in plan


def test_a_short_lexicon_is_the_broadcast_side(spark, data):
    frame = catalog.QUERIES["lexicon_sentiment_table"](spark, data)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    hash_join = next(line for line in plan.splitlines() if "BroadcastHashJoin" in line and "word" in line)
    assert "BuildRight" in hash_join

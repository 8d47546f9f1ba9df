from collections import Counter, defaultdict

import pytest

from tideline.llm import mixing


@pytest.mark.parametrize("parts", [[1], [1, 1, 1], [900, 1, 1, 98], [5, 3, 2], [7, 7, 1, 13, 90], list(range(1, 40))])
def test_every_deadline_is_met_and_lag_stays_below_one_block(parts):
    total = sum(parts)
    done = Counter()
    for t, (s, i, slot, release, deadline) in enumerate(mixing.pfair_period(dict(enumerate(parts)))):
        assert slot == t and release <= t < deadline
        done[s] += 1
        assert all(abs(parts[x] * (t + 1) / total - done[x]) < 1 for x in range(len(parts)))
    assert done == Counter({s: n for s, n in enumerate(parts)})


def test_whole_schedule(spark):
    sizes = {"a": 700, "b": 200, "c": 31, None: 5}
    rows = [(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, source string")
    got = mixing.mix_sources(docs, {"a": 5, "b": 3, "c": 2, "absent": 9}, block_rows=4).collect()
    assert sorted((r.doc_id, r.source or "") for r in got) == sorted((i, s or "") for i, s in rows)
    blocks = {}
    for r in got:
        assert r.release <= r.slot < r.deadline
        assert blocks.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    filled = defaultdict(list)
    for slot in sorted(blocks):
        filled[blocks[slot][0]].append(blocks[slot][1])
    assert all(b == list(range(-(-sizes[s] // 4))) for s, b in filled.items())
    first = [blocks[t][0] for t in sorted(blocks) if t < 11]  # parts 5, 3, 2 and 1
    assert Counter(first) == {"a": 5, "b": 3, "c": 2, None: 1}
    for s, share in (("a", 5), ("b", 3), ("c", 2)):
        for t in range(1, 12):
            assert abs(share * t / 11 - sum(blocks[u][0] == s for u in range(t))) < 1


def test_cells_do_not_change_the_order(spark, monkeypatch):
    docs = spark.range(1000).selectExpr("id AS doc_id", "IF(id < 900, 'hot', 'b') AS source")
    keep = lambda: sorted(map(tuple, mixing.mix_sources(docs, {"hot": 2, "b": 1}).collect()))
    one = keep()
    monkeypatch.setattr(mixing, "CELL_ROWS", 16)
    assert [(r[0], r[1], r[3] // 1) for r in keep()] != [] and Counter(r[5] for r in keep()) == Counter(r[5] for r in one)


def test_repeated_rows_nulls_clashing_columns_and_empty_table(spark):
    kind = "doc_id long, source string, slot string, text string"
    rows = [(1, "a", "x", None), (1, "a", "x", None), (None, None, None, ""), (2, "b", "x", "t")]
    got = mixing.mix_sources(spark.createDataFrame(rows, kind)).collect()
    assert sorted((str(r.doc_id), str(r.source)) for r in got) == [("1", "a"), ("1", "a"), ("2", "b"), ("None", "None")]
    assert mixing.mix_sources(spark.createDataFrame([], kind)).collect() == []
    ordered = mixing.in_mixed_order(spark.createDataFrame(rows, kind))
    assert ordered.columns == ["doc_id", "source", "slot", "text"] and ordered.count() == 4


def test_plan_has_no_python(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_three_hundred_sources(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', CONCAT('s', id % 299)) AS source")
    got = mixing.mix_sources(docs).collect()
    assert len({r.source for r in got}) == 300 and len({r.doc_id for r in got}) == len(got) == 3000
    many = spark.range(1200).selectExpr("id AS doc_id", "CONCAT('s', id % 300) AS source")
    got = mixing.mix_sources(many, block_rows=1).collect()
    assert all(r.release <= r.slot < r.deadline for r in got) and len({r.slot for r in got}) == 1200


def test_small_tables_are_interleaved(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    rows = sorted(mixing.mix_sources(docs).collect(), key=lambda r: (r.slot, r.block_row))
    sources = [r.source for r in rows]
    half = sources[:len(sources) // 2]
    assert len(set(sources)) == 20 and set(half) == set(sources)
    runs = sum(a != b for a, b in zip(sources, sources[1:])) + 1
    assert runs > len(rows) / mixing.BLOCK_ROWS / 4


def test_rows_without_ids_are_spread_and_repeat(spark):
    docs = spark.range(2000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'hot' AS source", "CONCAT('text ', id) AS text")
    one, two = (sorted(map(str, mixing.mix_sources(docs.repartition(n)).collect())) for n in (3, 5))
    assert one == two


def test_joined_plan_equals_broadcast_plan(spark, monkeypatch):
    docs = spark.range(500).selectExpr("id AS doc_id", "CONCAT('s', id % 7) AS source")
    one = sorted(map(str, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "SMALL_PLAN", 0)
    assert sorted(map(str, mixing.mix_sources(docs).collect())) == one

import zlib

import numpy as np

from tideline.llm import queries, sharding


def test_matrix_has_the_margins_and_is_uniform():
    held, sizes = np.array([5, 0, 9, 6]), np.array([7, 7, 6])
    drawn = [sharding.communication_matrix(held, sizes, seed) for seed in range(2000)]
    assert all((m.sum(1) == held).all() and (m.sum(0) == sizes).all() for m in drawn)
    assert abs(np.mean(drawn, 0) - np.outer(held, sizes) / 20).max() < .1


def test_sizes_slots_and_order(spark):
    docs = spark.range(1003).selectExpr("id AS doc_id", "if(id % 3 = 0, NULL, 'same') AS text", "id AS slot").repartition(5)
    rows = sharding.sharded(docs, 4, seed=3).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1003))
    slots = [sorted(r.slot for r in rows if r.shard == s) for s in range(4)]
    assert slots == [list(range(n)) for n in (251, 251, 251, 250)]
    again = {r.doc_id: (r.shard, r.slot) for r in rows}
    early = [i for i, (s, slot) in again.items() if slot < 60]
    assert 350 < np.mean(early) < 650


def test_cells_keep_slots_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    rows = sharding.sharded(spark.range(500).withColumnRenamed("id", "doc_id"), 3).collect()
    assert [sorted(r.slot for r in rows if r.shard == s) for s in range(3)] == [list(range(n)) for n in (167, 167, 166)]


def test_same_seed_same_shards_and_written_folders(spark, data, tmp_path):
    one, two = (queries.QUERIES["op3_sharding"](spark, data).collect() for _ in range(2))
    assert sorted(one) == sorted(two)
    texts = {r.doc_id: (r.text or "").encode() for r in queries.documents(spark, data).collect()}
    for r in one:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        assert (r.law, r.grown_shard) == ("rows", None)
    out = str(tmp_path / "shards")
    sharding.write_shards(sharding.sharded(queries.documents(spark, data), 16), out)
    back = spark.read.parquet(out)
    assert back.count() == 200 and back.select("shard").distinct().count() == 16


def test_empty_table(spark):
    assert sharding.sharded(spark.range(0), 4).collect() == []

import hashlib
import random

import numpy as np
import pyarrow as pa

from tideline.llm import fingerprints as fp

KIND = "doc_id long, text string, hi int, part string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "p") for i, t in rows], KIND)


def test_rows_against_plain_python(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in fp.fingerprint_table(table.repartition(7)).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in table.collect())
    assert len(got) == len(rows)
    near = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        e = t[:len(t) - half] + n[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b, c = (fp.fingerprints(pa.array([x])) for x in (t, e, n))
        assert got[i].near_edited == 1 - sum(int(x).bit_count() for x in (a ^ b)[0]) / 128
        assert got[i].near_next == 1 - sum(int(x).bit_count() for x in (a ^ c)[0]) / 128
        near.append((got[i].near_edited, got[i].near_next))
    near = np.array(near)
    assert near[:, 0].mean() > near[:, 1].mean() + .1


def test_radius_pairs_against_all_pairs(spark):
    r = random.Random(5)
    base = [r.getrandbits(128) for _ in range(20)]
    prints = list({b ^ sum(1 << r.randrange(128) for _ in range(r.randrange(5))) & (2**128 - 1) for b in base for _ in range(15)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, signed(p >> 64), signed(p & (2**64 - 1))) for i, p in enumerate(prints)]
    table = spark.createDataFrame(rows, "id long, hi long, lo long")
    for radius, block in ((3, 1024), (3, 4), (5, 1024)):
        got = {tuple(x) for x in fp.radius_pairs(table, radius, block).collect()}
        assert got == {(i, j, (p ^ q).bit_count()) for i, p in enumerate(prints) for j, q in enumerate(prints)
                       if i < j and (p ^ q).bit_count() <= radius}
        assert got


def test_small_tables_nulls_and_copies(spark):
    rows = [(None, None), (3, "a b c d"), (3, "a b c d"), (2, "a b c d"), (9, ""), (5, "x")]
    got = fp.with_classes(fp.fingerprint_table(docs(spark, rows))).collect()
    assert len(got) == 6
    by = {(r.doc_id, r.class_id) for r in got}
    assert by == {(None, 9), (3, 2), (2, 2), (9, 9), (5, 5)}
    assert all(r.near_edited == 1.0 for r in got if r.n_chars == 0)
    one = fp.fingerprint_table(docs(spark, [(1, "ab")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"aa").hexdigest() and one[0].near_next == 1.0
    assert fp.with_classes(fp.fingerprint_table(docs(spark, []))).collect() == []

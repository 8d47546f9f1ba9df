import numpy as np

from tideline.llm import neighbours as nn

KIND = "vec_id long, embedding array<float>, node string, label int"


def exact(rows, k, every):
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v
              and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in usable:
        if q % every == 0:
            near = sorted((-(float((usable[q] * v).sum())), i) for i, v in usable.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(8) * rng.random())]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)]
    rows += [(200, None), (None, rows[1][1]), (220, [0.0] * 8), (240, [float("nan")] + [1.0] * 7), (260, [None] + [1.0] * 7),
             (280, [float("inf")] + [1.0] * 7)]
    docs = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], KIND)
    got, want = answers(nn.nearest(docs)), exact(rows, 20, 20)
    assert {q: [i for i, _ in a] for q, a in got.items()} == {q: [i for i, _ in a] for q, a in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q]))
    few = answers(nn.nearest(docs.where("vec_id < 5")))
    assert [i for i, _ in few[0]] == [i for i, _ in exact(rows[:5], 20, 20)[0]] and len(few[0]) == 4
    assert nn.nearest(docs.limit(0)).collect() == []


def test_recall_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    got, want = answers(nn.nearest(table)), exact(rows, 20, 20)
    assert got.keys() == want.keys() and all(len(a) == 20 for a in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= .9


def test_nearness_keeps_its_digits_with_one_long_vector(spark):
    x = np.random.default_rng(3).standard_normal((50, 16)).astype(np.float32)
    x[0] *= 1e4
    nodes = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "node long, v array<double>")
    kept = nn._packed(nodes, 2.0 ** 16).orderBy("node").toArrow()
    got = nn._closeness(nn._points(kept.column("q")), float(np.linalg.norm(x[0].astype(float))) / 2.0 ** 16)[1:, 1:]
    far = ((x[1:, None].astype(float) - x[None, 1:]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    assert (got.argsort(axis=1)[:, ::-1] == far.argsort(axis=1)).all()


def recall(spark, rows):
    got, want = answers(nn.nearest(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], KIND))), exact(rows, 20, 20)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    print("recall", hits / (20 * len(want)))
    return hits / (20 * len(want))


def test_recall_with_one_long_vector(spark, monkeypatch):
    monkeypatch.setattr(nn, "ENTRIES", 32)  # a small part of the table
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, [x * (1000 if r.vec_id == 7 else 1) for x in r.embedding]) for r in table.collect()]
    assert recall(spark, rows) >= .9


def test_recall_in_one_dense_cluster(spark, monkeypatch):
    monkeypatch.setattr(nn, "ENTRIES", 32)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    rows = [(i, [float(x) for x in np.float32(centre + .1 * rng.standard_normal(64))]) for i in range(3000)]
    assert recall(spark, rows) >= .9

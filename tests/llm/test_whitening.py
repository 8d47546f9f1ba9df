import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import queries, whitening

KIND = "vec_id long, embedding array<float>, component string, n int, x string"


def spectrum(seed, values, rows=100):
    rng = np.random.default_rng(seed)
    d = len(values)
    return np.linalg.qr(rng.normal(size=(rows, d)))[0] @ np.diag(values) @ np.linalg.qr(rng.normal(size=(d, d)))[0]


CASES = {
    "plain": np.random.default_rng(1).normal(size=(500, 64)),
    "graded": np.random.default_rng(2).normal(size=(300, 40)) * np.exp(-np.arange(40)),
    "graded the other way": np.random.default_rng(2).normal(size=(300, 40)) * np.exp(np.arange(40) - 40),
    "few rows": np.random.default_rng(3).normal(size=(5, 32)),
    "one row": np.random.default_rng(3).normal(size=(1, 32)),
    "one value": spectrum(4, np.ones(20)),
    "three values": spectrum(5, np.repeat([5.0, 3.0, 1.0], [10, 30, 24])),
    "nearly three values": spectrum(6, np.repeat([5.0, 3.0, 1.0], [10, 30, 24]) + 1e-12 * np.arange(64)),
    "diagonal": np.diag(np.arange(1.0, 31.0)),
    "equal columns": np.repeat(np.random.default_rng(7).normal(size=(60, 10)), 2, axis=1),
    "one dimension": np.random.default_rng(8).normal(size=(9, 1)),
    "constant": np.ones((30, 8)),
    "zero": np.zeros((30, 8)),
}


@pytest.mark.parametrize("name", CASES)
def test_solver_against_numpy(name):
    rows = CASES[name]
    values, vectors = whitening.principal(whitening.triangle(rows), rows.shape[1])
    known = np.zeros(rows.shape[1])
    exact = np.linalg.svd(rows, compute_uv=False) ** 2
    known[:len(exact)] = exact
    top = max(known.max(), 1e-300)
    assert np.abs(values - known).max() <= 1e-13 * top
    alive = np.sqrt(values) > 1e-13 * math.sqrt(top)
    v = vectors[:, alive]
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max(initial=0) < 1e-11
    assert np.abs(rows.T @ (rows @ v) - v * values[alive]).max(initial=0) <= 1e-12 * top


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=30), st.integers(0, 3))
def test_small_values_keep_their_digits(exponents, seed):
    """A graded bidiagonal matrix determines its smallest singular value to high relative accuracy."""
    d = np.array([10.0 ** e for e in sorted(exponents, reverse=True)])
    got = whitening.dqds(d, np.zeros(len(d) - 1))
    assert np.allclose(got, np.sort(d ** 2)[::-1], rtol=1e-13)
    u = np.random.default_rng(seed).uniform(0.1, 1, len(d) - 1) * d[1:]
    product = float(np.sum(2 * np.log(d)))
    assert math.isclose(float(np.sum(np.log(whitening.dqds(d, u)))), product, rel_tol=1e-12, abs_tol=1e-10)


def brute(rows, components=16):
    """(vec_id, component, n, deviation, |whitened|, explained) with numpy's eigh over exact whole numbers."""
    good = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    total = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, total)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, x in good:
        t = [n * a - s for a, s in zip(x, total)]
        z = np.array(t) / n @ v / np.sqrt(np.maximum(e, 1e-300))
        for k in range(min(components, d)):
            out.setdefault((i, k + 1), []).append((n, sum(a * a for a in t), z[k], e[k] / e.sum()))
    return out


def compare(got, want):
    assert sum(map(len, want.values())) == len(got)
    for c in {r.component for r in got}:
        ours = np.array([r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == c])
        theirs = np.array([want[r.vec_id, c][0][2] for r in sorted(got, key=lambda r: r.vec_id) if r.component == c])
        sign = np.sign(ours @ theirs)
        assert np.abs(ours - sign * theirs).max() < 1e-8
    for r in got:
        n, deviation, _, share = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation) and math.isclose(r.explained, share, rel_tol=1e-9)
        assert r.identity_error < 1e-10


def test_query_against_brute_force(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    compare(queries.op13_embedding_whitening(spark, data).collect(), brute(rows))


def test_repeated_vectors_bad_entries_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(60, 5)) * [5, 4, 3, 2, 1]).round(3).tolist()
    rows = [(i, v, "c", i, "x") for i, v in enumerate(base)] + [(100 + i, base[0], "c", i, None) for i in range(90)]
    rows += [(500, None, None, None, None), (501, [1.0, None, 2.0, 3.0, 4.0], "", 1, ""), (502, [float("nan")] * 5, "", 1, ""),
             (503, [float("inf"), 0.0, 0.0, 0.0, 0.0], "", 1, ""), (504, [1.0, 2.0], "", 1, ""), (505, [], "", 1, "")]
    df = spark.createDataFrame(rows, KIND)
    got = whitening.whiten(df.repartition(7)).collect()
    plain = [(i, [float(np.float32(c)) for c in v]) for i, v, *_ in rows if i < 500]
    compare(got, brute(plain))
    assert whitening.whiten(df, components=2).count() == 300


def test_constant_vectors_null_ids_and_empty_tables(spark):
    rows = [(None, [1.0, 2.0], "", 1, ""), (None, [1.0, 2.0], "", 1, ""), (3, [1.0, 2.0], "", 1, "")]
    got = whitening.whiten(spark.createDataFrame(rows, KIND)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(got, key=lambda r: r.component)] == [
        *[(1, 1, 0, None, None, None)] * 3, *[(2, 1, 0, None, None, None)] * 3]
    line = [(i, [float(i), float(2 * i)], "", 1, "") for i in range(50)]
    flat = whitening.whiten(spark.createDataFrame(line, KIND)).collect()
    assert {r.component for r in flat if r.whitened is None} == {2} and all(r.identity_error < 1e-10 for r in flat)
    for some in ([], [(1, None, "", 1, "")], [(1, [], "", 1, "")]):
        empty = whitening.whiten(spark.createDataFrame(some, KIND))
        assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "component", "n"]


def test_deviations_beyond_long_are_null_and_large_ones_exact(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 0.0]), (3, [5e5, 1.0]), (4, [1e20, 1.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert set(got) == {1, 2, 3} and got[1] is None
    some = [(1, [3e6, 0.0]), (2, [0.0, 1.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(some, "vec_id long, embedding array<double>")).collect()}
    assert got[1] == (192_000_000 ** 2 + 64 ** 2)

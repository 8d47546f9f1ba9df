import numpy as np
import pytest

from tideline.operators import vectors


def plain_matrix(texts, reach, least):
    counts = {}
    for t in texts:
        for w in t or []:
            counts[w] = counts.get(w, 0) + 1
    names = sorted(w for w, n in counts.items() if n >= least)
    at = {w: i for i, w in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for t in texts:
        for i, a in enumerate(t or []):
            for b in (t or [])[i + 1:i + 1 + reach]:
                if a in at and b in at:
                    m[at[a], at[b]] += 1
                    m[at[b], at[a]] += 1
    r = m.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.log(m * r.sum() / np.outer(r, r))
    return names, np.where(m > 0, np.maximum(value, 0), 0)


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(2)
    themes = [[f"{t}{i}" for i in range(9)] for t in "abc"]
    rows = [(i, [str(w) for w in rng.choice(themes[i % 3] + ["the"], 30)]) for i in range(45)] + [(100, []), (101, None), (102, ["once"])]
    return spark.createDataFrame(rows, "review_id long, words array<string>")


def test_matrix_and_values_equal_numpy(spark, docs):
    names, want = plain_matrix([r.words for r in docs.collect()], 4, 2)
    vocabulary, matrix = vectors.cooccurrence(docs, "words")
    word = {r.id: r.word for r in vocabulary.collect()}
    got = np.zeros_like(want)
    for r in matrix.collect():
        got[names.index(word[r.a]), names.index(word[r.b])] = r.v
    assert np.allclose(got, want, atol=1e-12)
    found, values = vectors.leading_directions(matrix, 5, rounds=6)
    exact = np.linalg.svd(want, compute_uv=False)
    assert np.allclose(np.abs(values[:3]), exact[:3], rtol=1e-10) and np.allclose(np.abs(values), exact[:5], rtol=3e-3)
    q = {word[r.id]: r.q for r in found.collect()}
    basis = np.array([q[w] for w in names if w in q])
    assert np.allclose(basis.T @ basis, np.eye(5), atol=1e-9)


def test_sentences_of_a_theme_are_near(spark, docs):
    got = {r.review_id: r.embedding for r in vectors.sentence_vectors(docs, "words", size=4).collect()}
    assert got[100] is got[101] is got[102] is None and len(got) == 48
    v = np.array([got[i] for i in range(45)])
    same = np.equal.outer(np.arange(45) % 3, np.arange(45) % 3)
    near = v @ v.T
    assert np.allclose(np.diag(near), 1) and near[same].mean() > near[~same].mean() + .3


def test_iterations_shuffle_nothing(spark, docs, monkeypatch):
    matrix = vectors.cooccurrence(docs, "words")[1]
    plans = []
    for name in ("written", "_parted"):
        def spy(df, *rest, plain=getattr(vectors, name, None), **more):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return plain(df, *rest, **more)
        monkeypatch.setattr(vectors, name, spy, raising=False)
    vectors.leading_directions(matrix, 3, rounds=1)
    assert len(plans) > 4 and not any("Exchange" in p for p in plans)


def test_matrix_of_many_bands_and_strips(spark):
    """140,000 words in a ring, each text twice: a word is near its four neighbours either way."""
    n, size = 140_000, 100
    texts = spark.range(2 * n // size).selectExpr(f"transform(sequence(0, {size - 1}), x -> concat('w', (id * {size} + x) % {n})) AS words")
    vocabulary, matrix = vectors.cooccurrence(texts, "words")
    assert vocabulary.count() == n
    pairs = matrix.toPandas()
    word = vocabulary.toPandas().set_index("id").word.str[1:].astype(int)
    a, b = word[pairs.a].to_numpy(), word[pairs.b].to_numpy()
    assert len(pairs) == n // size * (size * 8 - 20) and (a // size == b // size).all() and set(np.abs(a - b)) == {1, 2, 3, 4}
    ends = lambda x: np.minimum(x % size, 4) + np.minimum(size - 1 - x % size, 4)
    assert np.allclose(pairs.v, np.log(2 * 2 * len(pairs) / (2 * ends(a) * 2 * ends(b))), atol=1e-12)


def test_repeated_and_missing_keys_share_a_vector(spark):
    rows = [(1, ["a", "b", "a", "b"]), (1, ["c", "d", "c", "d"]), (None, ["a", "b"]), (2, ["a", "b"]), (3, ["z"])]
    got = vectors.sentence_vectors(spark.createDataFrame(rows, "review_id long, words array<string>"), "words", size=2).collect()
    by = {}
    for r in got:
        by.setdefault(r.review_id, []).append(r.embedding)
    assert len(got) == 5 and by[1][0] == by[1][1] is not None and by[None] == [None] and by[3] == [None]
    assert np.isclose(np.linalg.norm(by[2][0]), 1)


def test_no_texts(spark):
    for rows in ([], [(1, []), (2, None)]):
        got = vectors.sentence_vectors(spark.createDataFrame(rows, "review_id long, words array<string>"), "words", size=2).collect()
        assert [r.embedding for r in got] == [None] * len(rows)

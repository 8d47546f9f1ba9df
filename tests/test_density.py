"""Density topics against a plain version, in one task and by rounds and bands."""

import numpy as np
import pytest

from tideline.operators import density
from tideline.plans.catalog import QUERIES


def plain(vectors, min_cluster, min_samples, neighbours):
    """Topic groups (sets of indices) and probabilities, top down on the whole tree."""
    v = np.array(sorted(set(map(tuple, vectors))))
    n = len(v)
    gap = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    order = [sorted((j for j in range(n) if j != i), key=lambda j: (gap[i, j], j))[:max(neighbours, min_samples)] for i in range(n)]
    core = [max(gap[i, j] for j in order[i][:min_samples]) for i in range(n)]
    graph = sorted({(max(gap[i, j], core[i], core[j]), min(i, j), max(i, j)) for i in range(n) for j in order[i]})

    def parts(members, edges):
        """Connected sets of members under edges."""
        home = {m: m for m in members}

        def find(x):
            while home[x] != x:
                x = home[x]
            return x

        tree = []
        for w, i, j in edges:
            if find(i) != find(j):
                home[find(i)] = find(j)
                tree.append((w, i, j))
        groups = {}
        for m in members:
            groups.setdefault(find(m), []).append(m)
        return list(groups.values()), tree

    roots, forest = parts(range(n), graph)

    def condense(members, edges, birth):
        """(stability, points with lambda, children) of one cluster."""
        total, leaves, children, top = 0.0, {}, [], None
        while True:
            if not edges:
                return total, leaves, children, top or np.inf
            w, i, j = edges[-1]
            edges = edges[:-1]
            split, _ = parts(members, edges)
            lam = 1 / w
            big = [p for p in split if len(p) >= min_cluster]
            top = lam
            if len(big) == 2:
                total += len(members) * (lam - birth)
                for p in big:
                    children.append(condense(p, [e for e in edges if e[1] in p], lam))
                return total, leaves, children, top
            if not big:
                leaves |= {m: lam for m in members}
                return total + len(members) * (lam - birth), leaves, children, top
            small = [p for p in split if len(p) < min_cluster][0]
            leaves |= {m: lam for m in small}
            total += len(small) * (lam - birth)
            members, edges = big[0], [e for e in edges if e[1] in big[0]]

    def everything(c):
        return {**c[1], **{m: lam for child in c[2] for m, lam in everything(child).items()}}

    def best(c, allowed=True):
        inside = [best(child) for child in c[2]]
        score = sum(s for s, _ in inside)
        if allowed and c[0] >= score:
            return c[0], [(everything(c), c[3])]
        return score, [p for _, ps in inside for p in ps]

    picked = []
    for members in roots:
        if len(members) >= min_cluster:
            own = condense(members, [e for e in forest if e[1] in set(members)], 0.0)
            picked += best(own, len(members) < n)[1]
    return {tuple(v[m]): (k, min(1.0, lam / top)) for k, (points, top) in enumerate(picked) for m, lam in points.items()}


def blobs(seed, sizes, noise, d=3):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=d) * 8 + rng.normal(size=(s, d)) * rng.uniform(.2, 1) for s in sizes]
    return np.concatenate([*parts, rng.uniform(-20, 20, size=(noise, d))]).round(4).tolist()


def compare(spark, vectors, **options):
    df = spark.createDataFrame(list(enumerate(vectors)), "review_id long, v array<double>")
    got = {r.review_id: (r.topic, r.prob) for r in density.density_topics(df, "v", **options).collect()}
    want = plain(vectors, options["min_cluster"], options["min_samples"], options["neighbours"])
    assert len(got) == len(vectors)
    names = {}
    for i, vector in enumerate(vectors):
        topic, prob = want.get(tuple(vector), (-1, 0.0))
        assert (got[i][0] == -1) == (topic == -1) and got[i][1] == pytest.approx(prob, abs=6e-5)
        assert names.setdefault(got[i][0], topic) == topic
    assert len(set(names.values())) == len(names)
    return got


def test_equals_the_plain_version(spark):
    got = compare(spark, blobs(1, [40, 25, 30], 15) + blobs(1, [40], 0)[:3], min_cluster=8, min_samples=4, neighbours=10)
    sizes = [sum(t == k for t, _ in got.values()) for k in range(len({t for t, _ in got.values()} - {-1}))]
    assert len(sizes) >= 3 and sizes == sorted(sizes, reverse=True)


def test_rounds_and_bands_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(density, "IN_ONE_TASK", 60)
    compare(spark, blobs(2, [30, 20, 24], 10), min_cluster=6, min_samples=3, neighbours=6)


def test_leaves_of_trees_find_the_same_clusters(spark, monkeypatch):
    monkeypatch.setattr(density, "LEAF", 64)
    vectors = blobs(3, [60, 50, 40], 0)
    df = spark.createDataFrame(list(enumerate(vectors)), "review_id long, v array<double>")
    got = [r.topic for r in density.density_topics(df, "v", min_cluster=15, min_samples=5).orderBy("review_id").collect()]
    for lo, hi in ((0, 60), (60, 110), (110, 150)):
        inside = [t for t in got[lo:hi] if t >= 0]
        assert len(inside) > .8 * (hi - lo) and len(set(inside)) == 1
    assert len(set(got) - {-1}) == 3


def test_bad_vectors_and_small_tables(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (None, [1.0, 2.0]), (5, []), (6, [1.5, 2.5])]
    got = density.density_topics(spark.createDataFrame(rows, "review_id long, v array<double>"), "v").collect()
    assert len(got) == 6 and {(r.topic, r.prob) for r in got} == {(-1, 0.0)}
    assert density.density_topics(spark.createDataFrame([], "review_id long, v array<double>"), "v").collect() == []


def test_query(spark, data):
    got = QUERIES["density_topics"](spark, data)
    assert got.columns == ["vec_id", "topic", "prob"] and got.count() == spark.read.parquet(f"{data}/embeddings.parquet").count()

import random

import pytest

from brute import jaccard_components
from tideline.llm import jaccard

KIND = "doc_id long, text string, n long, component string"


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], KIND)
    return jaccard.jaccard_components(docs, **options).collect()


def family(seed, n_words, copies, edits):
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(n_words)]
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"x{r.randrange(5000)}"
        yield " ".join(w)


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5)])
def test_same_components_as_all_pairs(spark, k, num, den):
    texts = []
    for seed, (n, copies, edits) in enumerate([(12, 8, 1), (40, 12, 2), (150, 15, 8), (400, 12, 14), (30, 10, 1), (90, 20, 4)]):
        texts += family(seed, n, copies, edits)
    texts += ["a b c", "a b c", "A B c", "a", "a b", "", "  \n", "d e"]
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts))
    want = jaccard_components(rows, k, num, den)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, rows, k=k, num=num, den=den)}
    assert got == want


def test_last_round_takes_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SPANNING_ROUNDS", 0)
    rows = list(enumerate(family(8, 80, 60, 9)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, rows, k=3, num=9, den=10)}
    assert got == jaccard_components(rows, 3, 9, 10)


def test_table_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = jaccard_components([(r.doc_id, r.text) for r in docs.collect()], 3, 9, 10)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 3, 9, 10).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_large_tiles_are_cut_into_blocks(spark, monkeypatch):
    rows = list(enumerate(family(3, 60, 90, 5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = jaccard.shingle_postings(docs, 3, 9, 10)
    sets = jaccard.shingle_sets(docs, 3, 9, 10).cache()
    posts = table.selectExpr("doc_id", "explode(posts) AS post", "doc_id AS root")
    some = {tuple(r) for r in jaccard.tile_candidates(posts, sets, 9, 10, block=16).collect()}
    whole = {tuple(r) for r in jaccard.tile_candidates(posts, sets, 9, 10, block=10**6).collect()}
    assert some == whole and some
    span = {tuple(r) for r in jaccard.tile_candidates(posts, sets, 9, 10, spanning=True).collect()}
    assert span < whole
    few = spark.createDataFrame(sorted(span), "a long, b long")
    assert {tuple(r) for r in jaccard.tile_candidates(posts, sets, 9, 10, few).collect()} == whole - span


def test_nulls_repeated_rows_and_empty_table(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (1, None), (2, text), (2, text), (5, text), (6, "")]
    got = sorted((tuple(r) for r in run(spark, rows, k=3, num=9, den=10)), key=str)
    assert got == sorted([(None, 5, None), (1, 0, 1), (2, 5, 2), (2, 5, 2), (5, 5, 2), (6, 0, 6)], key=str)
    assert run(spark, []) == []


def test_only_possible_pairs_are_verified_and_settled_groups_rest(spark, monkeypatch):
    """Texts that share a passage, and hence groups, but are far from similar."""
    import numpy as np
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage = words(60)
    rows = [(i, " ".join(words(40) + passage)) for i in range(30)] + [(100, " ".join(passage)), (101, " ".join([*passage[:-1], "x"]))]
    pairs, plain = [], jaccard.verified

    def spy(found, *rest):
        pairs.append(found.count())
        return plain(found, *rest)

    monkeypatch.setattr(jaccard, "verified", spy)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(30)} | {100: 100, 101: 100}
    assert sum(pairs) < 10
    rooted = spark.createDataFrame([(p, d, d) for p, ds in {1: [1, 2, 3], 2: [2, 3, 4], 3: [1, 4], 4: [5, 6]}.items() for d in ds], "post long, doc_id long, root long")
    left = jaccard._unsettled(rooted, spark.createDataFrame([(2, 3), (4, 6)], "a long, b long")).collect()
    assert sorted({r.post for r in left}) == [1, 2] and len(left) == 6


def test_only_bitmaps_are_written_and_posts_go_when_groups_are_known(spark, monkeypatch):
    """Sets of all documents, and their posts, were most of the disk while pairs were sought."""
    import os
    written, plain = {}, jaccard.saved

    def spy(df, name):
        there = {n for n, t in written.items() if os.path.exists(t.scratch.removeprefix("file://"))}
        written[name] = plain(df, name)
        assert name == "postings" or not any(c.startswith("array") for _, c in df.dtypes), name
        assert name != "leaders" or "postings" not in there
        return written[name]

    monkeypatch.setattr(jaccard, "saved", spy)
    rows = list(enumerate(family(3, 40, 60, 2)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_components(rows, 5, 4, 5) and "leaders" in written

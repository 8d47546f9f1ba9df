"""Tiles that are dealt a part of the groups after the other."""

import random

from tideline.llm import jaccard


def test_parts_give_the_same_pairs_and_deal_fewer_rows_at_once(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        words = [w if rng.random() > .03 else f"n{rng.random()}" for w in words]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jaccard.shingle_sets(docs, 3, 4, 5).cache()
    posts = jaccard.shingle_postings(docs, 3, 4, 5).selectExpr("doc_id", "explode(posts) AS post", "doc_id AS root")
    dealt, whole = [], jaccard.tile_candidates
    monkeypatch.setattr(jaccard, "tile_candidates", lambda grouped, *a: dealt.append(grouped.count()) or whole(grouped, *a))
    want = {tuple(r) for r in jaccard.candidates_by_parts(posts, sets, 4, 5, None, False).collect()}
    assert len(dealt) == 1 and want
    monkeypatch.setattr(jaccard, "TILE_ROWS", dealt[0] // 2)
    monkeypatch.setattr(jaccard, "TILE_SHARE", 0)
    found = [tuple(r) for r in jaccard.candidates_by_parts(posts, sets, 4, 5, None, False).collect()]
    assert set(found) == want and len(found) == len(want)
    assert len(dealt) > 3 and sum(dealt[1:]) == dealt[0] and max(dealt[1:]) < dealt[0] / 2

import pytest

import corpus_pipeline as cp
from brute import jaccard_components, removed_words
from tideline.llm import toxicity
from tideline.llm.tables import saved

ROOT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """documents and what each stage made of them."""
    docs = [spark.read.parquet(f"{ROOT}/documents.parquet")]
    for name, stage in cp.STAGES:
        docs.append(saved(stage(spark, docs[-1], ROOT), name).cache())
    return docs


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_by_their_brute_force(spark, steps):
    raw, clean, single, cut, mixed, ids = map(rows, steps)
    labels = spark.read.parquet(f"{ROOT}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.toxicity(steps[0], labels).select("doc_id", "predicted").collect()
    assert set(clean) == {r.doc_id for r in scored if not r.predicted}
    root = jaccard_components([(i, r.text) for i, r in clean.items()], 5, 4, 5)
    assert set(single) == {i for i, (_, c) in root.items() if c == i} and len(single) < len(clean)
    kept = removed_words([(i, r.text) for i, r in single.items()], 50)
    for i, (left, n) in kept.items():
        assert cut[i].text == (single[i].text if len(left) == n else b" ".join(left).decode())
        assert cut[i].n_chars == (single[i].n_chars if len(left) == n else len(cut[i].text))
    assert set(cut) == set(single) == set(mixed) == set(ids)
    assert all(mixed[i] == cut[i] for i in cut)
    assert all(r.round_trip for r in ids.values())


def test_mixture_shows_in_the_order(steps):
    order = sorted(steps[5].collect(), key=lambda r: (r.mix_file, r.mix_row))
    sources = [r.source for r in order]
    share = {s: sources.count(s) / len(sources) for s in set(sources)}
    half = sources[:len(sources) // 2]
    assert len(set(sources)) > 5 and all(half.count(s) > 0 for s in share if share[s] > .03)
    assert len({(r.mix_file, r.mix_row) for r in order}) == len(order)


def test_columns_and_run(spark, steps):
    assert all(d.columns == cp.COLUMNS for d in steps[:5])
    small = "/root/testdata/sf0.001"
    out = cp.run(spark, small)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "mix_file", "mix_row", "n_pieces", "n_byte_pieces", "ids", "round_trip"]
    assert 0 < out.count() <= 200


def test_nulls_and_empty_tables_in_every_stage(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, n int, post long, extra string"
    data = [(None, None, None, None, None, 1, 1, "x"), (1, "", None, "a", 0, 1, 1, "x"), (1, "", None, "a", 0, 1, 1, "x"),
            (2, "b c", "en", None, 3, 1, 1, "x")]
    for some in (data, []):
        docs = saved(spark.createDataFrame(some, kind), "docs")
        for _, stage in cp.STAGES:
            docs = saved(stage(spark, docs, ROOT), "step")
        assert docs.count() == len(some)

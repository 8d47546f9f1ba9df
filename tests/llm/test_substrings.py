import random

import pytest

from brute import removed_words
from tideline.llm import substrings


def run(spark, rows, width):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, starts string")
    return substrings.remove_repeats(docs, width).collect()


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("ab") * r.randrange(1, 3) if r.random() < .3 else f"w{r.randrange(10**6)}"
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 80, 200)]
    out = []
    for _ in range(60):
        text = []
        for _ in range(r.randrange(4)):
            text += [word() for _ in range(r.randrange(70))]
            text += r.choice(passages)[r.randrange(3):]
        out.append(r.choice([" ", "\n", " \t "]).join(text))
    loop = ["x", "y", "z"] * 40
    return out + out[:5] + [" ".join(loop), "a b c", "a b c", "", "  ", "è ü " * 30]


def test_cover_meets_every_shift():
    for i in range(21):
        for j in range(21):
            assert any((i + d) % 21 in substrings.COVER and (j + d) % 21 in substrings.COVER for d in range(21))


@pytest.mark.parametrize("width", [21, 35, 50])
def test_same_words_as_brute_force(spark, width):
    rows = list(enumerate(corpus(width)))
    want = removed_words(rows, width)
    got = {r.doc_id: r for r in run(spark, rows, width)}
    assert len(got) == len(rows)
    for i, (kept, n) in want.items():
        assert (got[i].kept_text.encode(), got[i].n_words, got[i].n_removed) == (b" ".join(kept), n, n - len(kept)), i


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = removed_words([tuple(r) for r in docs.collect()], 35)
    got = {r.doc_id: (r.kept_text.encode(), r.n_words) for r in substrings.remove_repeats(docs, 35).collect()}
    assert got == {i: (b" ".join(k), n) for i, (k, n) in want.items()}


def test_nulls_repeated_rows_and_empty_table(spark):
    long = " ".join(f"t{i}" for i in range(40))
    got = run(spark, [(None, long), (1, None), (1, long), (2, "")], 35)
    assert sorted((str(r.doc_id), r.kept_text, r.n_words, r.n_removed) for r in got) == [
        ("1", "", 0, 0), ("1", "", 40, 40), ("2", "", 0, 0), ("None", "", 40, 40)]
    assert run(spark, [], 35) == []

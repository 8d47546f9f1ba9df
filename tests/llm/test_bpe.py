import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from tideline.llm import bpe, queries
from tideline.llm import words as W

PATH = path("byte_bpe_50k.json")
KIND = "doc_id long, text string, ids string, decoded int, extra string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_vocabulary(PATH))


def compare(encoder, tokenizer, texts):
    for lo, hi, data, offsets in W.slices(pa.array(texts, pa.string()), bpe.SLICE):
        ids, n = encoder.encode(data, offsets)
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts[lo:hi]]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        decoded = bpe.decode_ids(encoder.vocabulary, ids, np.concatenate([[0], np.cumsum(n)]))
        assert decoded == [tokenizer.decode(w, skip_special_tokens=False) for w in want]


PARTS = ["a", "b ", " c", "'s", "'ll", "'re", "'v", "'", "''", " '", "é", "  ", "\n", "\t ", " ", "　", " \u0085", "\x1c", "1", "!?",
         "<|endoftext|>", "<|endof", "漢", "​", "aaaa", "\U0001f600", "Ᲊ", "٣", "ⅷ", "͸"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), min_size=1, max_size=4))
def test_texts_encode_like_the_library(encoder, tokenizer, texts):
    compare(encoder, tokenizer, texts)


def test_very_long_texts_and_words(encoder, tokenizer):
    rng = np.random.default_rng(3)
    letters = "".join(rng.choice(list("abcdefghij"), 30_000))
    compare(encoder, tokenizer, ["a" * 20_001, "漢字かな交じり文" * 3000, letters, None, "", "so it goes, " * 60_000])


def test_forgetting_words_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    encoder = bpe.Encoder(bpe.load_vocabulary(PATH))
    for i in range(6):
        compare(encoder, tokenizer, [f"word{i + j} and another's <|endoftext|> {j * i}" for j in range(5)])


def test_ids_that_are_no_text(encoder, tokenizer):
    ids = np.array([50256, 0, 241, 242, 120, 1000, 49_999, 60_000, 187], np.int64)
    want = tokenizer.decode(ids.tolist(), skip_special_tokens=False)
    assert bpe.decode_ids(encoder.vocabulary, ids, np.array([0, len(ids), len(ids)])) == [want, ""]


def test_bytes_that_are_no_utf8_are_replaced(encoder):
    raw = b"ab\xff" + "é".encode()
    ids, n = encoder.encode(np.frombuffer(raw, np.uint8), np.array([0, 3, 5]))
    assert bpe.decode_ids(encoder.vocabulary, ids, np.array([0, n[0], n.sum()])) == ["ab�", "é"]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.load_vocabulary(path("word_bpe_49k.json"))


def test_query_against_the_library(spark, data, tokenizer):
    got = {r.doc_id: r for r in queries.op11_bpe(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert tuple(got[d.doc_id]) == (d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                                        hashlib.sha256(text.encode()).hexdigest())


def test_nulls_repeated_rows_clashing_columns_and_empty_table(spark, encoder):
    rows = [(None, "x y", "old", 1, None), (1, None, "old", 1, "e"), (1, None, "old", 1, "e"), (2, "", None, None, "e")]
    docs = bpe.encode_texts(spark.createDataFrame(rows, KIND), encoder.vocabulary)
    assert docs.columns == ["doc_id", "text", "decoded", "extra", "ids"]
    got = bpe.decode_texts(docs, encoder.vocabulary).collect()
    assert sorted((str(r.doc_id), len(r.ids), r.decoded, r.extra) for r in got if r.extra) == [("1", 0, "", "e"), ("1", 0, "", "e"), ("2", 0, "", "e")]
    assert [(len(r.ids), r.decoded) for r in got if not r.extra] == [(8, "x y")]
    empty = bpe.encode_texts(spark.createDataFrame([], KIND), encoder.vocabulary)
    assert bpe.decode_texts(empty, encoder.vocabulary).collect() == []
    nulls = bpe.decode_texts(spark.createDataFrame([(1, None)], "i int, ids binary"), encoder.vocabulary).collect()
    assert nulls[0].decoded == ""


def test_plan_has_no_shuffle(spark, data):
    assert "Exchange" not in queries.op11_bpe(spark, data)._jdf.queryExecution().executedPlan().toString()

import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from tideline.llm import bitplanes, words

PATH = path("byte_bpe_50k.json")
KIND = "doc_id long, text string, part string, path int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_file_round_trip(monkeypatch):
    monkeypatch.setattr(bitplanes, "BLOCK_IDS", 100)
    rng = np.random.default_rng(1)
    out = io.BytesIO()
    writer = bitplanes.PlaneWriter(out)
    given_ids, docs = [], []
    for _ in range(5):
        lengths = rng.integers(0, 90, 7)
        ids = rng.integers(0, 2**32, lengths.sum(), dtype=np.uint32)
        doc_ids = rng.integers(-5, 2**60, 7)
        writer.add(ids, doc_ids, doc_ids % 2 == 0, lengths)
        given_ids.append(ids)
        docs += list(zip(doc_ids, doc_ids % 2 == 0, lengths))
    writer.close()
    reader = bitplanes.PlaneReader(out)
    assert (np.concatenate(list(reader.blocks())) == np.concatenate(given_ids)).all()
    assert [x for d in reader.documents() for x in zip(*d)] == docs
    with pytest.raises(ValueError):
        bitplanes.PlaneReader(io.BytesIO(out.getvalue()[:-3]))


SPACES = ["a", "b ", " c", "'s", "é", "  ", "\n", "\t ", " ", " ", "　", " \u0085", "\x1c", "1", "!?", "<|endoftext|>", "漢", "​"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SPACES), max_size=14).map("".join), min_size=1, max_size=4))
def test_segments_encode_like_whole_texts(tokenizer, texts):
    import pyarrow as pa
    (_, _, data, offsets), = words.slices(pa.array(texts)) if any(texts) else [(0, 0, np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64))]
    encoder = bitplanes.SegmentEncoder(tokenizer)
    for _ in range(2):
        ids, n = encoder.encode(data, offsets)
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_new_segments_are_encoded_many_at_a_time(tokenizer):
    import pyarrow as pa

    class Counting:
        calls = 0

        def __getattr__(self, name):
            return getattr(tokenizer, name)

        def encode_batch_fast(self, texts, **options):
            Counting.calls += len(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    texts = [" ".join(f"{w}{i * 7919 % 99991}" for i, w in enumerate(["été", "x's", "漢字", "<|endoftext|>", "\t", "\u3000", "🙂", "a\u0085"] * 400)),
             " leading", "trailing  ", "", "\n"]
    (_, _, data, offsets), = words.slices(pa.array(texts))
    ids, n = bitplanes.SegmentEncoder(Counting()).encode(data, offsets)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert Counting.calls < 100


def test_table_against_plain_encoding(spark, data, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = sorted(bitplanes.token_id_table(docs.repartition(3), PATH).collect())
    start = 0
    for r, d in zip(got, docs.orderBy("doc_id").collect()):
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(r) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == docs.count()


def test_nulls_repeated_rows_and_empty_table(spark):
    rows = [(None, "x", "p", 1), (1, None, "p", 1), (1, None, "p", 1), (2, "", "p", 1)]
    got = bitplanes.token_id_table(spark.createDataFrame(rows, KIND), PATH).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens) for r in got) == [("1", 2, 1), ("1", 3, 1), ("2", 4, 1), ("None", 0, 2)]
    assert bitplanes.token_id_table(spark.createDataFrame([], KIND), PATH).collect() == []

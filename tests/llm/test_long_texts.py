"""Texts of more than a slice, beside short, empty and missing ones, through every operator on documents."""

import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from brute import jaccard_components, removed_words
from tideline.llm import bitplanes, fingerprints, jaccard, language_model, mixing, pieces, sharding, substrings, toxicity

LONG = " ".join(f"word{i * i % 7001}" for i in range(150_000))  # about 1.3 MB, more than a slice
CASES = [(1, LONG), (2, LONG), (3, LONG[:400_000] + " another end"), (4, "a short text about nothing much"), (5, None), (6, ""),
         (7, "x" * 50_000), (8, "a short text about nothing more")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 2}", "en", len(t or "")) for i, t in CASES]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(3)


def test_jaccard(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 3, 9, 10).collect()}
    assert got == jaccard_components(CASES, 3, 9, 10) and got[2][1] == 1


def test_sharding(docs):
    got = sharding.sharded(docs.select("doc_id", "text"), shards=3).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 9)) and {r.text for r in got if r.doc_id == 1} == {LONG}
    assert sorted(np.bincount([r.shard for r in got])) == [2, 3, 3]


def test_mixing(docs):
    got = mixing.mix_sources(docs).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.text) == sorted((i, t) for i, t in CASES if t) and len(got) == 8


def test_repeats(docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(docs, width=35).collect()}
    for i, (left, n) in removed_words(CASES, 35).items():
        assert got[i][:2] == (n, n - len(left)) and (got[i][2] or "") == b" ".join(left).decode()


def test_token_ids(docs):
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in bitplanes.token_id_table(docs, path("byte_bpe_50k.json")).collect()}
    for i, t in CASES:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_pieces(docs):
    vocabulary = pieces.load_pieces(path("piece_bpe_32k.model"))
    got = pieces.decode_pieces(pieces.encode_pieces(docs, vocabulary), vocabulary).collect()
    assert all(r.decoded == (r.text or "") for r in got) and len(got) == 8


def test_fingerprints(docs):
    got = {r.doc_id: r for r in fingerprints.fingerprint_table(docs).collect()}
    assert got[1].fingerprint == got[2].fingerprint != got[4].fingerprint and got[5].fingerprint == got[6].fingerprint
    assert all(r.n_chars == len(t or "") and 0 <= r.near_edited <= 1 for (i, t) in CASES for r in [got[i]])


def test_toxicity_and_language_model(spark, docs):
    more = spark.createDataFrame([(100 + i, "you are an awful idiot" if i % 2 else "a kind and pleasant day", "s", "en", 0) for i in range(200)], docs.schema)
    both = docs.unionByName(more)
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(200)], "doc_id long, toxic int")
    scored = {r.doc_id: r for r in toxicity.toxicity(both.select("doc_id", "text"), labels).collect()}
    assert len(scored) == 208 and all(0 <= r.score <= 1 for r in scored.values()) and scored[1].score == scored[2].score
    lm = {r.doc_id: r for r in language_model.score_texts(both).collect()}
    assert len(lm) == 208 and all(np.isfinite(r.score) and r.score < 0 for r in lm.values()) and lm[1].n_tokens == 150_001

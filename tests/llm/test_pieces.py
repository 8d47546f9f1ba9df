import random

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path

from tideline.llm import pieces, queries, words

SMALL = ["▁", "a", "b", "ab", "▁a", "▁ab", "aba", "bab", "▁▁", "é", "éa", "b▁"[:1] + "é", "▁é", "c"]
BYTES = list(range(100, 356))


@pytest.fixture(scope="module")
def small():
    r = random.Random(2)
    return pieces.build_pieces([(p, -r.random() * 8 - 1, i) for i, p in enumerate(SMALL)], BYTES, 356)


@pytest.fixture(scope="module")
def real():
    return pieces.load_pieces(path("piece_bpe_32k.model"))


def encode(vocabulary, texts):
    encoder = pieces.PieceEncoder(vocabulary)
    for _ in range(2):
        out = []
        for lo, hi, data, offsets in words.slices(pa.array(texts)):
            ids, n = encoder.encode_texts(data, offsets)
            bounds = np.concatenate([[0], np.cumsum(n)])
            out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def best_score(vocabulary, scored, text):
    """Highest sum of scores of any way to spell the marked text, character by character."""
    t = "▁" + text.replace("▁", "\0").replace(" ", "▁") if text else ""
    best = [0.0] + [-np.inf] * len(t)
    for i in range(len(t)):
        if t[i] not in scored:
            best[i + 1] = max(best[i + 1], best[i] + vocabulary.fallback)
        for j in range(i + 1, min(len(t), i + 60) + 1):
            if t[i:j] in scored:
                best[j] = max(best[j], best[i] + scored[t[i:j]])
    return best[-1]


def score_of(vocabulary, ids):
    total, k = 0.0, 0
    known = set(vocabulary.byte_ids.tolist())
    while k < len(ids):
        if ids[k] in known:
            lead = vocabulary.flat[vocabulary.offsets[ids[k]]]
            k += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            total += vocabulary.fallback
        else:
            total += vocabulary.score[ids[k]]
            k += 1
    return total


def test_double_array_holds_exactly_its_entries():
    r = random.Random(4)
    entries = sorted({bytes(r.randrange(256) for _ in range(r.randrange(1, 6))) for _ in range(3000)})
    base, check, value = pieces.double_array([(e, i) for i, e in enumerate(entries)])

    def find(text):
        node = 0
        for c in text:
            child = base[node] + c
            if child >= len(check) or check[child] != node or child == 0:
                return -1
            node = child
        return value[node] if text else -1

    assert [find(e) for e in entries] == list(range(len(entries)))
    known = set(entries)
    assert all(find(e + b"x") == -1 for e in entries[:500] if e + b"x" not in known)


def test_best_way_and_round_trip_small(small):
    r = random.Random(9)
    texts = ["".join(r.choice("aabbé c▁漢\n") for _ in range(r.randrange(14))) for _ in range(300)] + ["", " ", "  ", "a"]
    scored = {p: small.score[i] for i, p in enumerate(SMALL)}
    for text, ids in zip(texts, encode(small, texts)):
        assert score_of(small, ids) == pytest.approx(best_score(small, scored, text))
        assert pieces.decode_ids(small, np.array(ids, np.int64), np.array([0, len(ids)])) == [text]


def test_best_way_and_round_trip_real(real):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    scored = {model.id_to_piece(i): real.score[i] for i in range(32000) if np.isfinite(real.score[i])}
    texts = ["The quick brown fox", "Über  größere\tDinge: ▁ ok", "x" * 3000, "漢字かな 🙂 end ", "a▁b"]
    for text, ids in zip(texts, encode(real, texts)):
        assert score_of(real, ids) == pytest.approx(best_score(real, scored, text))
        assert pieces.decode_ids(real, np.array(ids, np.int64), np.array([0, len(ids)])) == [text]


def test_table_round_trip(spark, data):
    rows = queries.QUERIES["op6_piece_encoding"](spark, data).collect()
    assert len(rows) == 200 and all(r.round_trip for r in rows)
    assert all(r.n_pieces == len(r.ids) for r in rows)


def test_nulls_clashing_columns_and_empty_table(spark, small):
    kind = "doc_id long, text string, ids string, decoded int"
    docs = spark.createDataFrame([(None, "ab", "x", 1), (1, None, "x", 1), (1, "", "x", 1)], kind)
    got = pieces.decode_pieces(pieces.encode_pieces(docs, small), small)
    assert sorted((str(r.doc_id), r.decoded) for r in got.collect()) == [("1", ""), ("1", ""), ("None", "ab")]
    assert pieces.encode_pieces(docs.limit(0), small).collect() == []


def test_new_segments_are_searched_in_bounded_runs(monkeypatch, real):
    """A search over a whole slice of new segments took some hundred MB, which the worker kept."""
    raw = b"".join(b" w%d" % (i * 7919) for i in range(6000)) + b" " + b"x" * 5000 + b" end"
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, 0, 300, len(raw)])
    once = pieces.PieceEncoder(real).encode_texts(data, offsets)
    seen, plain = [], pieces.viterbi
    monkeypatch.setattr(pieces, "SEARCH_BYTES", 4096)
    monkeypatch.setattr(pieces, "viterbi", lambda p, d, a, b: (seen.append((int((b - a).sum()), len(a))), plain(p, d, a, b))[1])
    ids, n = pieces.PieceEncoder(real).encode_texts(data, offsets)
    assert len(seen) > 5 and all(size <= 4096 or count == 1 for size, count in seen)
    assert n.tolist() == once[1].tolist() and (ids == once[0]).all()

import zlib
from hashlib import sha256

import numpy as np
import pytest

import check
from tideline.llm import merkle, queries

KIND = "doc_id long, text string, lang string, source string, n_chars long, root string, tree int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(text):
    return sha256(text.encode()).hexdigest()


def row_leaf(d, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d.doc_id, d.source, d.lang, d.n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def steps(tree, i):
    for level in tree[:-1]:
        lo = i // 8 * 8
        yield level[lo:i], level[i + 1:lo + 8]
        i //= 8


def brute(docs):
    langs = {}
    for d in docs:
        langs.setdefault(d.lang, []).append((d.doc_id is not None, d.doc_id or 0, row_leaf(d, d.text), d))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {n: levels([x[2] for x in sorted(langs[n], key=lambda x: x[:3])]) for n in names}
    top = levels([trees[n][-1][0] for n in names])
    root, out = top[-1][0], []
    for k, n in enumerate(names):
        for i, (_, _, leaf, d) in enumerate(sorted(langs[n], key=lambda x: x[:3])):
            path = [*steps(trees[n], i), *steps(top, k)]
            changed = d.doc_id is not None and zlib.crc32(str(d.doc_id).encode()) % 3 == 0 and d.text is not None
            node = row_leaf(d, d.text.translate(LOWER)) if changed else leaf
            for a, b in path:
                node = h("".join(a) + node + "".join(b))
            proof = h("".join(x for a, b in path for x in a + b))
            out.append((d.doc_id, leaf, trees[n][-1][0], root, proof, node, node == root))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("height", [1, 4])
def test_against_brute_force(spark, data, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = merkle.document_proofs(docs.repartition(3)).collect()
    assert order(got) == order(brute(docs.collect()))
    assert {r.verified for r in got} == {True, False} and len({r.root for r in got}) == 1


def test_many_groups(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    docs = spark.range(300).selectExpr("id AS doc_id", "CONCAT('Text ', id) AS text", "CONCAT('l', id % 70) AS lang", "'s' AS source", "id AS n_chars")
    assert order(merkle.document_proofs(docs).collect()) == order(brute(docs.collect()))


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_layout_is_a_permutation_with_whole_lower_trees(levels):
    places = [merkle.addresses(levels, d, np.arange(8 ** d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.subtree_size(levels)))
    assert places[0][0] == 0
    upper = levels // 2
    if upper:
        low = merkle.subtree_size(levels - upper)
        assert np.diff(places[upper]).tolist() == [low] * (8 ** upper - 1)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 73, 511])
def test_fold_of_a_path_gives_the_root_and_survives_packing(n):
    leaves = [h(str(i)).encode() for i in range(n)]
    height = merkle.block_height(n)
    nodes = merkle.build_block(leaves, height)
    assert nodes[0].decode() == levels([x.decode() for x in leaves])[-1][0]
    local = merkle.sibling_path(nodes, height, n)
    for i in range(n):
        path = [level[i // 8 ** d] for d, level in enumerate(local)]
        assert merkle.unpack_path(merkle.pack_path(path)) == path
        assert merkle.fold(leaves[i], path) == nodes[0]


def test_nulls_long_texts_repeated_rows_clashing_columns_and_empty_table(spark):
    rows = [(None, "A", None, None, None, "x", 1), (None, "A", None, None, None, "x", 1), (3, None, "de", "s", 1, None, None),
            (3, None, "de", "s", 1, None, None), (0, "", "de", "é", 0, None, None), (7, "Ünd A-Z " * 200_000, "DE", None, 9, None, None),
            *[(i, f"Row {i}", "de", None, i, None, None) for i in range(20)]]
    docs = spark.createDataFrame(rows, KIND)
    got = merkle.document_proofs(docs).collect()
    assert order(got) == order(brute(docs.collect()))
    assert merkle.document_proofs(spark.createDataFrame([], KIND)).collect() == []
    alone = merkle.document_proofs(spark.createDataFrame(rows[:1], KIND)).collect()[0]
    assert alone.leaf == alone.subroot == alone.root == alone.folded_root and alone.proof_sha256 == h("")


def test_query_against_sql(spark, data):
    state = check.compare(spark, check.connect(data), data, "op12", queries.QUERIES["op12_merkle_manifest"], queries.SQL["op12_merkle_manifest"])
    assert state.startswith("ok"), state

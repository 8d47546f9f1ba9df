"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Distinct vectors are the nodes. One more coordinate puts them on a sphere, so that near
in angle is near in product. The graph starts from random splits into leaves, at medians,
and improves by iterative joins: every node gathers its neighbours and some that it is a
neighbour of, and pairs of which one is new there are offered to each other, until hardly
a list changes. A query then searches greedily, from its own place and from the best of a
fixed number of entries: it joins the neighbours of its best nodes and goes on from those
that are new, until there are none.

Lists are capped, which is the method; all vectors are indexed and all queries answered.
The graph works on components in single precision and compares them in double precision:
nodes by minus half the squared distance on the sphere, which keeps its digits when one
long vector makes the sphere large. Scores of the result are products of the original
vectors in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.tables import map_groups, saved

KEEP = 40  # neighbours in a node's list
FORWARD, BACKWARD = 36, 18  # neighbours, and nodes it is a neighbour of, that a node gathers
TREES, LEAF = 20, 256  # random splits that start the graph, and most nodes of a leaf
COARSE, PER_LEAF = 1 << 10, 32  # most groups that a tree splits on a sample, and sampled nodes of each
SETTLED = .002  # share of the lists' entries; the graph is done when fewer are new
OFFER = 14  # partners that a node is offered in one gathering
ENTRIES = 1024  # longest nodes, and as many others, of which the best start a search
_NONE = float("-inf")
_LISTS = "node long, ids array<long>, scores array<double>, born int"


def _parts(rows: DataFrame) -> DataFrame:
    """Distinct vectors as (node, v), node the smallest id; rows as (id, node)."""
    keyed = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    node = saved(keyed.groupBy("h1", "h2").agg(F.min("id").alias("node")), "nodes")
    return saved(keyed.join(node, ["h1", "h2"]).select("id", "node", F.when(F.col("id") == F.col("node"), F.col("v")).alias("v")), "members")


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL").where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    return rows.dropDuplicates(["id"])


def _packed(nodes: DataFrame, unit: float) -> DataFrame:
    """(node, q): the vector over ``unit``, a power of two, as bytes of single precision."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
            q = (v / unit).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in q], pa.binary())], ["node", "q"])

    return nodes.select("node", "v").mapInArrow(run, "node long, q binary")


def _points(column: pa.ChunkedArray) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(np.float64)


def _off_plane(square: np.ndarray, radius: float) -> np.ndarray:
    """The coordinate that puts vectors with these squared lengths on the sphere."""
    return np.sqrt(np.maximum(radius**2 - square, 0))


def _closeness(x: np.ndarray, radius: float) -> np.ndarray:
    """Minus half the squared distances on the sphere; none with itself."""
    square = (x * x).sum(axis=1)
    off = _off_plane(square, radius)
    scores = x @ x.T - (square[:, None] + square) / 2 - (off[:, None] - off) ** 2 / 2
    np.fill_diagonal(scores, _NONE)
    return scores


def _offers(ids: np.ndarray, partners: np.ndarray, scores: np.ndarray, least: np.ndarray, most: int, born: int):
    """A batch of each id's best partners among the columns of ``scores`` above its least score."""
    k = min(most, scores.shape[1])
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    best = np.take_along_axis(scores, top, 1)
    good = best > least[:, None]
    bounds = np.concatenate([[0], np.cumsum(good.sum(axis=1))]).astype(np.int32)
    found = pa.RecordBatch.from_arrays([
        pa.array(ids), pa.ListArray.from_arrays(pa.array(bounds), pa.array(partners[top[good]])),
        pa.ListArray.from_arrays(pa.array(bounds), pa.array(best[good].astype(np.float64))),
        pa.array(np.full(len(ids), born, np.int32))], ["node", "ids", "scores", "born"])
    return found.filter(pa.array(good.any(axis=1)))


def _halves(x: np.ndarray, way: np.ndarray) -> np.ndarray:
    """Row numbers by their place along ``way``; rows at one place in their own order."""
    return np.argsort((x - x.mean(axis=0)) @ way, kind="stable")


def _tree(sample: np.ndarray, depth: int, rng) -> list[tuple[np.ndarray, np.ndarray]]:
    """Directions and medians of the nodes of each level: random splits of a sample into equal halves."""
    parts, levels = [np.arange(len(sample))], []
    for _ in range(depth):
        ways = rng.standard_normal((len(parts), sample.shape[1]))
        cuts, halves = np.zeros(len(parts)), []
        for i, part in enumerate(parts):
            place = sample[part] @ ways[i]
            order, half = np.argsort(place), len(part) // 2
            cuts[i] = place[order[half]] if len(part) else 0.0
            halves += [part[order[:half]], part[order[half:]]]
        levels.append((ways, cuts))
        parts = halves
    return levels


def _first_lists(points: DataFrame, n: int, radius: float, seed: int) -> DataFrame:
    """Offers from the leaves of random splits.

    A tree splits at medians of a sample of fixed size; each of its groups is then split
    at its own medians until every leaf has at most LEAF nodes. Directions differ by tree
    and group, so a dense cluster is split as any other part, and differently each time.
    """
    depth = max(0, min(math.ceil(math.log2(max(n, 1) / (4 * LEAF))), COARSE.bit_length() - 1))
    trees = TREES if n > LEAF else 1
    lifted = lambda x: np.column_stack([x, _off_plane((x * x).sum(axis=1), radius)])
    levels = []
    if depth:
        want = PER_LEAF << depth
        drawn = points.where(F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1 << 30)) < int((1 << 30) * min(1, want / n)))
        sample = lifted(_points(drawn.select("q").toArrow().column("q")))  # a fixed number, about
        levels = [_tree(sample, depth, np.random.default_rng([seed, tree])) for tree in range(trees)]
    held = points.sparkSession.sparkContext.broadcast(levels)

    def split(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = lifted(_points(pa.chunked_array([batch.column("q")])))
            for tree in range(trees):
                leaf = np.zeros(len(x), np.int64)
                for ways, cuts in held.value[tree] if depth else ():
                    leaf = 2 * leaf + ((x * ways[leaf]).sum(axis=1) >= cuts[leaf])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, np.int64)), pa.array(leaf), *batch.columns],
                                                 ["tree", "leaf", "node", "q"])

    def pair(group: pa.Table):
        ids, x = group.column("node").to_numpy(), _points(group.column("q"))
        rng = np.random.default_rng([seed, group.column("tree")[0].as_py(), group.column("leaf")[0].as_py()])
        above, todo = lifted(x), [np.arange(len(ids))]
        while todo:
            part = todo.pop()
            if len(part) > LEAF:
                order = part[_halves(above[part], rng.standard_normal(above.shape[1]))]
                todo += [order[:len(part) // 2], order[len(part) // 2:]]
            elif len(part) > 1:
                yield _offers(ids[part], ids[part], _closeness(x[part], radius), np.full(len(part), _NONE), OFFER if n > LEAF else KEEP, 0)

    rows = points.mapInArrow(split, "tree long, leaf long, node long, q binary")
    return map_groups(rows, ["tree", "leaf"], pair, _LISTS)


def _merged(offers: DataFrame, keep: int) -> DataFrame:
    """Each node's best distinct partners, with the round that first brought each."""
    def merge(rows: pa.Table):
        lengths = np.diff(rows.column("ids").combine_chunks().offsets.to_numpy())
        ids = rows.column("ids").combine_chunks().flatten().to_numpy()
        scores = rows.column("scores").combine_chunks().flatten().to_numpy()
        born = np.repeat(rows.column("born").to_numpy(), lengths)
        order = np.lexsort((born, ids, -scores))
        ids, scores, born = ids[order], scores[order], born[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = ids[1:] != ids[:-1]  # equal ids have equal scores and stand together
        at = np.flatnonzero(fresh)[:keep]
        yield pa.RecordBatch.from_arrays([
            rows.column("node").combine_chunks().slice(0, 1), pa.array([ids[at].tolist()], pa.list_(pa.int64())),
            pa.array([scores[at].tolist()], pa.list_(pa.float64())), pa.array([born[at].tolist()], pa.list_(pa.int32())),
            pa.array([float(scores[at[-1]]) if len(at) == keep else _NONE], pa.float64())],
            ["node", "ids", "scores", "borns", "least"])

    return map_groups(offers, ["node"], merge, "node long, ids array<long>, scores array<double>, borns array<int>, least double")


def _as_offers(graph: DataFrame) -> DataFrame:
    """The lists again, one row for each round that brought some of a node's partners."""
    entry = graph.select("node", F.inline(F.arrays_zip("ids", "scores", "borns")))
    return entry.groupBy("node", F.col("borns").alias("born")).agg(
        F.collect_list("ids").alias("ids"), F.collect_list("scores").alias("scores")).select("node", "ids", "scores", "born")


def _around(graph: DataFrame, turn: int) -> DataFrame:
    """(at, node, new): the neighbours of each node and some nodes that it is a neighbour of."""
    edges = graph.select("node", F.posexplode(F.arrays_zip("ids", "borns"))).select(
        "node", "pos", F.col("col.ids").alias("id"), (F.col("col.borns") == turn).alias("new"))
    forward = edges.where(F.col("pos") < FORWARD).select(F.col("node").alias("at"), F.col("id").alias("node"), "new")
    order = Window.partitionBy("id").orderBy(F.xxhash64("node", F.lit(turn)))
    backward = edges.withColumn("r", F.row_number().over(order)).where(F.col("r") <= BACKWARD)
    return forward.unionByName(backward.select(F.col("id").alias("at"), "node", "new"))


def _gathered(graph: DataFrame, points: DataFrame, turn: int) -> DataFrame:
    """(at, node, q, least, new): what each node brings together that has something new."""
    both = _around(graph, turn).groupBy("at", "node").agg(F.max("new").alias("new"))
    both = both.withColumn("any", F.max("new").over(Window.partitionBy("at"))).where("any").drop("any")
    held = points.join(graph.select("node", "least"), "node", "left").select("node", "q", F.coalesce("least", F.lit(_NONE)).alias("least"))
    return both.join(held, "node").select("at", "node", "q", "least", "new")


def neighbour_graph(points: DataFrame, n: int, radius: float, seed: int = 7) -> DataFrame:
    """node, ids, scores, borns, least: each node's neighbours, best first."""
    graph = saved(_merged(_first_lists(points, n, radius, seed), KEEP), "graph")
    if n <= LEAF:
        return graph  # one leaf held them all
    turn, fresh = 0, n * KEEP
    while fresh > SETTLED * n * KEEP:
        def offer(rows: pa.Table, turn=turn):
            ids, new = rows.column("node").to_numpy(), rows.column("new").to_numpy(zero_copy_only=False)
            if len(ids) > 1:
                scores = _closeness(_points(rows.column("q")), radius)
                scores[~(new[:, None] | new)] = _NONE
                yield _offers(ids, ids, scores, rows.column("least").to_numpy(), OFFER, turn + 1)

        offers = map_groups(_gathered(graph, points, turn), ["at"], offer, _LISTS)
        graph = saved(_merged(offers.unionByName(_as_offers(graph)), KEEP), "graph")
        turn += 1
        fresh = graph.agg(F.sum(F.size(F.filter("borns", lambda b: b == turn)))).first()[0] or 0
    return graph


def _entries(points: DataFrame, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the longest nodes and of as many others: a fixed number at most."""
    def lengths(batches):
        for batch in batches:
            x = _points(pa.chunked_array([batch.column("q")])) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((x * x).sum(axis=1))], ["node", "q", "square"])

    long = points.select("node", "q").mapInArrow(lengths, "node long, q binary, square double").orderBy(F.desc("square"), "node")
    some = points.select("node", "q").orderBy(F.xxhash64(F.lit(seed), "node"), "node")
    found = long.select("node", "q").limit(ENTRIES).unionByName(some.limit(ENTRIES)).toArrow()
    ids, first = np.unique(found.column("node").to_numpy(), return_index=True)
    return ids, _points(found.column("q"))[first] if len(ids) else np.zeros((0, 1))


def search(graph: DataFrame, points: DataFrame, queries: DataFrame, keep: int = KEEP, seed: int = 7) -> DataFrame:
    """node, ids: the best found for each of ``queries`` (node, q), by greedy search until nothing new is found."""
    held = points.sparkSession.sparkContext.broadcast(_entries(points, seed))

    def enter(batches):
        ids, x = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                own = some.column("node").to_numpy()
                scores = _points(pa.chunked_array([some.column("q")])) @ x.T
                scores[own[:, None] == ids] = _NONE
                yield _offers(own, ids, scores, np.full(len(own), _NONE), keep, 0)

    def ask(rows: pa.Table, step: int):
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        x, ids = _points(rows.column("q")), rows.column("node").to_numpy()
        if not asks.all():
            yield _offers(rows.column("query").to_numpy()[:1], ids[~asks], x[asks][:1] @ x[~asks].T,
                          rows.column("least").to_numpy()[asks][:1], keep, step)

    around = _around(graph, -1).groupBy("at").agg(F.collect_set("node").alias("near"))
    around = saved(around, "around")
    found, step = saved(_merged(queries.select("node", "q").mapInArrow(enter, _LISTS), keep), "found"), 0
    targets = found.select(F.col("node").alias("query"), F.explode("ids").alias("at")).unionByName(
        queries.select(F.col("node").alias("query"), F.col("node").alias("at")))
    while True:
        step += 1
        # a query's candidates are the neighbours of its new best nodes, less those that it has
        near = targets.join(around, "at").select("query", F.explode("near").alias("node")).where("query <> node").distinct()
        have = found.select(F.col("node").alias("query"), F.explode("ids").alias("node"))
        near = near.join(have, ["query", "node"], "left_anti")
        asked = queries.join(found.select("node", "least"), "node", "left")
        rows = near.join(points, "node").select("query", "node", "q", F.lit(None).cast("double").alias("least"), F.lit(False).alias("asks"))
        rows = rows.unionByName(asked.select(F.col("node").alias("query"), "node", "q", F.coalesce("least", F.lit(_NONE)).alias("least"), F.lit(True).alias("asks")))
        offers = map_groups(rows, ["query"], lambda g, step=step: ask(g, step), _LISTS)
        found = saved(_merged(offers.unionByName(_as_offers(found)), keep), "found")
        targets = found.select(F.col("node").alias("query"), F.inline(F.arrays_zip("ids", "borns"))).where(F.col("borns") == step).select("query", F.col("ids").alias("at"))
        if targets.isEmpty():
            return found.select("node", "ids")


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by ``every``.

    Nearness is the largest inner product; ties go to the smaller id. A query's own row is
    no candidate, a row with an equal vector is. Rows take no part whose id or vector is
    null or whose vector is zero or has a null, NaN or infinite component; of rows with one
    id, one counts. Vectors must have one length. Other columns are not read.
    """
    rows = _parts(_usable(vectors, key, vector))
    nodes = rows.where("v IS NOT NULL").select("node", "v")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, radius, most = nodes.agg(F.count("*"), F.sqrt(F.max(square)), F.max(F.array_max(F.transform("v", F.abs)))).first()
    unit = 2.0 ** math.ceil(math.log2(most)) if most else 1.0
    points, radius = saved(_packed(nodes, unit), "points"), (radius or 0.0) / unit
    graph = neighbour_graph(points, n, radius, seed=seed)
    asked = rows.where(F.col("id") % every == 0).select("node").distinct()
    queries = saved(points.join(asked, "node"), "queries")
    found = search(graph, points, queries, keep=max(KEEP, 2 * k), seed=seed)

    # its own node is a candidate too: rows with an equal vector
    pairs = queries.select("node", F.col("node").alias("other")).unionByName(
        found.select("node", F.explode("ids").alias("other"))).distinct()
    pairs = pairs.join(nodes, "node").withColumnRenamed("v", "x")
    pairs = pairs.join(nodes.select(F.col("node").alias("other"), F.col("v").alias("y")), "other")

    def score(batches):
        for batch in batches:
            m = batch.num_rows
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(m, -1) if m else np.zeros((0, 1)) for c in "xy")
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("other"), pa.array((x * y).sum(axis=1))],
                                             ["node", "other", "score"])

    scored = saved(pairs.select("node", "other", "x", "y").mapInArrow(score, "node long, other long, score double"), "scored")
    # of rows with one vector the k + 1 smallest ids can be among a query's nearest
    order = Window.partitionBy("node").orderBy("id")
    copies = rows.select("id", "node").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    few = scored.join(copies.select(F.col("node").alias("other"), F.col("id").alias("vec_id")), "other")
    best = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    few = few.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    answers = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "node").join(few, "node").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Density clustering of vectors: mutual reachability, spanning tree, condensed tree, stability.

Neighbours are searched in the leaves of random projection trees, so no vector meets all
others; a table that fits one leaf is searched exactly. The graph of nearest neighbours,
with edges as long as the larger of the distance and both core distances, is reduced to a
spanning tree by Boruvka rounds of joins. Its edges are then merged from the shortest on,
in bands of a bounded number of edges: a band sees only the components that it touches.
Merges give the condensed tree and the stability of each cluster; the clusters that beat
all clusters inside them, seen from the top, become topics.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numbers import half_even
from tideline.operators.scratch import removed, written

LEAF = 1024
TREES = 6  # where one leaf does not hold all
EXTRA_LEVELS = 2  # leaves stay below LEAF although medians are approximate
IN_ONE_TASK = 500_000  # edges that one task may hold
ROWS = 64  # rows compared with a leaf at a time


def nearest_pairs(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(a, b, d): the k nearest found neighbours of every (node, v), nearest first, ties to the smaller node."""
    n = points.count()
    levels = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    trees, levels = (1, 0) if levels == 0 else (TREES, levels + EXTRA_LEVELS)
    held = points.select("node", "v", F.lit(0).alias("tree"), F.lit(0).cast("long").alias("cell"))
    if levels:
        def project(batches):
            for batch in batches:
                v = np.array(batch.column("v").to_pylist(), float)
                for tree in range(trees):
                    ways = np.random.default_rng([seed, tree]).normal(size=(v.shape[1], levels)) if len(v) else np.zeros((0, levels))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("node"), pa.array(np.full(len(v), tree, np.int32)), pa.array(list(v @ ways), pa.list_(pa.float64()))],
                        ["node", "tree", "p"])

        spots = written(points.mapInArrow(project, "node long, tree int, p array<double>").withColumn("cell", F.lit(1).cast("long")), "density_spots")
        for level in range(levels):
            middle = spots.groupBy("tree", "cell").agg(F.percentile_approx(F.get("p", F.lit(level)), 0.5, 1000).alias("m"))
            side = F.col("cell") * 2 + (F.get("p", F.lit(level)) > F.col("m")).cast("long")
            after = written(spots.join(middle, ["tree", "cell"]).select("node", "tree", "p", side.alias("cell")), "density_spots")
            removed(spots)
            spots = after
        held = points.join(spots.drop("p"), "node")

    def search(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        order = np.argsort(node)
        node, v = node[order], np.array(table.column("v").to_pylist(), float)[order]
        a, b, d = [], [], []
        for lo in range(0, len(node), ROWS):
            gap = np.sqrt(((v[lo:lo + ROWS, None, :] - v[None, :, :]) ** 2).sum(axis=2))
            rows = np.arange(len(gap))
            gap[rows, lo + rows] = np.inf
            near = np.argsort(gap, axis=1, kind="stable")[:, :min(k, len(node) - 1)]
            a.append(np.repeat(node[lo + rows], near.shape[1]))
            b.append(node[near].ravel())
            d.append(gap[rows[:, None], near].ravel())
        empty = np.zeros(0)
        return pa.table({"a": pa.array(np.concatenate(a or [empty]), pa.int64()), "b": pa.array(np.concatenate(b or [empty]), pa.int64()),
                         "d": pa.array(np.concatenate(d or [empty]), pa.float64())})

    found = held.groupBy("tree", "cell").applyInArrow(search, "a long, b long, d double")
    if trees > 1:
        found = found.distinct()  # the same neighbour from several trees
    rank = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))  # at most k rows a tree
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def reachability(pairs: DataFrame, min_samples: int) -> DataFrame:
    """(a, b, w), a < b: each pair once, as long as its distance and both ends' core distances."""
    core = pairs.where(F.col("rank") <= min_samples).groupBy("a").agg(F.max("d").alias("core"))
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").distinct()
    ends = both.join(core, "a").withColumnRenamed("core", "core_a").join(core.select(F.col("a").alias("b"), "core"), "b")
    return ends.select("a", "b", F.greatest("d", "core_a", "core").alias("w"))


def _find(parent: list[int], x: int) -> int:
    root = x
    while parent[root] != root:
        root = parent[root]
    while parent[x] != root:
        parent[x], x = root, parent[x]
    return root


def _alone(df: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on all rows at once; they are bounded by IN_ONE_TASK."""
    return df.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(lambda t: work(t.drop_columns("one")), schema)


def _kruskal(table: pa.Table) -> pa.Table:
    w, a, b, ca, cb = (table.column(c).to_numpy() for c in ("w", "a", "b", "ca", "cb"))
    order = np.lexsort((cb, ca, b, a, w))
    nodes, at = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    parent = list(range(len(nodes)))
    kept = np.zeros(len(order), bool)
    for i, x, y in zip(range(len(order)), at[:len(ca)][order].tolist(), at[len(ca):][order].tolist()):
        x, y = _find(parent, x), _find(parent, y)
        if x != y:
            parent[x] = y
            kept[i] = True
    order = order[kept]
    return pa.table({"a": pa.array(a[order]), "b": pa.array(b[order]), "w": pa.array(w[order])})


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The shortest spanning trees of a graph (a, b, w), ties by a and b.

    A round takes the shortest edge of every component, follows the hooks to one root, and
    keeps the shortest edge between each two components. Once IN_ONE_TASK edges are left
    at most, one task takes the rest.
    """
    live = written(edges.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")), "density_edges")
    kind, chosen = "a long, b long, w double", []
    while True:
        n = live.count()
        if n <= IN_ONE_TASK:
            if n:
                chosen.append(written(_alone(live, _kruskal, kind), "density_tree"))
            break
        both = live.unionByName(live.select("a", "b", "w", F.col("cb").alias("ca"), F.col("ca").alias("cb")))
        hooks = written(both.groupBy(F.col("ca").alias("node")).agg(F.min(F.struct("w", "a", "b", "cb")).alias("m")), "density_hooks")
        chosen.append(written(hooks.select("m.a", "m.b", "m.w").distinct(), "density_tree"))
        back = hooks.select(F.col("node").alias("cb"), F.col("m.cb").alias("back"))
        own = hooks.select("node", F.col("m.cb").alias("cb")).join(back, "cb")
        root = F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("cb")), F.col("node")).otherwise(F.col("cb"))
        ways = written(own.select("node", root.alias("to")), "density_ways")
        while True:
            ahead = ways.select(F.col("node").alias("to"), F.col("to").alias("next"))
            longer = written(ways.join(ahead, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "density_ways")
            removed(ways)
            ways, moved = longer, longer.where("moved").isEmpty()
            if moved:
                break
        at = lambda c: ways.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        kept = live.join(at("ca"), "ca").join(at("cb"), "cb").where("ca_to <> cb_to")
        kept = kept.groupBy(F.least("ca_to", "cb_to").alias("ca"), F.greatest("ca_to", "cb_to").alias("cb")).agg(
            F.min(F.struct("w", "a", "b")).alias("m")).select("m.a", "m.b", "m.w", "ca", "cb")
        after = written(kept, "density_edges")
        removed(live, hooks, ways)
        live = after
    removed(live)
    out = edges.sparkSession.createDataFrame([], kind)
    for part in chosen:
        out = out.unionByName(part)
    return out


STATE = "root long, size long, cluster long, lam_sum double, lam_max double, inner double"
EVENTS = f"kind int, {STATE}, to long, lam double, parent long, stability double, candidate boolean"


def _merge(band: int, least: int):
    """Merges the edges of a band, shortest first, among the components it touches."""
    def run(table: pa.Table) -> pa.Table:
        is_edge = table.column("ra").is_valid().to_numpy()
        known, edges = table.filter(pa.array(~is_edge)), table.filter(pa.array(is_edge))
        w, a, b, ra, rb = (edges.column(c).to_numpy() for c in ("w", "a", "b", "ra", "rb"))
        order = np.lexsort((rb, ra, b, a, w))
        old = np.unique(np.concatenate([ra, rb]))
        ends = zip(w[order].tolist(), np.searchsorted(old, ra[order]).tolist(), np.searchsorted(old, rb[order]).tolist())
        # Of each component, by its place in old: size, cluster (-1 for none), sum of lambdas, largest lambda, best of the clusters inside.
        n = len(old)
        size, own = np.ones(n, np.int64), np.full(n, -1, np.int64)
        lam_sum, lam_max, inner = np.zeros(n), np.zeros(n), np.zeros(n)
        at = np.searchsorted(old, known.column("root").to_numpy())
        for column, name in ((size, "size"), (lam_sum, "lam_sum"), (lam_max, "lam_max"), (inner, "inner")):
            column[at] = known.column(name).to_numpy()
        own[at] = known.column("cluster").fill_null(-1).to_numpy()
        size, own, lam_sum, lam_max, inner = (x.tolist() for x in (size, own, lam_sum, lam_max, inner))
        parent, alive = list(range(n)), np.ones(n, bool)
        # Old roots whose points are in no cluster yet, in chains; -1 ends one and stands for none.
        first, last, after = list(range(n)), list(range(n)), [-1] * n
        left, left_at = np.full(n, -1, np.int64), np.zeros(n)
        clusters, number = [], band << 32

        def fall(x, cluster, lam):
            at = first[x]
            while at >= 0:
                left[at], left_at[at] = cluster, lam
                at = after[at]
            first[x] = last[x] = -1

        for weight, x, y in ends:
            x, y = _find(parent, x), _find(parent, y)
            lam = 1.0 / weight
            if size[x] < size[y]:
                x, y = y, x
            both = size[x] + size[y]
            if own[x] >= 0 and own[y] >= 0:
                best = 0.0
                for root in (x, y):
                    stability = lam_sum[root] - size[root] * lam
                    clusters.append((own[root], number, stability, stability >= inner[root], lam_max[root]))
                    best += max(stability, inner[root])
                own[x], lam_sum[x], lam_max[x], inner[x] = number, both * lam, lam, best
                number += 1
            elif own[x] >= 0:
                fall(y, own[x], lam)
                lam_sum[x] += size[y] * lam
            elif both >= least:
                fall(x, number, lam)
                fall(y, number, lam)
                own[x], lam_sum[x], lam_max[x], inner[x] = number, both * lam, lam, 0.0
                number += 1
            size[x], parent[y], alive[y] = both, x, False
            if first[y] >= 0:
                if first[x] < 0:
                    first[x] = first[y]
                else:
                    after[last[x]] = first[y]
                last[x] = last[y]
        gone, stay = left < 0, np.flatnonzero(alive)
        to = old[[_find(parent, x) for x in range(n)]] if n else old
        pick = lambda values, kind: pa.array(np.array(values, kind)[stay])
        own = np.array(own, np.int64)[stay]
        ended = list(zip(*clusters)) or [()] * 5
        parts = [
            {"kind": np.zeros(n, np.int32), "root": old, "to": to, "cluster": pa.array(left, mask=gone), "lam": pa.array(left_at, mask=gone)},
            {"kind": np.ones(len(stay), np.int32), "root": old[stay], "size": pick(size, np.int64), "cluster": pa.array(own, mask=own < 0),
             "lam_sum": pick(lam_sum, float), "lam_max": pick(lam_max, float), "inner": pick(inner, float)},
            {"kind": np.full(len(clusters), 2, np.int32), **dict(zip(("cluster", "parent", "stability", "candidate", "lam_max"), ended))}]
        types = {"kind": pa.int32(), "root": pa.int64(), "size": pa.int64(), "cluster": pa.int64(), "lam_sum": pa.float64(), "lam_max": pa.float64(),
                 "inner": pa.float64(), "to": pa.int64(), "lam": pa.float64(), "parent": pa.int64(), "stability": pa.float64(), "candidate": pa.bool_()}
        whole = lambda part, c, t: pa.array(part[c], t) if c in part else pa.nulls(len(part["kind"]), t)
        return pa.concat_tables([pa.table({c: whole(part, c, t) for c, t in types.items()}) for part in parts])

    return run


def condensed(tree: DataFrame, points: DataFrame, min_cluster: int) -> tuple[DataFrame, DataFrame]:
    """(node, cluster, lam) where each point leaves the condensed tree, and its (cluster, parent, stability, candidate, lam_max).

    A candidate is at least as stable as the best clusters inside it together. A root that
    spans all points is no candidate; roots of several trees are born at lambda 0.
    """
    n = tree.count()
    bands = max(1, -(-n // IN_ONE_TASK))
    ordered = tree.repartitionByRange(bands, "w", "a", "b") if bands > 1 else tree.repartition(1)
    edges = written(ordered.withColumn("band", F.spark_partition_id()), "density_bands")
    spark = tree.sparkSession
    nodes = written(points.select("node", F.col("node").alias("root"), F.lit(None).cast("long").alias("cluster"),
                                  F.lit(None).cast("double").alias("lam")), "density_nodes")
    state, clusters = spark.createDataFrame([], STATE), None
    for band in range(bands if n else 0):
        at = lambda c: nodes.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        own = edges.where(F.col("band") == band).select("a", "b", "w").join(at("a"), "a").join(at("b"), "b")
        own = written(own, "density_band")
        touched = own.select(F.col("ra").alias("root")).union(own.select("rb")).distinct()
        both = own.unionByName(state.join(touched, "root", "left_semi"), allowMissingColumns=True)
        events = written(_alone(both, _merge(band, min_cluster), EVENTS), "density_events")
        moves = events.where("kind = 0").select("root", "to", F.col("cluster").alias("left"), F.col("lam").alias("at"))
        after = nodes.join(moves, "root", "left").select(
            "node", F.coalesce("to", "root").alias("root"), F.coalesce("cluster", "left").alias("cluster"), F.coalesce("lam", "at").alias("lam"))
        after, stay = written(after, "density_nodes"), state.join(touched, "root", "left_anti")
        state = written(stay.unionByName(events.where("kind = 1").select("root", "size", "cluster", "lam_sum", "lam_max", "inner")), "density_state")
        ended = events.where("kind = 2").select("cluster", "parent", "stability", "candidate", "lam_max")
        clusters = ended if clusters is None else clusters.unionByName(ended)
        removed(nodes, own)
        nodes = after
    roots = state.where("cluster IS NOT NULL").select(
        "cluster", F.lit(None).cast("long").alias("parent"), F.col("lam_sum").alias("stability"),
        ((F.col("lam_sum") >= F.col("inner")) & (F.col("size") < points.count())).alias("candidate"), "lam_max")
    return nodes.select("node", "cluster", "lam"), written(roots if clusters is None else clusters.unionByName(roots), "density_clusters")


def chosen_clusters(clusters: DataFrame) -> DataFrame:
    """(cluster, topic_cluster, lam_top): the topmost candidate among a cluster and those around it, null if none."""
    best = F.when(F.col("candidate"), F.struct(F.col("cluster").alias("id"), F.col("lam_max").alias("lam")))
    ways = written(clusters.select("cluster", F.col("parent").alias("up"), best.alias("best")), "density_up")
    while not ways.where("up IS NOT NULL").isEmpty():  # doubling: the path above is twice as long each time
        ahead = ways.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("best").alias("higher"))
        after = written(ways.join(ahead, "up", "left").select("cluster", F.col("next").alias("up"), F.coalesce("higher", "best").alias("best")), "density_up")
        removed(ways)
        ways = after
    return ways.select("cluster", F.col("best.id").alias("topic_cluster"), F.col("best.lam").alias("lam_top"))


def density_topics(df: DataFrame, vector: str, key: str = "review_id", min_cluster: int = 10, min_samples: int | None = None,
                   neighbours: int = 15, unit: bool = False, seed: int = 42) -> DataFrame:
    """Topics by density: key, topic (ids by size from 0, -1 for outliers) and prob (0 to 1).

    Equal vectors are one point of weight one and share their topic. ``min_samples`` (``min_cluster``
    if not given) neighbours make a core distance; the graph joins each point with its ``neighbours``
    or ``min_samples`` nearest, whichever are more. The probability is the share of the
    cluster's largest density that the point reaches. Vectors that are null, empty or hold
    null or non-finite entries are outliers, with ``unit`` also zero vectors; so are all if there are no clusters. With ``unit``
    vectors are scaled to length one first. Lengths must agree.
    """
    min_samples = min_samples or min_cluster
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))) & (F.size(vector) > 0)
    values = F.col(vector).cast("array<double>")
    if unit:
        length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, c: s + c * c))
        values = F.when(length > 0, F.transform(values, lambda c: c / length))
    rows = df.select(key, F.when(good, values).alias("v"))
    different = written(rows.where("v IS NOT NULL").select("v").distinct(), "density_vectors")
    points = written(different.withColumn("node", F.monotonically_increasing_id()), "density_points")
    pairs = written(nearest_pairs(points, max(neighbours, min_samples), seed), "density_pairs")
    tree = spanning_forest(reachability(pairs, min_samples))
    leaves, clusters = condensed(tree, points, min_cluster)
    named = leaves.join(chosen_clusters(clusters), "cluster").where("topic_cluster IS NOT NULL").select(
        "node", "topic_cluster", F.least(F.lit(1.0), F.col("lam") / F.col("lam_top")).alias("p"))
    placed = written(rows.join(points.join(named, "node").select("v", "topic_cluster", "p"), "v", "left").select(key, "topic_cluster", "p"), "density_rows")
    removed(different, points, pairs, clusters)
    sizes = placed.where("topic_cluster IS NOT NULL").groupBy("topic_cluster").agg(F.count("*").alias("n"))
    # One row a cluster.
    ids = sizes.select("topic_cluster", (F.row_number().over(Window.orderBy(F.desc("n"), "topic_cluster")) - 1).alias("topic"))
    return placed.join(ids, "topic_cluster", "left").select(
        key, F.coalesce("topic", F.lit(-1)).alias("topic"), half_even(F.coalesce("p", F.lit(0.0)), 4).alias("prob"))

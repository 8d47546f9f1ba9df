"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersections of sorted arrays.

How a linked pair of different sets is sure to meet: with similarity at least num/den
two sets of sizes a and b differ in at most d = (den - num)(a + b)/(den + num)
elements. Both are cut into the same 2**q parts by the leading bits of the element hash.
Of any d + 1 + e parts at least 1 + e agree, so each set posts a hash of its first
d + 1 + e parts and two linked sets share a posting. Empty parts are posted only by sets
with more than e of them. q follows from the size; a set near a limit posts for both.

Sets that share a posting form a group, cut by size into bands no wider than the ratio
two linked sizes can have and, where many, into blocks; a tile is a pair of blocks. In a
tile, bit counts of hashed bitmaps bound each overlap from above; only pairs that the
bound lets through are intersected. Texts with equal sets are one node. Before the
tiles, members of a group are compared with one leader, and groups that are one
component already have nothing left to tell; nor has a group with the members of another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import words as W
from tideline.llm.tables import bits_hold, components, forget, id_bits, map_groups, maybe_in, saved
from tideline.session import shuffles_removed

BLOCK = 512
SPANNING_ROUNDS = 2
TILE_ROWS, TILE_SHARE = 1_000_000, 4  # rows of tiles, with bitmaps, that are dealt at once: so many, or so many for each set
MAP_BYTES = 2  # bytes of bitmap for each part: some bits for each element
_MOST_BITS = 40


def _limits(num: int, den: int, sizes: np.ndarray) -> np.ndarray:
    """One more than the elements in which a set of this size and a linked one can differ."""
    return (den - num) * (sizes + sizes * den // num) // (den + num) + 1


def _spare(q: np.ndarray) -> np.ndarray:
    return 1 + (1 << q) // 32


def _part_bits(need: np.ndarray) -> np.ndarray:
    room = np.array([(1 << q) - int(_spare(np.int64(q))) for q in range(_MOST_BITS)], np.int64)
    return np.searchsorted(room, need).astype(np.int64)


def _shingles(data, offsets, k) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and their bounds."""
    words = W.words_of(data, offsets, lower=True)
    hashes, begin = words.windows(words.hashes(), k, short=True)
    return W.sorted_sets(hashes, np.searchsorted(begin, words.first))


def _postings(sets, bounds, q, limit, rows):
    """(posting, row) of the first ``limit`` parts of 2**q of the sets of ``rows``."""
    sizes = np.diff(bounds)[rows]
    values = W.gather(sets, bounds[:-1][rows], sizes)
    owner = np.repeat(np.arange(len(rows)), sizes)
    part = (values >> (64 - q).astype(np.uint64)[owner]).astype(np.int64)
    inside = part < limit[owner]
    values, owner, part = values[inside], owner[inside], part[inside]
    base = np.concatenate([[0], np.cumsum(limit)])
    cell = base[owner] + part
    cuts = np.searchsorted(cell, np.arange(base[-1] + 1))
    sums = W.segment_sums(W.mix(values) + np.uint64(1), cuts)
    filled = np.diff(cuts) > 0
    holder = np.repeat(np.arange(len(rows)), limit)
    empties = np.bincount(holder[~filled], minlength=len(rows))
    post = filled | (empties > _spare(q))[holder]
    place = (np.arange(base[-1]) - base[:-1][holder]).astype(np.uint64) + (q.astype(np.uint64) << np.uint64(56))[holder]
    return W.mix(sums ^ W.mix(place))[post], rows[holder][post]


def shingle_postings(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n (set size), d1 and d2 (digest of the set), posts (what linked sets have in common)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column("text"), W.SMALL_BYTES):
                sets, bounds = _shingles(data, offsets, k)
                sizes = np.diff(bounds)
                scrambled = W.mix(sets)
                need = _limits(num, den, sizes)
                rows = np.flatnonzero(need > 1)  # below, only equal sets are linked
                own = _part_bits(need[rows])
                least = _part_bits(_limits(num, den, (sizes[rows] * num + den - 1) // den))
                found, holders = [], []
                for step in range(int((own - least).max(initial=0)) + 1):
                    at = own - least >= step
                    q = own[at] - step
                    limit = np.minimum(need[rows[at]] + _spare(q), 1 << q)
                    posts, holder = _postings(sets, bounds, q, limit, rows[at])
                    found.append(posts)
                    holders.append(holder)
                posts, holder = np.concatenate(found), np.concatenate(holders)
                order = np.argsort(holder, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(holder, minlength=hi - lo))])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo), W.longs(sizes),
                    W.longs(W.segment_sums(scrambled, bounds)),
                    W.longs(W.segment_sums(W.mix(scrambled ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds)),
                    W.lists(posts[order].view(np.int64), ends, pa.int64()),
                ], ["doc_id", "n", "d1", "d2", "posts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, posts array<long>")


def shingle_sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n, band, and a bitmap of 2 * 2**q bytes, which stands for the set until a pair needs it."""
    log_ratio = np.log(den / num * 1.001)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column("text"), W.SMALL_BYTES):
                sets, bounds = _shingles(data, offsets, k)
                sizes = np.diff(bounds)
                width = MAP_BYTES << _part_bits(_limits(num, den, sizes))
                maps = []
                for i in range(hi - lo):
                    bits = np.zeros(int(width[i]), np.uint8)
                    own = sets[bounds[i]:bounds[i + 1]]
                    np.bitwise_or.at(bits, (own >> np.uint64(3)).astype(np.int64) & (int(width[i]) - 1),
                                     np.left_shift(1, (own & np.uint64(7)).astype(np.int64)).astype(np.uint8))
                    maps.append(bits.tobytes())
                band = np.floor(np.log(np.maximum(sizes, 1)) / log_ratio)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo), W.longs(sizes), W.longs(band), pa.array(maps, pa.binary()),
                ], ["doc_id", "n", "band", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, band long, bits binary")


def sets_of_pairs(docs: DataFrame, k: int, pairs: DataFrame) -> DataFrame:
    """doc_id and sorted set of the documents that may occur in pairs (a, b), a written table.

    Few do, so their sets are made again from the texts, which costs less than to keep those of all.
    """
    met = id_bits(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))), "a")
    held = docs.sparkSession.sparkContext.broadcast(met)

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(bits_hold(batch.column("doc_id"), held.value)))
            for lo, hi, data, offsets in W.slices(batch.column("text"), W.SMALL_BYTES):
                sets, bounds = _shingles(data, offsets, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), W.lists(sets.view(np.int64), bounds, pa.int64())], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that the bit counts of their bitmaps cannot rule out."""
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            nx, ny = (batch.column(c).to_pylist() for c in ("nx", "ny"))
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                x, y = (_fold(bits, min(len(x), len(y))) for bits in (x, y))
                own, other, both = (int(np.bitwise_count(bits).sum(dtype=np.int64)) for bits in (x, y, x & y))
                most = min(nx[i] - (own - both), ny[i] - (other - both))
                keep[i] = (num + den) * most >= num * (nx[i] + ny[i])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    side = lambda c, n, x: sets.select(F.col("doc_id").alias(c), F.col("n").alias(n), F.col("bits").alias(x))
    both = pairs.join(side("b", "ny", "y"), "b").join(side("a", "nx", "x"), "a")
    return both.select("a", "b", "nx", "ny", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b), a written table, whose sets are similar enough, by exact intersection."""
    sets = sets_of_pairs(docs, k, pairs)

    def run(batches):
        for batch in batches:
            left, right = batch.column("x"), batch.column("y")
            la, ra = (c.offsets.to_numpy() for c in (left, right))
            lv, rv = (c.values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (left, right))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, r = lv[la[i]:la[i + 1]], rv[ra[i]:ra[i + 1]]
                shared = np.count_nonzero(r[np.minimum(np.searchsorted(r, p), len(r) - 1)] == p) if len(r) else 0
                keep[i] = den * shared >= num * (len(p) + len(r) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    own = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    both = own.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _fold(bits: bytes, width: int) -> np.ndarray:
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, width), axis=0)


def _tile_pairs(rows: pa.Table, num: int, den: int, spanning: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of different roots in a tile that the bit counts cannot rule out.

    With ``spanning`` two roots once paired count as one, so that a tile gives fewer pairs
    than it has rows; pairs skipped on a promise that fails come up in the next round.
    """
    ids, n, root, home, block = (rows.column(c).to_numpy() for c in ("doc_id", "n", "root", "home", "block"))
    raw, failed = rows.column("bits").to_pylist(), rows.column("failed").to_pylist()
    width = min(map(len, raw))
    bits = np.stack([_fold(b, width) for b in raw]).view(np.uint64)
    crossed = block.min() != block.max()
    root = root.copy()
    out_a, out_b = [], []
    for i in range(len(ids) - 1):
        later = i + 1 + np.flatnonzero((root[i + 1:] != root[i]) & (home[i] | home[i + 1:]))
        if crossed:
            later = later[block[later] != block[i]]
        if failed[i]:
            later = later[~np.isin(ids[later], failed[i])]
        if not len(later):
            continue
        both = np.bitwise_count(bits[i] & bits[later]).sum(axis=1, dtype=np.int64)
        own, other = int(np.bitwise_count(bits[i]).sum()), np.bitwise_count(bits[later]).sum(axis=1, dtype=np.int64)
        most = np.minimum(n[i] - (own - both), n[later] - (other - both))
        spare = (num + den) * most - num * (n[i] + n[later])
        near, spare = later[spare >= 0], spare[spare >= 0]
        while len(near):
            taken = near[[np.argmax(spare)]] if spanning else near
            out_a.append(np.minimum(ids[i], ids[taken]))
            out_b.append(np.maximum(ids[i], ids[taken]))
            if not spanning:
                break
            root[root == root[taken[0]]] = root[i]
            rest = root[near] != root[i]
            near, spare = near[rest], spare[rest]
    if out_a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])


def tile_candidates(grouped: DataFrame, sets: DataFrame, num: int, den: int, failed: DataFrame | None = None,
                    spanning: bool = False, block: int = BLOCK) -> DataFrame:
    """Candidate pairs (a, b) of different roots from groups (post, doc_id, root), without those of ``failed``.

    A band meets itself and the next: a tile holds a band's sets and, as guests, those one
    band above. Tiles of more than ``block`` sets become tiles of pairs of blocks.
    """
    rows = grouped.join(sets.select("doc_id", "n", "band"), "doc_id")
    rows = rows.select("post", "doc_id", "root", "n", F.inline(F.array(
        F.struct(F.col("band").alias("tile"), F.lit(True).alias("home")),
        F.struct((F.col("band") - 1).alias("tile"), F.lit(False).alias("home")))))
    rows = held_rows = saved(rows, "tile_rows")
    counts = rows.groupBy("post", "tile").agg(
        F.count("*").alias("rows"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("home").alias("homes"))
    counts = counts.where("r0 <> r1 AND homes").select("post", "tile", F.ceil(F.col("rows") / block).alias("blocks"))
    rows = rows.join(counts, ["post", "tile"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).withColumns({
        "i": F.least("block", "other"), "j": F.greatest("block", "other")})
    held = sets.select("doc_id", "bits")
    if failed is None:
        held = held.withColumn("failed", F.array().cast("array<long>"))
    else:
        both = failed.unionByName(failed.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lists = both.groupBy(F.col("a").alias("doc_id")).agg(F.collect_list("b").alias("failed"))
        held = held.join(lists, "doc_id", "left").withColumn("failed", F.coalesce("failed", F.array().cast("array<long>")))
    rows = rows.join(held, "doc_id")
    keyed = rows.select("post", "tile", "i", "j", "doc_id", "n", "root", "home", "block", "bits", "failed")
    found = map_groups(keyed, ["post", "tile", "i", "j"], lambda t: _tile_pairs(t, num, den, spanning), "a long, b long")
    found = found.where("a <> b").distinct()
    found.backing = [held_rows]
    return found


def candidates_by_parts(rooted: DataFrame, sets: DataFrame, num: int, den: int, failed: DataFrame | None, spanning: bool) -> DataFrame:
    """The pairs of :func:`tile_candidates` as a written table, a part of the groups after the other.

    Rows of tiles may grow faster than the texts; only those of a part are on disk at a time.
    """
    with shuffles_removed(rooted.sparkSession):
        n = F.col("count")
        rows = rooted.groupBy("post").count().agg(F.sum(2 * n * F.ceil(n / BLOCK))).first()[0] or 0  # home and guests
        parts = max(1, -(-rows // max(TILE_ROWS, TILE_SHARE * sets.count())))
    found = []
    for part in range(parts):
        own = rooted if parts == 1 else rooted.where(F.pmod(F.xxhash64("post"), F.lit(parts)) == part)
        pairs = tile_candidates(own, sets, num, den, failed, spanning)
        found.append(saved(pairs, "candidates"))
        forget(*pairs.backing)
    if parts == 1:
        return found[0]
    whole = found[0]
    for table in found[1:]:
        whole = whole.unionByName(table)
    whole = saved(whole.distinct(), "candidates")
    forget(*found)
    return whole


def _spread(table: DataFrame, without: np.ndarray | None, posts: np.ndarray | None) -> DataFrame:
    """(post, doc_id) of the rows whose digest ``without`` does not hold, of posts that ``posts`` may hold."""
    skip, keep = (table.sparkSession.sparkContext.broadcast(b) for b in (without, posts))

    def run(batches):
        for batch in batches:
            if skip.value is not None:
                batch = batch.filter(pa.array(~bits_hold(batch.column("d1"), skip.value)))
            lists = batch.column("posts")
            post = lists.flatten()
            doc = pa.array(np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())))
            out = pa.RecordBatch.from_arrays([post, doc], ["post", "doc_id"])
            yield out if keep.value is None else out.filter(pa.array(bits_hold(post, keep.value)))

    return table.select("d1", "doc_id", "posts").mapInArrow(run, "post long, doc_id long")


def _still_open(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Groups (post, doc_id, root) that the links have not made one component."""
    roots = components(links, "near")
    named = shared.select("post", "doc_id").join(roots.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    named = saved(named.select("post", "doc_id", F.coalesce("component", "doc_id").alias("root")), "named_groups")
    left = saved(_open_groups(named), "rooted")
    forget(named, *roots.backing)
    return left


def _unsettled(rooted: DataFrame, wrong: DataFrame) -> DataFrame:
    """Rows (post, doc_id, root) of the groups that hold both ends of a pair that was proposed wrongly.

    In all other groups every pair was ruled out, or joined by proposals that held.
    """
    at = rooted.select("post", F.col("doc_id").alias("a")).join(wrong, "a").select("post", F.col("b").alias("doc_id"))
    return rooted.join(rooted.join(at, ["post", "doc_id"], "left_semi").select("post").distinct(), "post", "left_semi")


def _open_groups(rooted: DataFrame) -> DataFrame:
    """Groups that are not yet one component; of several with the same members, one."""
    groups = rooted.groupBy("post").agg(
        F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("y"))
    chosen = groups.where("r0 <> r1").groupBy("size", "x", "y").agg(F.min("post").alias("post"))
    return rooted.join(chosen.select("post"), "post", "left_semi")


def _with_leaders(ranked: DataFrame) -> DataFrame:
    """For each document, a pair with the leader it shares most groups with; leaders rank highest in a group."""
    lead = ranked.groupBy("post").agg(F.max(F.struct("rank", "doc_id", "root")).alias("lead"))
    lead = lead.select("post", F.col("lead.doc_id").alias("leader"), F.col("lead.root").alias("lead_root"))
    pairs = ranked.join(lead, "post").where("root <> lead_root").groupBy("doc_id", "leader").count()
    best = pairs.groupBy("doc_id").agg(F.max(F.struct("count", "leader"))["leader"].alias("leader"))
    return best.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id.

    Two documents link when their sets of k-word shingles (words lower-cased in A-Z; fewer
    words count as one shingle) have intersection/union of at least num/den; a component
    is named by its smallest doc_id. Null or empty texts have no shingles and stay alone.
    Rows sharing a doc_id are one node. Rows without doc_id are returned, link with
    nothing and have no component. Other columns are not read; ``docs`` is read again for each
    set of pairs, so it should be a table.
    """
    table = saved(shingle_postings(docs, k, num, den), "postings")
    whole = table.where("n > 0 AND doc_id IS NOT NULL")
    nodes = saved(whole.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")), "nodes")
    copied = id_bits(nodes.where("rows > 1"), "d1")
    once = maybe_in(whole, "d1", copied).join(nodes, ["n", "d1", "d2", "doc_id"], "left_semi").select("d1", "doc_id", "posts")
    once = once.dropDuplicates(["doc_id", "d1"])
    spread = lambda posts=None: _spread(whole, copied, posts).unionByName(_spread(once, None, posts))
    groups = saved(spread().groupBy("post").agg(F.count("*").alias("size")).where("size > 1"), "groups")
    shared = saved(spread(id_bits(groups, "post")).join(groups, "post").distinct(), "shared")
    before, table = table, saved(table.drop("posts"), "digests")
    forget(groups, before)

    known = id_bits(shared, "doc_id")
    wanted = maybe_in(docs.select("doc_id", "text"), "doc_id", known)
    sets = saved(shingle_sets(wanted.join(shared.select("doc_id").distinct(), "doc_id", "left_semi"), k, num, den), "maps")
    popular = shared.groupBy("doc_id").agg(F.sum("size").alias("rank"))  # the original of a family shares most
    ranks = [popular, popular.select("doc_id", F.xxhash64("doc_id").alias("rank"))]
    rooted = shared.select("post", "doc_id", F.col("doc_id").alias("root"))
    links = None
    for rank in ranks:
        pairs = saved(possible(_with_leaders(rooted.join(rank, "doc_id")), sets, num, den), "leaders")
        near = saved(verified(pairs, docs, k, num, den), "near")
        forget(pairs)
        before, links = links, near if links is None else saved(links.unionByName(near), "links")
        if before is not None:
            forget(before, near)
        before, rooted = rooted, _still_open(shared, links)
        if hasattr(before, "scratch"):
            forget(before)
    failed = None
    for turn in range(SPANNING_ROUNDS + 1):
        spanning = turn < SPANNING_ROUNDS
        candidates = candidates_by_parts(rooted, sets, num, den, failed, spanning)
        if candidates.isEmpty():
            break
        found = saved(verified(candidates, docs, k, num, den), "found")
        before, links = links, saved(links.unionByName(found), "links")
        forget(before)
        if not spanning:
            break
        wrong = saved(candidates.join(found, ["a", "b"], "left_anti"), "wrong")
        before, failed = failed, wrong if failed is None else saved(failed.unionByName(wrong), "failed")
        forget(candidates, found)
        opened = _still_open(shared, links)
        last, rooted = rooted, saved(_unsettled(opened.join(rooted.select("post").distinct(), "post", "left_semi"), wrong), "rooted")
        forget(opened, last, *([] if before is None else [before, wrong]))

    final = components(links, "linked")
    linked = final.select(F.col("node").alias("doc_id"), "component")
    named = nodes.join(linked, "doc_id", "left").select(
        "n", "d1", "d2", F.coalesce("component", "doc_id").alias("component"))
    named = saved(named, "named")
    out = table.select("doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    out = saved(out.select("doc_id", F.col("n").alias("n_shingles"),
                           F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")), "jaccard")
    forget(table, nodes, shared, sets, links, rooted, named, *final.backing)
    return out

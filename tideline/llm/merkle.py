"""Merkle manifest of a table: one tree a group, one tree over the groups' roots, and proofs.

A tree has a fan of eight; its levels are hashes of runs of up to eight nodes. Leaves are
cut into aligned blocks of 8**HEIGHT; a block is a subtree, built by one task and kept as
one array in van Emde Boas layout: a subtree is split at half its height, the upper part
comes first and the lower parts follow, each laid out in the same way. Addresses follow
from depth and index alone and serve construction and the search for siblings. The roots
of blocks are the leaves of the next round of blocks, until one node is left.

Proofs go the other way: each round hands every block the siblings above its root, so a
document's proof is read from its own block and that one row.
"""

from __future__ import annotations

import binascii
import struct
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.tables import forget, map_groups, saved

FAN = 8
HEIGHT = 4  # levels of a block above its leaves: 4,096 leaves
DIGEST = 32


def subtree_size(levels: int) -> int:
    return (FAN ** levels - 1) // (FAN - 1)


def addresses(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of a depth (0 is the root) in the layout of a tree of so many levels."""
    at = np.zeros(len(index), np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        below, step = levels - upper, FAN ** (depth - upper)
        at += subtree_size(upper) + (index // step) * subtree_size(below)
        index, depth, levels = index % step, depth - upper, below
    return at


def levels_needed(size: int) -> int:
    """Levels above ``size`` leaves until one node is left."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FAN), levels + 1
    return levels


def block_height(size: int) -> int:
    """Height of the blocks of a tree of ``size`` leaves."""
    return min(HEIGHT, levels_needed(size)) if size <= FAN ** HEIGHT else HEIGHT


def digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def build_block(leaves: list[bytes], height: int) -> np.ndarray:
    """Hex digests of a block in van Emde Boas layout; places without a node are empty."""
    nodes = np.zeros(subtree_size(height + 1), "S64")
    level = leaves
    for depth in range(height, -1, -1):
        nodes[addresses(height + 1, depth, np.arange(len(level)))] = level
        if depth:
            level = [digest(b"".join(level[i:i + FAN])) for i in range(0, len(level), FAN)]
    return nodes


def sibling_path(nodes: np.ndarray, height: int, leaves: int) -> list[list[tuple[bytes, bytes]]]:
    """For each depth from the leaves up, for each of its nodes: the siblings before and after it, joined."""
    out = []
    for depth in range(height, 0, -1):
        hexes = nodes[addresses(height + 1, depth, np.arange(leaves))].tolist()
        row = []
        for lo in range(0, leaves, FAN):
            run = hexes[lo:lo + FAN]
            row += [(b"".join(run[:k]), b"".join(run[k + 1:])) for k in range(len(run))]
        out.append(row)
        leaves = -(-leaves // FAN)
    return out


def pack_path(steps: list[tuple[bytes, bytes]]) -> bytes:
    """Siblings of every level on the way up as one binary: two lengths, then the digests."""
    return b"".join(struct.pack("<HH", len(a) // 64, len(b) // 64) + binascii.unhexlify(a + b) for a, b in steps)


def unpack_path(path: bytes) -> list[tuple[bytes, bytes]]:
    steps, at = [], 0
    while at < len(path):
        before, after = struct.unpack_from("<HH", path, at)
        hexes = binascii.hexlify(path[at + 4:at + 4 + DIGEST * (before + after)])
        steps.append((hexes[:64 * before], hexes[64 * before:]))
        at += 4 + DIGEST * (before + after)
    return steps


def fold(node: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and its siblings lead to."""
    for before, after in steps:
        node = digest(before + node + after)
    return node


def row_hash(columns: list[Column | str]) -> Column:
    """Hex digest of a row: each value as its byte count, a colon and its text; a null as a dash."""
    def part(c):
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in columns]).cast("binary"), 256)


def lower_ascii(text: str) -> Column:
    """Text with A-Z in lower case and nothing else changed."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


def numbered(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """rows with pos (0, 1, ... by ``order`` within each ``by``, nulls first) and size (of the group).

    Rows are dealt by range, so one group may fill many partitions; equal rows are dealt
    too. The sorted rows are written, and places follow from counts a partition.
    """
    tie = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = tie.repartitionByRange(by, *order, "__tie").sortWithinPartitions(by, *order, "__tie").drop("__tie")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = saved(dealt.select("*", F.spark_partition_id().alias("__part"), at.alias("__at")), name)
    counts = held.groupBy(by, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__lo"))
    group = Window.partitionBy(by)
    counts = counts.select(
        F.col(by).alias("__by"), F.col("__part").alias("__p"), "__lo",
        (F.sum("__n").over(group.orderBy("__part")) - F.col("__n")).alias("__before"), F.sum("__n").over(group).alias("size"))
    placed = held.join(counts, (F.col("__part") == F.col("__p")) & F.col(by).eqNullSafe(F.col("__by")))
    return placed.select(*rows.columns, (F.col("__before") + F.col("__at") - F.col("__lo")).alias("pos"), "size")


BLOCK = "tree long, block long, size long, root binary, nodes binary"


def _blocks(leaves: DataFrame) -> DataFrame:
    """Blocks of (tree, pos, size, digest): a row each with its layout and root."""
    def work(table):
        pos = table.column("pos").to_numpy()
        size = table.column("size")[0].as_py()
        digests = table.column("digest").to_pylist()
        nodes = build_block([binascii.hexlify(digests[i]) for i in np.argsort(pos)], block_height(size))
        packed = binascii.unhexlify(b"".join(n or b"0" * 64 for n in nodes.tolist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([table.column("tree")[0].as_py()]), pa.array([table.column("block")[0].as_py()]), pa.array([size]),
             pa.array([packed[:DIGEST]]), pa.array([packed])], ["tree", "block", "size", "root", "nodes"])

    rows = leaves.select("tree", F.expr(f"pos div {FAN ** HEIGHT}").alias("block"), "pos", "size", "digest")
    return map_groups(rows, ["tree", "block"], work, BLOCK)


def forest(leaves: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks, lowest first, and (tree, root), from (tree, pos, size, digest)."""
    tables, roots, per = [], None, FAN ** HEIGHT
    most = leaves.agg(F.max("size")).first()[0] or 0
    while True:
        table = saved(_blocks(leaves), name)
        tables.append(table)
        ended = table.where(F.col("size") <= per).select("tree", "root")
        roots = ended if roots is None else roots.unionByName(ended)
        if most <= per:
            return tables, roots
        leaves = table.where(F.col("size") > per).select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("size") / per).alias("size"), F.col("root").alias("digest"))
        most = -(-most // per)


PATH = "tree long, pos long, path binary, root binary"


def _nodes(row, height):
    return np.frombuffer(binascii.hexlify(row), "S64")[:subtree_size(height + 1)]


def _paths_down(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, pos, path, root) of the lowest blocks, from the paths (tree, path, root) of whole trees."""
    per = FAN ** HEIGHT

    def expand(batches):
        for batch in batches:
            for tree, block, size, nodes, path, root in zip(*(batch.column(c).to_pylist() for c in (
                    "tree", "block", "size", "nodes", "path", "root"))):
                height, held = block_height(size), min(per, size - block * per)
                local = sibling_path(_nodes(nodes, height), height, held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * held), pa.array(range(block * per, block * per + held), pa.int64()),
                     pa.array([pack_path([level[i // FAN ** d] for d, level in enumerate(local)]) + path for i in range(held)]),
                     pa.array([root] * held)], ["tree", "pos", "path", "root"])

    paths = None
    for table in reversed(tables):
        ended = table.where(F.col("size") <= per).drop("root").join(above, "tree").select("tree", "block", "size", "nodes", "path", "root")
        if paths is not None:
            inner = table.where(F.col("size") > per).drop("root").join(
                paths.withColumnRenamed("pos", "block"), ["tree", "block"])
            ended = ended.unionByName(inner.select("tree", "block", "size", "nodes", "path", "root"))
        if table is tables[0]:
            return ended
        paths = ended.mapInArrow(expand, PATH)


@dataclass
class Manifest:
    """Written tables of a Merkle tree; ``root`` is the hex digest over everything, None without rows."""

    leaves: DataFrame  # tree, pos, size and the rows' own columns
    groups: list[DataFrame]  # blocks of the groups' trees
    top: list[DataFrame]  # blocks of the tree over the groups
    root: str | None


def build_manifest(rows: DataFrame, by: str, order: list[str], leaf: str = "leaf") -> Manifest:
    """The manifest of rows with a binary digest ``leaf``, one tree for each value of ``by``.

    Leaves ascend by ``order``, nulls first, ties by their digest, within a group; groups
    ascend by ``by``, null first. Repeated rows are leaves each.
    """
    keys = numbered(rows.groupBy(by).agg(F.lit(0).alias("__all")), "__all", [by], "merkle_groups")
    keys = saved(keys.select(F.col(by).alias("__group"), F.col("pos").alias("tree"), F.col("size").alias("__trees")), "merkle_trees")
    placed = numbered(rows, by, [*order, leaf], "merkle_leaves")
    placed = placed.join(keys.drop("__trees"), F.col(by).eqNullSafe(F.col("__group"))).drop("__group")
    groups, roots = forest(placed.select("tree", "pos", "size", F.col(leaf).alias("digest")), "merkle_blocks")
    tops = roots.join(keys, "tree").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("__trees").alias("size"), F.col("root").alias("digest"))
    top, root = forest(tops, "merkle_top")
    found = root.first()
    return Manifest(placed, groups, top, found and bytes(found.root).hex())


PROOF = "subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(manifest: Manifest, keep: list[str], leaf: str = "leaf", other: str | None = None) -> DataFrame:
    """The columns ``keep`` of every leaf with its group's root, the root, the hash of its proof and the root folded from it.

    With ``other``, a nullable binary column, the fold starts from that digest where it is
    not null: ``verified`` then tells whether the row is still the one in the manifest.
    """
    spark, per = manifest.leaves.sparkSession, FAN ** HEIGHT
    start = spark.createDataFrame([(0, b"", b"")], "tree long, path binary, root binary")
    tops = _paths_down(manifest.top, start)
    final = (manifest.root or "").encode()

    def leaf_paths(batches):  # the trees' own paths; the root of a tree is its leaf in the top tree
        for batch in batches:
            for block, size, nodes, path in zip(*(batch.column(c).to_pylist() for c in ("block", "size", "nodes", "path"))):
                height, held = block_height(size), min(per, size - block * per)
                hexes = _nodes(nodes, height)
                local = sibling_path(hexes, height, held)
                leaves = hexes[addresses(height + 1, height, np.arange(held))].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(block * per, block * per + held), pa.int64()),
                     pa.array([pack_path([level[i // FAN ** d] for d, level in enumerate(local)]) + path for i in range(held)]),
                     pa.array([binascii.unhexlify(x) for x in leaves])], ["tree", "path", "root"])

    groups = saved(tops.mapInArrow(leaf_paths, "tree long, path binary, root binary"), "merkle_paths")
    blocks = _paths_down(manifest.groups, groups)
    kind = {f.name: f.dataType for f in manifest.leaves.schema.fields}
    rows = manifest.leaves.select(
        "tree", F.expr(f"pos div {per}").alias("block"), "pos", "size", F.col(leaf).alias("__leaf"),
        (F.col(other) if other else F.lit(None).cast("binary")).alias("__other"), *[F.col(c).alias(f"__k_{c}") for c in keep])
    heads = blocks.select(
        "tree", "block", F.lit(None).cast("long").alias("pos"), "size", F.lit(None).cast("binary").alias("__leaf"),
        F.lit(None).cast("binary").alias("__other"), *[F.lit(None).cast(kind[c]).alias(f"__k_{c}") for c in keep],
        "nodes", "path", F.col("root").alias("__subroot"))
    both = heads.unionByName(rows, allowMissingColumns=True)

    def work(table):
        is_head = table.column("pos").is_null().to_numpy()
        at = int(np.flatnonzero(is_head)[0])
        own = table.filter(pa.array(~is_head))
        size, block = table.column("size")[at].as_py(), table.column("block")[at].as_py()
        height, held = block_height(size), min(per, size - block * per)
        local = sibling_path(_nodes(table.column("nodes")[at].as_py(), height), height, held)
        above = unpack_path(table.column("path")[at].as_py())
        upper = b"".join(a + b for a, b in above)
        subroot = table.column("__subroot")[at].as_py().hex()
        proofs, folded = [], []
        for pos, node, changed in zip(own.column("pos").to_pylist(), own.column("__leaf").to_pylist(), own.column("__other").to_pylist()):
            i = pos - block * per
            steps = [level[i // FAN ** d] for d, level in enumerate(local)]
            proofs.append(sha256(b"".join(a + b for a, b in steps) + upper).hexdigest())
            folded.append(fold(binascii.hexlify(node if changed is None else changed), steps + above).decode())
        n = own.num_rows
        out = [own.column(f"__k_{c}").combine_chunks() for c in keep] + [
            pa.array([subroot] * n, pa.string()), pa.array([final.decode()] * n, pa.string()), pa.array(proofs, pa.string()),
            pa.array(folded, pa.string()), pa.array([f == final.decode() for f in folded], pa.bool_())]
        names = [*keep, "subroot", "root", "proof_sha256", "folded_root", "verified"]
        yield from pa.Table.from_arrays(out, names).to_batches()

    schema = ", ".join([*[f"`{c}` {kind[c].simpleString()}" for c in keep], PROOF])
    return map_groups(both, ["tree", "block"], work, schema)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_proofs(docs: DataFrame) -> DataFrame:
    """Proofs of documents against a copy in which every third document by crc32(doc_id) has a lower-case text.

    Leaves are :func:`row_hash` of doc_id, source, lang, n_chars and text, one tree a lang.
    Any of them may be null; a document without doc_id comes first and is never changed;
    repeated rows are leaves each; other columns are not read. No rows give no rows.
    """
    changed = row_hash([*FIELDS[:-1], lower_ascii("text")])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    hashed = saved(docs.select("doc_id", "lang", F.unhex(row_hash(FIELDS)).alias("leaf"),
                               F.when(tampered, F.unhex(changed)).alias("other")), "merkle_rows")
    manifest = build_manifest(hashed, "lang", ["doc_id"])
    forget(hashed)
    proved = prove(manifest, ["doc_id", "leaf"], other="other")
    return proved.withColumn("leaf", F.lower(F.hex("leaf")))

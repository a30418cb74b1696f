"""Merkle manifest of a table, and the check of tampered rows against it.

Every row is a leaf: the digest of its fields, each with its length in bytes, a
colon and its value, or ``-`` if null.  Within a group (the language) leaves are
ordered by id, then digest; runs of two become the digest of both until one node
is left, the group's subroot.  Subroots in the order of their groups give the
root the same way.

Leaves are numbered from a range partitioning and cut into aligned blocks of
``BLOCK``, one task row each.  The roots of the blocks are the leaves of the next
level, until every group has one node; a level has a ``BLOCK``-th of the rows
below it, so no task holds more than a block of anything.  A block's tree is
persistent: a tampered leaf makes a version that copies the ancestors of that
leaf and shares all other nodes.  The version goes on above the block along the
siblings of the block's path, which reach it by a join on the block's number.

Results in odd cases: nulls are fields like others; null ids come first, a null
group comes before all others; repeated rows are leaves of their own; an empty
text is ``0:``; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenaudit.llm.common import stored

#: Nodes of an aligned block: a power of two.
BITS = 10
BLOCK = 1 << BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Positions over which equal rows are spread when rows are dealt out by ranges.
SPREAD = 1 << 16

PATH = "array<struct<left: boolean, digest: binary>>"


def digest(*values: Column) -> Column:
    """Digest of a row's fields."""
    text = lambda v: v.cast("string")
    said = [F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(text(v)).cast("string"), F.lit(":"), text(v))) for v in values]
    return F.unhex(F.sha2(F.concat(*said), 256))


def joined(left: bytes, right: bytes) -> bytes:
    """Digest of two nodes, taken over their hexadecimal form."""
    return hashlib.sha256((left.hex() + right.hex()).encode()).digest()


def alone(node: bytes) -> bytes:
    """Digest of a run's only node."""
    return hashlib.sha256(node.hex().encode()).digest()


class Tree:
    """A tree over the nodes of a block.  Nodes are never changed: a version is a root that shares what it didn't copy."""

    def __init__(self, leaves: list[bytes], height: int):
        self.height = height
        self.nodes: list[tuple[bytes, int, int]] = [(d, -1, -1) for d in leaves]
        level = list(range(len(leaves)))
        for _ in range(height):
            level = [self.add(*level[i:i + 2]) for i in range(0, len(level), 2)]
        self.root = level[0]

    def add(self, left: int, right: int = -1) -> int:
        a = self.nodes[left][0]
        self.nodes.append((alone(a) if right < 0 else joined(a, self.nodes[right][0]), left, right))
        return len(self.nodes) - 1

    def path(self, place: int) -> list[tuple[int, bool, int]]:
        """From the root to a leaf: the nodes, whether the way goes right, and the sibling or -1."""
        out, at = [], self.root
        for bit in range(self.height - 1, -1, -1):
            _, left, right = self.nodes[at]
            goes_right = bool(place >> bit & 1)
            out.append((at, goes_right, left if goes_right else right))
            at = right if goes_right else left
        return out

    def version(self, place: int, leaf: bytes) -> int:
        """The root of a version with another leaf at ``place``; only that leaf's ancestors are copied."""
        self.nodes.append((leaf, -1, -1))
        at = len(self.nodes) - 1
        for _, goes_right, sibling in reversed(self.path(place)):
            at = self.add(at) if sibling < 0 else self.add(sibling, at) if goes_right else self.add(at, sibling)
        return at

    def siblings(self, place: int) -> list[dict | None]:
        """From the leaf up; None where a run has one node only."""
        return [None if s < 0 else {"left": goes_right, "digest": self.nodes[s][0]} for _, goes_right, s in reversed(self.path(place))]


def continued(node: bytes, above: list[dict | None]) -> bytes:
    """A version's node above its block: copies of the ancestors along the path, level by level."""
    for s in above:
        node = alone(node) if s is None else joined(s["digest"], node) if s["left"] else joined(node, s["digest"])
    return node


def height(n: int) -> int:
    """Levels above the leaves of a block, when ``n`` nodes of the group stand on this level."""
    return BITS if n > BLOCK else (n - 1).bit_length()


def numbered(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """Adds ``pos``, the place of a row within its group, and ``n``, the group's rows; the order must leave no ties but equal rows."""
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
    keys = [group, *order]
    dealt = rows.withColumn("spread", spread).repartitionByRange(*keys, "spread").sortWithinPartitions(*keys, "spread").drop("spread")
    placed = stored(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), label)
    parts = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    whole = Window.partitionBy(group)
    so_far = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("here").over(so_far), F.lit(0))).withColumn("n", F.sum("here").over(whole))
    return placed.join(parts, [group, "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before", "here")


def blocks(nodes: DataFrame, *payload: str) -> DataFrame:
    """One row per aligned block of a group: ``nodes`` in order."""
    return nodes.groupBy("group", F.shiftright("pos", BITS).alias("block"), "n").agg(
        F.array_sort(F.collect_list(F.struct("pos", "node", *payload))).alias("nodes"))


def roots(cut: DataFrame) -> DataFrame:
    """The root of every block, a node of the next level."""
    def run(batches):
        for batch in batches:
            found = [(t := Tree([x["node"] for x in rows.as_py()], height(n.as_py()))).nodes[t.root][0] for n, rows in zip(batch.column("n"), batch.column("nodes"))]
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("pos"), batch.column("n"), pa.array(found, pa.binary())],
                                             ["group", "pos", "n", "node"])

    made = cut.select("group", F.col("block").alias("pos"), "n", "nodes").mapInArrow(run, "`group` binary, pos bigint, n bigint, node binary")
    return made.withColumn("n", F.ceil(F.col("n") / BLOCK).cast("bigint"))


def _upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of a level's nodes: siblings in the block, then those above it."""
    for batch in batches:
        for group, n, nodes, above, root in zip(*(batch.column(c).to_pylist() for c in ("group", "n", "nodes", "above", "root"))):
            tree = Tree([x["node"] for x in nodes], height(n))
            paths = [tree.siblings(i) + (above or []) for i in range(len(nodes))]
            top = tree.nodes[tree.root][0] if root is None else root
            yield pa.RecordBatch.from_arrays(
                [pa.array([group] * len(nodes), pa.binary()), pa.array([x["pos"] for x in nodes], pa.int64()),
                 pa.array(paths, pa.list_(pa.struct([("left", pa.bool_()), ("digest", pa.binary())]))), pa.array([top] * len(nodes), pa.binary())],
                ["group", "pos", "path", "root"])


def paths(nodes: DataFrame) -> DataFrame:
    """For every node its ``path`` to the group's root, and that ``root``."""
    levels = [blocks(nodes)]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > BLOCK:
        levels.append(blocks(stored(roots(levels[-1]), "merkle-level")))
        most = -(-most // BLOCK)
    found = None
    for cut in reversed(levels):
        above = cut.select("*", F.lit(None).cast(PATH).alias("above"), F.lit(None).cast("binary").alias("root")) if found is None else cut.join(
            found.select("group", F.col("pos").alias("block"), F.col("path").alias("above"), "root"), ["group", "block"], "left")
        found = above.select("group", "n", "nodes", "above", "root").mapInArrow(_upper, f"`group` binary, pos bigint, path {PATH}, root binary")
    return found


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proof of every leaf, and the root that its version comes to."""
    names = ["doc_id", "leaf", "subroot", "root", "proof", "folded_root"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary()]
    for batch in batches:
        for n, nodes, above, subroot, root in zip(*(batch.column(c).to_pylist() for c in ("n", "nodes", "above", "subroot", "root"))):
            tree, rows = Tree([x["node"] for x in nodes], height(n)), []
            for i, x in enumerate(nodes):
                proof = [s["digest"] for s in tree.siblings(i) + above if s]
                version = tree.root if x["tampered"] is None else tree.version(i, x["tampered"])
                rows.append((x["doc_id"], x["node"], subroot, root, proof, continued(tree.nodes[version][0], above)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, where: Column | None = None, doc_id: str = "doc_id", group: str = "lang",
             fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per document: ``leaf``, ``subroot``, ``root`` and ``proof`` (siblings up to the root) as bytes, and ``folded_root``.

    ``tampered`` names fields and their changed values in the rows ``where`` holds; ``folded_root`` is what the leaf of the
    changed row, or else of the row itself, comes to with the untouched siblings.
    """
    changed = tampered or {}
    other = digest(*[changed.get(f, F.col(f)) for f in fields])
    in_order = F.coalesce(F.concat(F.lit(b"\x01"), F.col(group).cast("binary")), F.lit(b"\x00"))
    leaves = docs.select(in_order.alias("group"), F.col(doc_id).cast("bigint").alias("doc_id"), digest(*[F.col(f) for f in fields]).alias("node"),
                         F.when(F.lit(False) if where is None else where, other).alias("tampered"))
    cut = stored(blocks(numbered(leaves, "group", ["doc_id", "node"], "merkle-leaves"), "doc_id", "tampered"), "merkle-blocks")
    level = stored(roots(cut), "merkle-level")
    below = paths(level)
    # A group's root is the node all its paths end in; the groups' roots make the top tree.
    tops = below.filter("pos = 0").select(F.lit(b"").alias("group"), F.col("group").alias("member"), F.col("root").alias("node"))
    tops = stored(numbered(tops, "group", ["member"], "merkle-top"), "merkle-subroots")
    top = tops.select("pos", F.col("member").alias("group"), F.col("node").alias("subroot")).join(
        paths(tops).select("pos", F.col("path").alias("upper"), F.col("root").alias("whole")), "pos").drop("pos")
    above = below.join(top, "group").select("group", F.col("pos").alias("block"), F.concat("path", "upper").alias("above"), "subroot", F.col("whole").alias("root"))
    found = cut.join(above, ["group", "block"]).select("n", "nodes", "above", "subroot", "root").mapInArrow(
        _leaves, "doc_id bigint, leaf binary, subroot binary, root binary, proof array<binary>, folded_root binary")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))

"""A Merkle manifest of a dataset: a root over all rows, and for each row the siblings that lead from its leaf to the root.

Leaves of a group ascend by id.  Their places come from ranges that are sorted where they are, and sums of what goes before each
range.  Aligned blocks of 2^12 leaves are then independent: one pass hashes each to its root, the roots are leaves of the next
tree above, until one block is left, and the groups' roots have a tree of their own.  A second pass over each block gives the
authentication paths leaf by leaf with a *fractal traversal*: of the subtrees stacked over the current leaf it holds those that
the path needs, and builds the ones desired next a few hashes a leaf, so that they are ready in time.  To each path the block's
own path in the upper trees is appended.

A node that has no neighbour is hashed alone.  Digests are hexadecimal text.  A path's entries are "<" or ">" (the sibling stands
left or right) and the sibling, or "" where there is none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import stored
from skein.operators.ranges import before, placed

#: Levels of a block's tree, and of the subtrees stacked in it.
LEVELS, STACKED = 12, 3


def digest(*nodes: str | None) -> str | None:
    """The parent of two nodes, of which the second or both may be missing."""
    there = "".join(x for x in nodes if x is not None)
    return hashlib.sha256(there.encode()).hexdigest() if there else None


class Subtree:
    """Nodes of the levels from ``low`` to below ``top`` over the leaves from ``first`` on, hashed one step at a time."""

    def __init__(self, leaf: Callable[[int], str | None], low: int, top: int, first: int):
        self.leaf, self.low, self.top, self.next, self.end = leaf, low, top, first, first + (1 << top)
        self.nodes: dict[tuple[int, int], str | None] = {}
        self.stack: list[tuple[int, int, str | None]] = []

    def step(self) -> bool:
        """One leaf or one hash; whether there was anything to do."""
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            (level, at, left), (_, _, right) = stack[-2:]
            stack[-2:] = [(level + 1, at >> 1, digest(left, right))]
        elif self.next < self.end:
            stack.append((0, self.next, self.leaf(self.next)))
            self.next += 1
        else:
            return False
        level, at, node = stack[-1]
        if self.low <= level < self.top:
            self.nodes[level, at] = node
        return True

    def finished(self) -> Subtree:
        while self.step():
            pass
        return self

    def root(self) -> str | None:
        return self.finished().stack[0][2]


def paths(leaf: Callable[[int], str | None], count: int, height: int, stacked: int = STACKED) -> Iterator[list[str]]:
    """For each of the first ``count`` leaves of a tree of ``height`` levels its path, in order.  Of each of the stacked levels
    one subtree is held, and one for the leaves to come is being built, two steps a leaf."""
    bounds = [(low, min(low + stacked, height)) for low in range(0, height, stacked)]
    held = [Subtree(leaf, low, top, 0).finished() for low, top in bounds]
    desired = [Subtree(leaf, low, top, 1 << top) for low, top in bounds[:-1]]
    for i in range(count):
        path = []
        for level in range(height):
            sibling = held[level // stacked].nodes[level, i >> level ^ 1]
            path.append("" if sibling is None else ("<" if i >> level & 1 else ">") + sibling)
        yield path
        for j, subtree in enumerate(desired):
            subtree.step()
            subtree.step()
            size = 1 << bounds[j][1]
            if (i + 1) % size == 0:
                held[j] = subtree.finished()
                desired[j] = Subtree(leaf, *bounds[j], min(i + 1 + size, 1 << height))


def height_of(n: int, levels: int) -> int:
    """Levels of a block's tree in a group of ``n`` nodes: a group of one block ends where one node is left."""
    return min(levels, (n - 1).bit_length())


def block(table: pa.Table, levels: int) -> tuple[pa.Table, Callable[[int], str | None], int, int]:
    """A block's rows in order, its leaves by their place in it, how many there are, and the levels of its tree."""
    table = table.sort_by("index_")
    digests = table.column("digest_").to_pylist()
    return table, lambda i: digests[i] if i < len(digests) else None, len(digests), height_of(table.column("n_")[0].as_py(), levels)


NODES = "key_ string, index_ long, n_ long, digest_ string"
ABOVE = "key_ string, block_ long, path_ array<string>, top_ string"


def indexed(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """``nodes`` (key_, ...) with ``index_``, the place in its key's order, and ``n_``, how many the key has."""
    rows = placed(nodes, [F.col("key_"), *order])
    counts = stored(rows.groupBy("key_", "part_").agg(F.min("place_").alias("low_"), F.count("*").alias("rows_")), "merkle_counts")
    totals = counts.groupBy("key_").agg(F.sum("rows_").alias("n_")).withColumnRenamed("key_", "total_key")
    bases = before(counts, ["key_"], "part_", F.col("rows_")).select(F.col("key_").alias("base_key"), F.col("part_").alias("base_part"), (F.coalesce("before_", F.lit(0)) - F.col("low_")).alias("base_"))
    bases = bases.join(totals, bases.base_key == totals.total_key).drop("total_key")
    return rows.join(bases, (rows.key_ == bases.base_key) & (rows.part_ == bases.base_part)).withColumn("index_", F.col("base_") + F.col("place_")).drop("part_", "place_", "base_key", "base_part", "base_")


def by_block(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block_", F.shiftright("index_", levels))


def above(nodes: DataFrame, levels: int, most: int) -> DataFrame:
    """For each block of ``nodes`` the path from its root to the key's root, and that root."""

    def root(table: pa.Table) -> pa.Table:
        table, leaf, _, height = block(table, levels)
        out = {c: [table.column(c)[0].as_py()] for c in ("key_", "block_", "n_")}
        return pa.table({"key_": pa.array(out["key_"], pa.string()), "index_": pa.array(out["block_"], pa.int64()), "n_": pa.array([(out["n_"][0] - 1 >> levels) + 1], pa.int64()), "digest_": pa.array([Subtree(leaf, 0, height, 0).root()], pa.string())})

    narrow = by_block(nodes.select("key_", "index_", "n_", "digest_"), levels)
    roots = stored(narrow.groupBy("key_", "block_").applyInArrow(root, NODES), "merkle_roots")
    if most <= 1 << levels:
        return roots.select("key_", F.col("index_").alias("block_"), F.array().cast("array<string>").alias("path_"), F.col("digest_").alias("top_"))
    told = above(roots, levels, (most - 1 >> levels) + 1)
    return authenticated(roots, told, levels).select("key_", F.col("index_").alias("block_"), "path_", "top_")


def authenticated(nodes: DataFrame, told: DataFrame, levels: int) -> DataFrame:
    """``nodes`` with their paths and their key's root, from what ``above`` told of their blocks."""
    kept = [f for f in nodes.schema if f.name != "n_"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", path_ array<string>, top_ string"

    def run(table: pa.Table, up: pa.Table) -> pa.Table:
        table, leaf, count, height = block(table, levels)
        upper, top = up.column("path_")[0].as_py(), up.column("top_")[0].as_py()
        found = pa.array([path + upper for path in paths(leaf, count, height)], pa.list_(pa.string()))
        out = table.select([f.name for f in kept])
        return out.append_column("path_", found).append_column("top_", pa.array(np.full(count, top, object), pa.string()))

    return by_block(nodes, levels).groupBy("key_", "block_").cogroup(told.groupBy("key_", "block_")).applyInArrow(run, schema)


def field(column: Column) -> Column:
    """A value as a leaf holds it: ``-`` if null, else its number of bytes in UTF-8, a colon, and the value."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    bare = lambda x: F.substring(x, 2, 64)
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.when(F.startswith(x, F.lit("<")), F.concat(bare(x), node)).otherwise(F.concat(node, bare(x))), 256))


def proven(leaves: DataFrame, id_col: str = "id_", levels: int = LEVELS) -> DataFrame:
    """Rows (group_, an id, digest_, more columns) with subroot, root and proof, the path from the leaf to the root.

    Leaves of a group are in order of id, nulls first, then of their digests; groups in that of their bytes, null first.  Rows may
    be equal; an empty table has no rows."""
    keyed = leaves.withColumn("key_", F.coalesce(F.concat(F.lit("="), F.col("group_")), F.lit("-")))
    nodes = indexed(keyed, [F.col(id_col), F.col("digest_")])
    most = nodes.agg(F.max("n_")).first()[0] or 0
    told = stored(above(nodes, levels, most), "merkle_paths")
    roots = told.where("block_ = 0").select(F.lit("").alias("key_"), F.col("key_").alias("group_key"), F.col("top_").alias("digest_"))
    tops = indexed(roots, [F.col("group_key")])
    most_groups = tops.agg(F.max("n_")).first()[0] or 0
    upper = authenticated(tops, above(tops, levels, most_groups), levels).select("group_key", F.col("path_").alias("last_"), F.col("top_").alias("root"))
    whole = told.join(upper, told.key_ == upper.group_key).select("key_", "block_", F.concat("path_", "last_").alias("path_"), F.concat_ws(" ", "top_", "root").alias("top_"))
    out = authenticated(nodes, whole, levels)
    both = F.split("top_", " ")
    return out.withColumn("subroot", both[0]).withColumn("root", both[1]).withColumnRenamed("path_", "proof").drop("key_", "index_", "top_")


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", levels: int = LEVELS) -> DataFrame:
    """One row for each row of ``docs``: its id, leaf, subroot, root and proof.  Leaves hold whole texts and null fields; equal ids are
    in the order of their leaves; other columns may have any names."""
    column = lambda c: F.col(f"`{c}`")
    leaves = docs.select(column(id_col).alias("id_"), column(group_col).cast("string").alias("group_"), leaf_of(*map(column, fields)).alias("digest_"))
    return proven(leaves, levels=levels).select(F.col("id_").alias(id_col), F.col("digest_").alias("leaf"), "subroot", "root", "proof")


def verified(docs: DataFrame, held: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id") -> DataFrame:
    """``held``, a manifest with one row an id, with folded_root, what the documents now lead to (null if one is gone), and verified."""
    column = lambda c: F.col(f"`{c}`")
    now = docs.select(column(id_col).alias("id_"), leaf_of(*map(column, fields)).alias("now_"))
    out = held.join(now, column(id_col).eqNullSafe(F.col("id_")), "left").withColumn("folded_root", folded(F.col("now_"), F.col("proof")))
    return out.withColumn("verified", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False))).drop("id_", "now_")


def digests(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``docs`` and what it finds where every seventh id's n_chars was raised by 1."""
    names = ("doc_id", "source", "lang", "n_chars", "text")
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    tampered = leaf_of(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in names])
    leaf = leaf_of(*map(F.col, names))
    rows = docs.select(F.col("doc_id").alias("id_"), F.col("lang").alias("group_"), leaf.alias("digest_"), F.when(changed, tampered).otherwise(leaf).alias("now_"))
    out = proven(rows, levels=levels).withColumn("folded_root", folded(F.col("now_"), F.col("proof")))
    proof = F.sha2(F.array_join(F.transform("proof", lambda x: F.substring(x, 2, 64)), ""), 256)
    return out.select(F.col("id_").alias("doc_id"), F.col("digest_").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

"""Merkle paths by fractal traversal, and whole manifests, against a tree that is built in full."""

import hashlib
import zlib

import pytest

from skein.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, leaf string, key_ int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i & 1, level[i ^ 1] if i ^ 1 < len(level) else None))
        i >>= 1
    return out


def fold(node, path):
    for right, sibling in path:
        node = h(node) if sibling is None else h(sibling, node) if right else h(node, sibling)
    return node


@pytest.mark.parametrize("stacked", (1, 2, 3, 5))
@pytest.mark.parametrize("count", (1, 2, 3, 5, 8, 13, 16))
def test_paths_of_a_block(count, stacked):
    leaves = [h(str(i)) for i in range(count)]
    levels = tree(leaves)
    leaf = lambda i: leaves[i] if i < count else None
    height = len(levels) - 1
    told = [[(p[:1] == "<", p[1:] or None) for p in path] for path in merkle.paths(leaf, count, height, stacked)]
    assert told == [[(bool(r), s) for r, s in siblings(levels, i)] for i in range(count)]
    assert merkle.Subtree(leaf, 0, height, 0).root() == levels[-1][0]


def test_few_nodes_are_held():
    """Subtrees of stacked levels, not the block: their nodes are some tens of a thousand."""
    size = lambda subtree: len(subtree.nodes) + len(subtree.stack)
    made = []
    plain = merkle.Subtree.__init__

    def counted(self, *args):
        plain(self, *args)
        made.append(self)

    merkle.Subtree.__init__ = counted
    try:
        for i, _ in enumerate(merkle.paths(lambda i: h(str(i)), 1 << 12, 12)):
            if i % 100 == 0:
                live = made[:4] if i == 0 else made[-12:]
                assert max(map(size, live)) <= 2 * 8 + 13
    finally:
        merkle.Subtree.__init__ = plain


def leaf_by_hand(row, more=0):
    parts = (row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4])
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in parts))


def by_hand(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_by_hand(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top, out = tree([trees[g][-1][0] for g in names]), []
    for n, g in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = siblings(trees[g], i) + siblings(top, n)
            root = fold(leaf_by_hand(row, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0), path)
            out.append((row[0], leaf, trees[g][-1][0], top[-1][0], h("".join(s for _, s in path if s)), root, root == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", (1, 2, 12))
def test_manifests(spark, levels):
    rows = [(i, f"s{i % 3}", ("en", "de", None, "é")[min(3, i % 7)], i if i % 5 else None, "x" * i) for i in range(40)]
    rows += [(3, None, "en", 1, None), (3, None, "en", 1, None), (None, "s", "lone", 2, "long " * 9000), (None, None, None, None, None), (5, "b", "en", 0, "other text, same id")]
    docs = spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in merkle.digests(docs, levels).collect()), key=str)
    assert got == by_hand(rows)


def test_empty_and_single(spark):
    assert merkle.digests(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "s", "en", 3, "abc")]
    assert [tuple(r) for r in merkle.digests(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)).collect()] == by_hand(rows)


def test_verified_finds_changes(spark):
    docs = spark.createDataFrame([(i, "s", "en", i, "t", "", 0) for i in range(9)], SCHEMA)
    held = merkle.manifest(docs, levels=2)
    later = docs.where("doc_id <> 4").withColumn("text", merkle.F.when(merkle.F.col("doc_id") == 7, "changed").otherwise(merkle.F.col("text")))
    assert {r.doc_id for r in merkle.verified(later, held).collect() if not r.verified} == {4, 7}

"""Connected components of an edge table, by alternating star contractions on DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import dropped, spread_join, stored


def roots(pairs: np.ndarray) -> np.ndarray:
    """Rows (node, smallest node joined to it) of the nodes in ``pairs`` that are not smallest themselves.

    Vectorised: each round hooks roots onto smaller neighbouring roots and halves the paths.
    """
    if not len(pairs):
        return np.empty((0, 2), np.int64)
    nodes, ends = np.unique(pairs, return_inverse=True)
    ends = ends.reshape(-1, 2)
    parent = np.arange(len(nodes))
    while True:
        a, b = parent[ends[:, 0]], parent[ends[:, 1]]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    moved = parent != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[parent[moved]]], axis=1)


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph ``edges(u long, v long)``.

    Returns (node, component): every node that is not the smallest of its component, with that smallest node.
    A large-star and a small-star step alternate until the edges stop changing; each step is a grouped minimum
    (combined before the shuffle) and an equi-join that deals hubs over many tasks, and the edges of each round are written
    to the shared folder.  Loops and repeated edges are allowed; an empty edge table gives no rows.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, seen = stored(edges, "edges"), None
    for _ in range(max_rounds):
        # an edge's larger end moves to the smallest neighbour of the smaller end, if that has one below itself
        below = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = stored(spread_join(edges, below, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "edges")
        # then all smaller neighbours of a node move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, edges = edges, stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        dropped(last, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
    raise RuntimeError("the components did not settle")

"""Embedding near-duplicates with hierarchical navigable small-world graphs.

Distinct vectors are dealt into shards by hash; a task builds a shard's graph, audits it against brute force, widening the
beam until its recall passes, and the graphs are stored.  Then every slice of all vectors meets every group of graphs in a
task of its own: a beam search finds the way in, and from every hit the graph is followed through all vectors near the
threshold.  Cosines are verified in double precision.  Links are counted and reduced to stars where they are found, never
sent out as pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import dropped, spread_join, stored
from skein.llm.components import connected, roots

#: Vectors of a shard, about, graphs that a task holds, and vectors of a slice that streams past them.
SHARD_ROWS = 50_000
MIN_SHARDS = 6
GRAPHS_PER_TASK, SLICE_ROWS = 2, 32_768
#: Recall that the beam is widened for, and that a shard must have.
WANTED_RECALL, LEAST_RECALL = 0.98, 0.9
#: Neighbours kept on a layer, and candidates looked at to choose them.
DEGREE, BUILD_BEAM, FIRST_BEAM = 24, 48, 32
BLOCK = 1024


@dataclass
class Layer:
    """A navigable graph over some vectors: ``nodes`` are their numbers in the shard, ``next`` rows of neighbours (places in ``nodes``, -1 pads)."""

    nodes: np.ndarray
    next: np.ndarray
    vectors: np.ndarray
    size: int = 0

    def beam(self, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries together, from the places ``entry`` (row per query, -1 pads): places and similarities, best first."""
        b, rows = len(queries), np.arange(len(queries))
        seen = np.zeros((b, self.size + 1), bool)  # the last column stands for -1
        ids = np.full((b, width), -1)
        sims = np.full((b, width), -np.inf, np.float32)
        done = np.zeros((b, width), bool)
        entry = entry[:, :width]
        k = entry.shape[1]
        ids[:, :k] = entry
        sims[:, :k] = np.where(entry >= 0, np.einsum("bkd,bd->bk", self.vectors[np.maximum(entry, 0)], queries), -np.inf)
        seen[rows[:, None], entry] = True
        while True:
            open_ = np.where(done, -np.inf, sims)
            best = open_.argmax(axis=1)
            live = np.flatnonzero(open_[rows, best] > -np.inf)
            if not len(live):
                break
            at = best[live]
            done[live, at] = True
            near = self.next[ids[live, at]]
            new = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            got = np.where(new, np.einsum("bkd,bd->bk", self.vectors[np.maximum(near, 0)], queries[live]), -np.inf).astype(np.float32)
            some = (got > sims[live].min(axis=1)[:, None]).any(axis=1)
            live, near, got = live[some], near[some], got[some]
            if not len(live):
                continue
            all_sims = np.concatenate([sims[live], got], axis=1)
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            sims[live] = np.take_along_axis(all_sims, top, axis=1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), top, axis=1)
            done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1), top, axis=1)
        ids[sims == -np.inf] = -1
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def chosen(self, candidates: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Neighbours from ``candidates`` (best first, -1 pads): up to half spread out, none closer to another than to the
        vector itself, and the nearest others beside them."""
        b, c = candidates.shape
        vectors = self.vectors[np.maximum(candidates, 0)]
        between = vectors @ vectors.transpose(0, 2, 1)
        taken, closest, count = np.zeros((b, c), bool), np.full((b, c), -np.inf, np.float32), np.zeros(b, np.int64)
        for j in range(c):
            take = (candidates[:, j] >= 0) & (count < DEGREE // 2) & (closest[:, j] < sims[:, j])
            taken[:, j] = take
            count += take
            closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
        order = np.argsort(~taken * 2 + (candidates < 0) * 4, axis=1, kind="stable")[:, :DEGREE]
        out = np.take_along_axis(candidates, order, axis=1)
        return np.pad(out, ((0, 0), (0, DEGREE - out.shape[1])), constant_values=-1)

    def insert(self, block: np.ndarray, entry: np.ndarray) -> None:
        """Add the places ``block``, which follow those present."""
        queries = self.vectors[block]
        own = queries @ queries.T
        np.fill_diagonal(own, -np.inf)
        ids, sims = np.broadcast_to(block, (len(block), len(block))), own
        if self.size:
            found, found_sims = self.beam(queries, np.where(entry < self.size, entry, 0), BUILD_BEAM)
            ids, sims = np.concatenate([found, ids], axis=1), np.concatenate([found_sims, sims], axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
        sims = np.take_along_axis(sims, order, axis=1)
        ids = np.where(sims > -np.inf, np.take_along_axis(ids, order, axis=1), -1)
        picked = self.chosen(ids, sims)
        self.next[block] = picked
        self.size += len(block)
        # the other direction: each neighbour takes up its new ones, best first, and chooses again
        source, target = np.repeat(block, DEGREE)[picked.ravel() >= 0], picked.ravel()[picked.ravel() >= 0]
        sim = np.einsum("nd,nd->n", self.vectors[source], self.vectors[target])
        order = np.lexsort([-sim, target])
        source, target, sim = source[order], target[order], sim[order]
        rank = np.arange(len(target)) - np.searchsorted(target, target)
        some = rank < DEGREE
        source, target, rank = source[some], target[some], rank[some]
        old = np.unique(target)
        more = np.full((len(old), DEGREE), -1)
        more[np.searchsorted(old, target), rank] = source
        present = self.next[old]
        more[(more[:, :, None] == present[:, None, :]).any(axis=2)] = -1
        for begin in range(0, len(old), 2048):
            part = slice(begin, begin + 2048)
            both = np.concatenate([present[part], more[part]], axis=1)
            sims = np.where(both >= 0, np.einsum("bkd,bd->bk", self.vectors[np.maximum(both, 0)], self.vectors[old[part]]), -np.inf)
            order = np.argsort(-sims, axis=1, kind="stable")
            self.next[old[part]] = self.chosen(np.take_along_axis(both, order, axis=1), np.take_along_axis(sims, order, axis=1))


class Graph:
    """The layers over one shard, from the top; each is built over the finished ones above it."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.vectors = vectors.astype(np.float32)
        n = len(vectors)
        levels = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(DEGREE)).astype(int)
        order = np.argsort(-levels, kind="stable")
        self.layers: list[Layer] = []
        self.width = FIRST_BEAM
        for level in range(int(levels.max(initial=0)), -1, -1):
            nodes = order[: int((levels >= level).sum())]
            layer = Layer(nodes, np.full((len(nodes), DEGREE), -1), self.vectors[nodes])
            begin = 0
            while begin < len(nodes):
                block = np.arange(begin, min(begin + max(32, min(256, begin)), len(nodes)))
                layer.insert(block, self.entries(layer.vectors[block]))
                begin += len(block)
            self.layers.append(layer)

    def entries(self, queries: np.ndarray) -> np.ndarray:
        """Places on the layer below the last finished one where a search may begin; nodes keep their places downwards."""
        places = np.zeros((len(queries), 1), int)
        for layer in self.layers:
            places = layer.beam(queries, places, 4)[0]
        return places

    def near(self, queries: np.ndarray, threshold: float, width: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(query, numbers of all vectors found at ``threshold`` or a hair below) for the queries that have some.

        From the beam's hits the bottom layer is followed through everything within 0.04 of the threshold.
        """
        places = np.zeros((len(queries), 1), int)
        for layer in self.layers[:-1]:
            places = layer.beam(queries, places, 4)[0]
        bottom = self.layers[-1]
        ids, sims = bottom.beam(queries, places, width or self.width)
        for i in np.flatnonzero(sims[:, 0] >= threshold - 0.04).tolist():
            front = ids[i][sims[i] >= threshold - 0.04]
            seen = np.zeros(bottom.size + 1, bool)
            seen[front] = seen[-1] = True
            inside = [front]
            while len(front):
                near = np.unique(bottom.next[front])
                near = near[~seen[near]]
                seen[near] = True
                front = near[bottom.vectors[near] @ queries[i] >= threshold - 0.04]
                inside.append(front)
            inside = np.concatenate(inside)
            hits = inside[bottom.vectors[inside] @ queries[i] >= threshold - 1e-4]
            if len(hits):
                yield i, bottom.nodes[hits]

    def audit(self, threshold: float, probes: int = 128, least: float = WANTED_RECALL, seed: int = 11) -> float:
        """Recall on probes against brute force; the beam widens until ``least`` is reached.  Probes are members turned away
        by a random angle, one half to just within the threshold, one half well within, so that each has a true hit."""
        n, d = self.vectors.shape
        rng = np.random.default_rng(seed)
        base = self.vectors[rng.choice(n, min(n, probes), replace=False)]
        noise = rng.standard_normal(base.shape).astype(np.float32)
        noise -= np.einsum("nd,nd->n", noise, base)[:, None] * base
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-9)
        cosine = np.where(np.arange(len(base)) % 2, threshold + 0.002, (1 + threshold) / 2)[:, None].astype(np.float32) if d > 1 else np.ones((len(base), 1), np.float32)
        queries = cosine * base + np.sqrt(1 - cosine**2) * noise
        truth = queries @ self.vectors.T >= threshold
        while True:
            found = sum(truth[i, hits].sum() for i, hits in self.near(queries, threshold))
            recall = found / max(1, truth.sum())
            if recall >= least or self.width >= n:
                return float(recall)
            self.width *= 2

    def packed(self) -> tuple:
        """What makes the graph again beside its vectors."""
        return self.width, [(x.nodes.astype(np.int32), x.next.astype(np.int32)) for x in self.layers]

    @classmethod
    def unpacked(cls, vectors: np.ndarray, packed: tuple) -> Graph:
        graph = cls.__new__(cls)
        graph.vectors, (graph.width, layers) = vectors.astype(np.float32), packed
        graph.layers = [Layer(nodes.astype(np.int64), following.astype(np.int64), graph.vectors[nodes], len(nodes)) for nodes, following in layers]
        return graph


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


@dataclass
class Shard:
    """A graph with its vectors in double precision, their numbers, ids that have each, and whether one of these has others too."""

    graph: Graph
    vectors: np.ndarray
    numbers: np.ndarray
    copies: np.ndarray
    several: np.ndarray

    def linked(self, vectors: np.ndarray, numbers: np.ndarray, several: np.ndarray, threshold: float) -> pa.RecordBatch:
        """Rows of FOUND for a block of queries: their links with this shard, as sums, stars, and pairs of ``several``."""
        some, counts, pairs, both = [], [], [], []
        for i, hits in self.graph.near(vectors.astype(np.float32), threshold):
            hits = hits[(self.vectors[hits] @ vectors[i] >= threshold) & (self.numbers[hits] != numbers[i])]
            if len(hits):
                some.append(numbers[i])
                counts.append(self.copies[hits].sum())
                pairs.append(np.stack([np.full(len(hits), numbers[i]), self.numbers[hits]], axis=1))
                if several[i]:
                    both.append(pairs[-1][self.several[hits]])
        star, same = (np.concatenate(x) if x else np.empty((0, 2), np.int64) for x in (pairs, both))
        star = roots(star)
        kind = np.repeat(np.arange(3, dtype=np.int32), [len(some), len(star), len(same)])
        a = np.concatenate([np.array(some, np.int64), star[:, 0], same[:, 0]])
        b = np.concatenate([np.array(counts, np.int64), star[:, 1], same[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], names=["kind", "a", "b"])


#: Kind 0: a vector and the number of its links; 1: an edge; 2: a link of two vectors whose ids have several.
FOUND = "kind int, a long, b long"
GRAPHS = "shard int, dim int, recall double, graph binary"


def build_graphs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (shard, dim, number, copies, several, embedding) sorted by shard and dim: a row of GRAPHS for each of both."""
    key, held = None, []

    def built() -> pa.RecordBatch:
        vectors, numbers, copies, several = (np.concatenate(x) for x in zip(*held, strict=True))
        graph = Graph(vectors)
        recall = graph.audit(threshold)
        kept = pickle.dumps((vectors, numbers, copies, several, graph.packed()), protocol=5)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([recall]), pa.array([kept], pa.binary())], names=["shard", "dim", "recall", "graph"])

    for batch in batches:
        keys = np.stack([batch.column("shard").to_numpy(), batch.column("dim").to_numpy()], axis=1)
        cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and tuple(keys[a].tolist()) != key:
                yield built()
            key, part = tuple(keys[a].tolist()), batch.slice(a, b - a)
            held.append((unit(matrix(part.column("embedding"))), part.column("number").to_numpy(), part.column("copies").to_numpy(), part.column("several").to_numpy(zero_copy_only=False)))
    if held:
        yield built()


def search_graphs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (task, dim, number, several, embedding, graph) sorted by task and number: a task's graphs, without number, come
    first, and the vectors of its slice stream past those of their length."""
    task, shards = None, {}
    for batch in batches:
        keys = batch.column("task").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if keys[a] != task:
                task, shards = keys[a], {}
            part = batch.slice(a, b - a)
            n = part.column("number").null_count
            for row in part.slice(0, n).select(["dim", "graph"]).to_pylist():
                vectors, numbers, copies, several, packed = pickle.loads(row["graph"])
                shards.setdefault(row["dim"], []).append(Shard(Graph.unpacked(vectors, packed), vectors, numbers, copies, several))
            for begin in range(n, len(part), BLOCK):
                block = part.slice(begin, BLOCK)
                dims = block.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    some = block.filter(pa.array(dims == dim))
                    vectors = unit(matrix(some.column("embedding"))) if dim in shards else None
                    for shard in shards.get(dim, ()):
                        yield shard.linked(vectors, some.column("number").to_numpy(), some.column("several").to_numpy(zero_copy_only=False), threshold)


def all_links(reps: DataFrame, threshold: float, min_shards: int, shard_rows: int) -> DataFrame:
    """Rows of FOUND, stored, from stored ``reps`` (number, copies, several, embedding): every slice against every graph."""
    total = reps.count()
    shards, slices = max(min_shards, -(-total // shard_rows)), max(1, -(-total // SLICE_ROWS))
    groups = -(-shards // GRAPHS_PER_TASK)
    dim = F.size("embedding").alias("dim")
    home = F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard")
    dealt = reps.select(home, dim, "number", "copies", "several", "embedding").repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "number")
    graphs = stored(dealt.mapInArrow(lambda b: build_graphs(b, threshold), GRAPHS), "graphs")
    worst = graphs.agg(F.min("recall")).first()[0]
    if worst is not None and worst < LEAST_RECALL:
        raise RuntimeError(f"a graph's recall is {worst:.3f}, below {LEAST_RECALL}")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    task = (F.col("group") * slices + F.col("slice")).cast("int").alias("task")
    empty = F.lit(None)
    held = graphs.select(F.floor(F.col("shard") / GRAPHS_PER_TASK).alias("group"), upto(slices).alias("slice"), "dim", "graph")
    held = held.select(task, "dim", empty.cast("long").alias("number"), empty.cast("boolean").alias("several"), empty.cast("array<double>").alias("embedding"), "graph")
    asked = reps.select(upto(groups).alias("group"), F.pmod(F.xxhash64("number"), F.lit(slices)).alias("slice"), dim, "number", "several", "embedding")
    asked = asked.select(task, "dim", "number", "several", "embedding", empty.cast("binary").alias("graph"))
    rows = held.union(asked).repartitionById(groups * slices, "task").sortWithinPartitions("task", "number")
    found = stored(rows.mapInArrow(lambda b: search_graphs(b, threshold), FOUND), "links")
    dropped(graphs)
    return found


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", min_shards: int = MIN_SHARDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links are pairs with cosine ``threshold`` or more.  Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do rows without id or vectors of different lengths; such a row is its own component.
    Equal vectors are compared once and link the ids that have them.  Rows that repeat an id and its vector are one vector;
    n_links counts the vectors of other ids.  An id with several vectors has a row for each, with this one's links, and joins
    their components.  An empty table gives no rows; other columns may have any names.
    """
    v = F.col("embedding")
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    sound = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = rows.where(sound)
    several = stored(usable.select("vec_id", F.xxhash64("embedding").alias("h")).distinct().groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "several_ids")
    marked = usable.join(several.withColumn("several", F.lit(True)), "vec_id", "left")
    reps = marked.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.count("*").alias("n_"), F.coalesce(F.bool_or("several"), F.lit(False)).alias("several"))
    reps = stored(reps.withColumn("number", F.monotonically_increasing_id()), "vectors")
    found = all_links(reps, threshold, min_shards, shard_rows)
    placed = stored(usable.join(several, "vec_id", "left_semi").join(reps.where("several").select("embedding", "number"), "embedding").select("vec_id", "number").distinct(), "several_places")
    same_id = placed.join(placed.groupBy("vec_id").agg(F.min("number").alias("v")), "vec_id").select(F.col("number").alias("u"), "v")
    nodes = connected(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")).union(same_id))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("number")).agg(F.sum("b").alias("n"))
    joined = stored(reps.select("number", "rep").join(nodes, F.col("number") == F.col("node"), "left").select("number", "rep", F.coalesce("component", "number").alias("component")), "joined_vectors")
    named = spread_join(joined.select("number", "component"), joined.groupBy("component").agg(F.min("rep").alias("component_id")), "component")
    known = reps.select("embedding", "number", "copies", "n_").join(counts, "number", "left").join(named.select("number", "component_id"), "number")
    known = stored(known.select("embedding", "number", "n_", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), "component_id"), "known_vectors")
    # links of an id's vector with its own other vectors
    own = found.where("kind = 2").join(placed.select(F.col("number").alias("a"), "vec_id"), "a").join(placed.select(F.col("number").alias("b"), F.col("vec_id").alias("other")), "b")
    own = own.where("vec_id = other").groupBy("vec_id", F.col("a").alias("number")).agg(F.count("*").alias("own"))
    lone = rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    met = spread_join(usable, known.drop("n_"), "embedding", counts=known.select("embedding", "n_")).join(own, ["vec_id", "number"], "left")
    linked = met.select("vec_id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n_links"), "component_id")
    return linked.union(lone).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))

"""Rows that repeat ids and vectors, small slices and graphs, recall at the threshold."""

import numpy as np
import pytest

from skein.llm import hnsw


def run(spark, rows, **how):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted((tuple(r) for r in hnsw.near_duplicates(frame, **how).collect()), key=str)


def test_repeated_rows(spark):
    a, b, c = [1.0, 0.0], [1.0, 0.1], [0.0, 1.0]
    assert run(spark, [(1, a), (1, a)]) == [(1, 0, 1, True)] * 2
    assert run(spark, [(1, a), (2, a), (2, a), (3, c)]) == [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 0, 3, True)]
    # id 1 has two vectors, near each other; id 2 is near both; id 3 far off but id 4 has its vector and one near id 1
    got = run(spark, [(1, a), (1, b), (2, a), (3, c), (4, c), (4, a)])
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 3, 1, False), (3, 1, 1, False), (4, 1, 1, False), (4, 3, 1, False)], key=str)


def test_null_ids_and_vectors(spark):
    assert run(spark, [(None, [1.0]), (None, None), (5, None), (6, [1.0]), (7, [2.0])]) == sorted([(None, 0, None, None), (None, 0, None, None), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False)], key=str)


@pytest.mark.parametrize(("slice_rows", "graphs"), [(100, 1), (40, 3)])
def test_slices_against_groups_of_graphs(spark, monkeypatch, slice_rows, graphs):
    monkeypatch.setattr(hnsw, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(hnsw, "GRAPHS_PER_TASK", graphs)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 16))
    x = np.concatenate([x, x[:60] + 0.2 * rng.standard_normal((60, 16))])
    got = run(spark, [(i, [float(v) for v in row]) for i, row in enumerate(x)], min_shards=5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    assert {r[0]: r[1] for r in got} == {i: int(near[i].sum()) - 1 for i in range(len(x))}


def test_recall_at_the_threshold():
    """Pairs of cosine 0.905 are found, and a graph survives packing."""
    rng = np.random.default_rng(8)
    x = hnsw.unit(rng.standard_normal((3000, 48)))
    noise = rng.standard_normal(x.shape)
    noise = hnsw.unit(noise - np.einsum("nd,nd->n", noise, x)[:, None] * x)
    x = np.concatenate([x, 0.905 * x + np.sqrt(1 - 0.905**2) * noise])
    graph = hnsw.Graph(x)
    assert graph.audit(0.9) >= 0.98
    graph = hnsw.Graph.unpacked(x, graph.packed())
    truth = x @ x.T >= 0.9
    found = sum(truth[i, hits].sum() for i, hits in graph.near(x.astype(np.float32), 0.9))
    assert found / truth.sum() >= 0.98


def test_low_recall_raises(spark, monkeypatch):
    monkeypatch.setattr(hnsw.Graph, "audit", lambda self, threshold: 0.5)
    with pytest.raises(RuntimeError, match="recall is 0.500"):
        run(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.1])])

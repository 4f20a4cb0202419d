"""Near copies of whole texts against brute force."""

import random

import numpy as np
import pytest

from skein.llm import nearcopies


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def near_texts(seed, groups=12, copies=8):
    """Texts with edited copies of themselves, most of them 0.6 to 1.0 similar."""
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        out.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 25))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(3000)}"
            out.append(" ".join(w))
    return out


def groups_of(texts):
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    return parent


def test_stage_drops_near_copies(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = [*near_texts(1), None, "", "  ", "one", "One", "one two", "a b c d e f", "A b c  d e f"]
    pairs = [jaccard(a, b) for i, a in enumerate(texts[:108]) for b in texts[:i]]
    assert sum(0.8 <= p < 0.95 for p in pairs) > 50
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    left = pipeline.no_near_copies(spark, docs.repartition(3), "")
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(groups_of(texts)))
    assert pipeline.no_near_copies(spark, docs.where("false"), "").count() == 0


@pytest.mark.parametrize(("pivots", "outer", "members", "many"), [(2, 1024, 4096, 4096), (1, 3, 5, 4096), (1, 3, 5, 0)])
def test_buckets_are_compared_exactly(spark, monkeypatch, pivots, outer, members, many):
    """All texts in one bucket, whichever way it is finished: the components of brute force."""
    for name, value in {"PIVOTS": pivots, "OUTER": outer, "MEMBERS": members, "MANY": many}.items():
        monkeypatch.setattr(nearcopies, name, value)
    texts = near_texts(2, 5, 9)
    boiler = [f"b{i}" for i in range(60)]  # half of each of these is the same
    texts += [" ".join(boiler + [f"own{k}x{i}" for i in range(60)]) for k in range(6)]
    held = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    buckets = nearcopies.stored(held.selectExpr("7L AS key", "node"), "one")
    got = {r.node: r.component for r in nearcopies.links(buckets, held, 5, 0.8).collect()}
    expected = groups_of(texts)
    assert {i: got.get(i, i) for i in range(len(texts))} == dict(enumerate(expected))
    assert set(got) == {i for i, c in enumerate(expected) if expected.count(c) > 1}


def test_rare_shingles_meet(spark):
    texts = near_texts(4, 4, 6)
    held = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    keys = {}
    for r in nearcopies.rare_shingles(held.select("node"), held, 5, 0.8).collect():
        keys.setdefault(r.node, set()).add(r.key)
    assert all(keys[i] & keys[j] for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8)


def test_bands_meet_at_the_bound():
    rng = np.random.default_rng(3)
    by, met = nearcopies.factors(), 0
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 110, dtype=np.uint64)
        met += bool(set(nearcopies.bands(x[:100], by)) & set(nearcopies.bands(x[11:], by)))  # 89 of 110 alike
    assert met == 300

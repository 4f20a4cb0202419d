"""Awkward input of the training-data operators: rows anywhere, blocks, long words, repeated and missing ids, infeasible targets."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import chat, decontaminate, mixing, quality, secretscan, warc
from skein.llm.common import spread_join, stored

TURNS = "conv_id long, turn long, role string, text string"


def test_stored_segments_are_read_from_any_split(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"text {t}") for c in range(40) for t in range(4)]
    made = stored(chat.segments(spark.createDataFrame(rows, TURNS)).repartition(8), "segments")
    got = chat.read_back(made).collect()
    assert sorted(r.conv_id for r in got) == list(range(40))
    assert all(r.valid and r.n_turns == 4 for r in got)


def test_rows_without_conversation_stand_alone(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "c")]
    got = chat.read_back(chat.segments(spark.createDataFrame(rows, TURNS))).collect()
    assert sorted((str(r.conv_id), r.n_turns) for r in got) == [("1", 1), ("None", 1), ("None", 1), ("None", 1)]


def matches_by_hand(texts, items, least):
    words, found = [(t or "").lower().split() for t in texts], {}
    for item, body in items:
        w = body.lower().split()
        for s in range(len(w)):
            best = {}
            for d, x in enumerate(words):
                for p in range(len(x)):
                    n = 0
                    while s + n < len(w) and p + n < len(x) and w[s + n] == x[p + n]:
                        n += 1
                    if n >= least:
                        best.setdefault(n, []).append((d, p))
            if best:
                n = max(best)
                for d, p in best[n]:
                    found[item, s, d, p] = n
    return sorted((i, s, d, p, n) for (i, s, d, p), n in found.items() if found.get((i, s - 1, d, p - 1)) != n + 1)


@pytest.mark.parametrize(("shard_words", "block_bytes"), [(1 << 19, 1 << 20), (20, 1 << 20), (20, 30)])
def test_longest_matches_do_not_depend_on_shards(spark, shard_words, block_bytes):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(25)]
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))) for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = decontaminate.longest_matches(docs, spark.createDataFrame(items, "item_id long, text string"), min_words=3, shard_words=shard_words, block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect())) == matches_by_hand(texts, items, 3)


def test_blocks_with_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(5, "x a b c"), (5, "x a b c"), (None, "d e f"), (None, "no"), (6, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "b c")], "item_id long, text string")
    got = decontaminate.digests(docs, bench, window=3, block_bytes=4).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in got) == [("5", 4, 3, 2), ("5", 4, 3, 2), ("6", 0, 0, 0), ("None", 1, 0, 0), ("None", 3, 3, 1)]


def test_long_runs_are_scanned_in_linear_time(spark):
    texts = ["a" * 400_000, "x=" + "Ab_" * 100_000, "password=" + "p" * 200_000 + "1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.monotonic()
    rows = secretscan.candidates(docs).select("doc_id", F.length("token").alias("n")).collect()
    assert time.monotonic() - began < 20
    assert (2, 200_001) in {tuple(r) for r in rows}
    assert {r.doc_id for r in rows} == {2}


def test_second_sight_of_a_token_has_its_own_surroundings(spark):
    docs = spark.createDataFrame([(None, "k=abcdef123456;k=abcdef123456"), (None, "k=abcdef123456;k=abcdef123456")], "doc_id long, text string")
    rows = secretscan.candidates(docs).orderBy("nth").collect()
    assert [(r.nth, r.before.split()[-1], r.after.strip()) for r in rows] == [(0, "k=", ";k=abcdef123456")] * 2 + [(1, "k=abcdef123456;k=", "")] * 2


def test_raking_goes_on_until_targets_are_met(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(1, 40), "a" if rng.random() < 0.9 else "b", "en" if rng.random() < 0.9 else "de") for i in range(1000)]
    docs = spark.createDataFrame([(i, t, s, lang if s == "a" else "de") for i, t, s, lang in rows] + [(2000, "w w", "b", "en"), (None, "w x", "a", "en"), (None, "w y", "a", "en"), (7, rows[7][1], "a", "en")], "doc_id long, text string, source string, lang string")
    goals = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"a": 0.5, "b": 0.5}}
    out = mixing.decided(docs, goals, topic_col="source").select("doc.source", "doc.lang", (mixing.n_tokens("doc.text") * F.col("probability")).alias("n")).toPandas()
    for margin in ("source", "lang"):
        shares = out.groupby(margin)["n"].sum() / out["n"].sum()
        assert np.allclose(shares, 0.5, atol=0.005)


def test_targets_that_cannot_be_met_raise(spark):
    docs = spark.createDataFrame([(1, "a b c", "a", "en"), (2, "d e f", "b", "de")], "doc_id long, text string, source string, lang string")
    goals = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.2, "de": 0.8}}
    with pytest.raises(ValueError, match="can't be met"):
        mixing.decided(docs, goals, topic_col="lang", strict=True)
    assert mixing.decided(docs, goals, topic_col="lang").count() == 2


@pytest.mark.parametrize("cells", [0, 200_000])
def test_raking_by_one_task_or_many(spark, monkeypatch, cells):
    monkeypatch.setattr(mixing, "ONE_TASK_CELLS", cells)
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}", f"l{i % 2}") for i in range(200)], "doc_id long, text string, source string, lang string")
    got = sorted(map(tuple, mixing.report(docs, topic_col="lang").select("doc_id", "probability").collect()))
    monkeypatch.setattr(mixing, "ONE_TASK_CELLS", 200_000)
    assert got == sorted(map(tuple, mixing.report(docs, topic_col="lang").select("doc_id", "probability").collect()))


def test_rows_of_the_sample_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in range(20) for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] * 2, "doc_id long, quality int")
    x, y = quality.sample(docs, labels, "doc_id", "text", "quality", 8)
    assert len(x) == len(y) == 8


def statistics_by_hand(text):
    words, n = text.split(), len(text)
    share = lambda f: sum(map(f, text)) / n
    return {
        "log_bytes": np.log1p(n), "log_words": np.log1p(len(words)), "mean_word": sum(map(len, words)) / len(words), "upper": share(str.isupper), "digit": share(str.isdigit), "space": share(str.isspace), "period": share(lambda c: c == "."),
        "comma": share(lambda c: c == ","), "pipe": share(lambda c: c == "|"), "distinct_words": len(set(words)) / len(words), "top_word": max(words.count(w) for w in words) / len(words),
        "twins": sum(a == b for a, b in zip(words, words[1:])) / len(words), "lines": np.log1p(len([x for x in text.split("\n") if x.strip()])), "hapax": sum(words.count(w) == 1 for w in set(words)) / len(words),  # noqa: B905
    }


def test_statistics_and_traversal_against_plain_loops():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aB1 .,|\n ") for _ in range(rng.randrange(5, 200))) for _ in range(60)]
    texts = [t for t in texts if t.split()]
    x = quality.statistics([t.encode() for t in texts])
    for row, text in zip(x, texts, strict=True):
        for name, value in statistics_by_hand(text).items():
            assert np.isclose(row[quality.FEATURES.index(name)], value), name
    trees = quality.fit(x, np.arange(len(x)) % 2.0, trees=5, depth=3)

    def walk(row):
        total = trees.base
        for t in range(5):
            k = 0
            for _ in range(3):
                f = trees.feature[t, k]
                if f < 0:
                    break
                k = 2 * k + (2 if row[f] > trees.threshold[t, k] else 1)
            total += trees.value[t, k]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x), [walk(row) for row in x])


def test_archives_are_bounded_by_bytes(spark):
    pages = spark.createDataFrame([(i, "u", "x" * 5000 + str(i)) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    path = str(warc.scratch(spark, "warc"))
    warc.write(pages, path, archive_bytes=20_000)
    sizes = [r.n for r in spark.read.format("binaryFile").load(path).select(F.length("content").alias("n")).collect()]
    assert len(sizes) == 10
    assert max(sizes) < 20_000
    assert warc.sound(warc.read(spark, path)).count() == 30


def test_a_gap_in_ones_own_archive_raises(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(warc.record(1, "u", b"x", None, "2024-01-01T00:00:00Z") + warc.END + b"junk")
    with pytest.raises(Exception, match="gap in"):
        warc.sound(warc.read(spark, str(tmp_path))).collect()


def test_hot_keys_are_spread(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (2500, "b"), (9999, "c")], "k long, name string")
    got = spread_join(left, right, "k").groupBy("name").count().collect()
    assert {r.name: r["count"] for r in got} == {"a": 2000, "b": 1}
    assert spread_join(left, right, "k", "left").count() == 3000


def test_rows_of_hot_keys_are_told_apart_without_a_join(spark):
    """As a join of all rows with the list of hot keys, whose rows grow with them, where there are any."""
    left = spark.range(3000).select(F.when(F.col("id") < 2000, 0).when(F.col("id") < 2900, F.col("id")).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (2500, "b"), (9999, "c"), (None, "d")], "k long, name string")
    met = spread_join(left, right, "k")
    told = met._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("Join ") == 1 and "LeftOuter" not in told
    assert {r.name: r["count"] for r in met.groupBy("name").count().collect()} == {"a": 2000, "b": 1}
    texts = spread_join(left.select(F.col("k").cast("string"), "id"), right.select(F.col("k").cast("string"), "name"), "k")
    assert {r.name: r["count"] for r in texts.groupBy("name").count().collect()} == {"a": 2000, "b": 1}

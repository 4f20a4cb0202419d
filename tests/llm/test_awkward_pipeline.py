"""The whole pipeline, mixing and archives over rows that are out of the ordinary."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import mixing, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars int, own string, part_ int, row long"


def prose(rng, n):
    return " ".join("".join(rng.choice("aeiounrstlm") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def tables(spark, path, rows, benchmark=(), labels=()):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_rows_of_every_kind(spark, tmp_path):
    rng = random.Random(3)
    texts = [prose(rng, 60) for _ in range(30)]
    leak = prose(rng, 14)
    rows = [(i, t, "en", "s", len(t), "x", 1, i) for i, t in enumerate(texts)]
    rows += rows[:3] + [(90, texts[5], None, None, None, None, None, None), (None, texts[6], "en", "s", 1, "", 0, 0), (None, prose(rng, 50), None, "s", 1, "", 0, 0)]
    rows += [(91, None, "en", "s", 0, "", 0, 0), (92, "", "en", "s", 0, "", 0, 0), (93, f"{prose(rng, 20)} {leak} {prose(rng, 20)}", "en", "s", 1, "", 0, 0), (94, prose(rng, 30_000), "en", "s", 1, "", 0, 0)]
    path = tables(spark, tmp_path, rows, [("b", leak), (None, None), ("c", "")])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")], name
        kept[name] = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=str)
    assert len(kept["quality"]) == len(rows)  # without labels all score alike
    ids = [i for i, _ in kept["near_dedup"]]
    assert ids.count(0) == ids.count(1) == 1 and 5 in ids and 90 not in ids and 94 in ids
    assert ids.count(None) == 1  # the one without a copy that has an id
    assert len([i for i in ids if i in (91, 92)]) == 1
    assert {i for i, _ in kept["near_dedup"]} - {i for i, _ in kept["decontaminate"]} == {93}
    assert set(kept["mix"]) <= set(kept["decontaminate"])
    out = corpus_pipeline.run(spark, path)
    assert {(r.doc_id, r.n_tokens > 0) for r in out.collect()} == {(i, True) for i, _ in kept["mix"]}


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).collect() == []


def test_long_texts(spark, tmp_path):
    rows = [(1, "word " * 400_000, "en", "s", 1, "", 0, 0), (2, "a few words", "en", "s", 1, "", 0, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    told = {r.doc_id: r.n_tokens for r in mixing.report(docs).collect()}
    assert told == {1: 400_000, 2: 3}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x").alias("url"), F.col("text").alias("html"))
    got = {r.page_id: r.payload_bytes for r in warc.round_trip(pages, archive_bytes=1000).collect()}
    assert got == {1: 2_000_000, 2: 11}

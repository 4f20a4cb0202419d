"""Abbreviations from a corpus, sentences by them, digests of any size, and reports without limits."""

import hashlib

import pytest
from pyspark.sql import functions as F

from skein.operators import index, ingest, ranges, sentences
from skein.sources import sinks

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def corpus(spark):
    texts = [f"{WORDS[i % 10]} {WORDS[(i + 3) % 10]} Dr. {WORDS[(i + 5) % 10].title()} and so {WORDS[i % 7]}. Then (etc.) more came, z.B. {WORDS[i % 9]}! On the 5. day it ended... Really? Yes." for i in range(200)]
    return spark.createDataFrame([*enumerate(texts), (900, None), (901, " \n ")], "id long, text string")


def test_abbreviations_are_learned(spark):
    found = {r.word for r in sentences.abbreviations(corpus(spark)).collect()}
    assert {"dr", "etc", "z.b"} <= found and not found & set(WORDS)
    assert sentences.abbreviations(corpus(spark).where("id >= 900")).collect() == []
    assert sentences.abbreviations(spark.createDataFrame([("no stops here",)], "text string")).collect() == []


def test_sentences_by_the_model(spark):
    docs = corpus(spark)
    rows = sentences.split(docs, ["id"], sentences.abbreviations(docs)).where("id in (0, 900, 901)").orderBy("sentence_no").collect()
    assert [r.sentence for r in rows] == ["alpha delta Dr. Zeta and so alpha.", "Then (etc.) more came, z.B. alpha!", "On the 5. day it ended...", "Really?", "Yes."]


def test_long_paragraphs_are_cut_between_sentences(spark):
    text = " ".join(f"On day {i} {' '.join(WORDS)} Dr. Who met again." for i in range(40))
    rows = spark.createDataFrame([(1, text)], "id long, text string")
    known = spark.createDataFrame([("dr",)], "word string")
    by_rule, by_model = ([r.text for r in ingest.segment(rows, "id", abbreviations=k).orderBy("seq").collect()] for k in (None, known))
    assert " ".join(by_rule) == " ".join(by_model) == text
    assert all(t.endswith("again.") for t in by_model) and any(t.endswith("Dr.") for t in by_rule)


@pytest.mark.parametrize("fan", (2, 3, 256))
def test_tree_digest_equals_a_loop(spark, fan, monkeypatch):
    monkeypatch.setattr(ranges, "range_count", lambda rows: 5)
    values = [f"v{(i * 7) % 23}" for i in range(23)] + ["v1"]
    level = [hashlib.sha256(v.encode()).hexdigest() for v in sorted(values)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    assert index.tree_version(rows, ["v"], F.col("v"), fan).collect()[0][:] == (24, level[0])
    assert index.tree_version(rows.where("false"), ["v"], F.col("v"), fan).collect()[0][:] == (0, None)


def test_report_names_every_passage(spark, tmp_path):
    """More than a thousand flagged passages and twenty joins: all are in the file, in order."""
    passages = spark.createDataFrame([(f"p{i:05}", i, "1234 5678 90 " * 9 if i % 2 else " ".join(WORDS * 2 + WORDS[:3])) for i in range(2400)], "id string, sequence int, text string")
    decisions = spark.createDataFrame([(i, 0, f"a{i}", "b", "default join") for i in range(90)], "doc_id long, place int, left string, right string, decision string")
    stages = spark.createDataFrame([(0, "read: 5"), (1, "kept: 3")], "pos int, line string")
    path = str(tmp_path / "report")
    sinks.write_report(ingest.audit_report("all", passages, decisions, stages), path)
    lines = [line for f in sorted((tmp_path / "report").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[:3] == ["Passages of all: 2400", "read: 5", "kept: 3"]
    flagged = [line for line in lines if line.startswith("p0")]
    assert len(flagged) == 2400 and flagged == sorted(flagged)
    assert flagged[0] == "p00000: Short passage (23 words)" and flagged[1] == "p00001: High non-alpha ratio 76.9% (90/117 chars)"
    assert "Passages to look at: 2400" in lines and "Default joins of hyphens: 90" in lines and sum(" > " in line for line in lines) == 90

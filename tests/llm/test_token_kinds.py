"""Token output against an untouched tokenizer: special strings, other kinds of tokenizers, long pieces, pruning."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_equals_the_plain_call(name, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 4000)  # so that caches start anew
    path = public_tokenizers.path(name)
    plain, tool = Tokenizer.from_file(path), tokens.Encoder(path, public_tokenizers.PATTERN)
    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "word", "Ünï", "x1.", "don't", "中", "a" * 300, "İ", ","]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        assert tool.text(text) == b"".join(i.to_bytes(4, "little") for i in plain.encode(text, add_special_tokens=False).ids), repr(text)


def test_special_string_is_its_token(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    row = tokens.round_trip(docs, end_id=0).first()
    assert row.n_tokens == len(Tokenizer.from_file(tokens.tokenizer_files()[0]).encode("a <|endoftext|> b", add_special_tokens=False).ids) + 1 == 5


def test_parts_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(tokens, "PART_BYTES", 100)
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(40)], "doc_id long, text string")
    assert tokens.part_count(docs) > 4
    monkeypatch.setattr(tokens, "QUANTILES", 8)
    assert [r.doc_id for r in tokens.round_trip(docs).orderBy("start").collect()] == list(range(40))


def test_row_groups_are_pruned(spark, tmp_path):
    """A lookup reads the row groups that may hold its ids alone."""
    path = str(tmp_path / "orc")
    tokens.write(spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("x y").alias("text")), path, parts=1)

    raw = tokens.read(spark, path).where("doc_id = 17").select("doc_id")
    assert [r.doc_id for r in raw.collect()] == [17]
    scan = raw._jdf.queryExecution().executedPlan()
    assert "EqualTo(doc_id,17)" in scan.toString()
    leaves = scan.collectLeaves()
    read = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    assert 1 <= read <= 2000  # of 30,000 rows in groups of 1,000

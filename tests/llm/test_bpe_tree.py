"""BPE up a tree equals the library on whole texts, wherever the seams are."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import bpetree

FILES = bpetree.vocabulary_file()
TOOL = bpetree.vocabulary(*FILES)
ODD = ["", " ", "  \n\n  ", "it'll 'll don't 's'ss", "!" * 50 + "'re", "a" * 300, "ab" * 200 + " " * 40 + "x", "é́中文字" * 30, "12345 678 \t\n 9" * 9, "\U0001f600" * 20 + "'l" + "l" * 30, "x'" + "l" * 60]


@pytest.mark.parametrize("leaf", (1, 2, 3, 7, 50))
def test_seams_anywhere(leaf, monkeypatch):
    for window in (4096, 8):
        monkeypatch.setattr(bpetree, "WINDOW", window)
        monkeypatch.setattr(bpetree, "LEAF", 8)
        for text in ODD:
            assert bpetree.encode(TOOL, text, leaf=leaf).tolist() == TOOL.plain(text), (text, leaf, window)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abest' .,\n12é中!\t"), max_size=120), st.integers(1, 9))
def test_any_text(text, leaf):
    assert bpetree.encode(TOOL, text, leaf=leaf).tolist() == TOOL.plain(text)


def test_long_runs_join_by_pairs(monkeypatch):
    """A run of letters without a cut is joined token by token, not encoded anew."""
    rng = random.Random(3)
    text = "".join(rng.choice("etaoinsrhldcu") for _ in range(30_000))
    expected = TOOL.plain(text)
    seen = []
    whole = TOOL.leaf
    monkeypatch.setattr(TOOL, "leaf", lambda t: seen.append(len(t)) or whole(t))
    assert bpetree.encode(TOOL, text).tolist() == expected
    assert max(seen) <= bpetree.WINDOW
    for low in (0, 5, 11_000):
        left, right = TOOL.plain(text[low : low + 900]), TOOL.plain(text[low + 900 : low + 2000])
        assert bpetree.joined_pairs(TOOL, left, right) == TOOL.plain(text[low : low + 2000])


def test_segments_in_order():
    text = ("some words, 'll  " * 50 + "\n" + "z" * 500) * 3
    for size in (1, 13, 400):
        parts = [text[i : i + size] for i in range(0, len(text), size)]
        found = list(bpetree.in_order(TOOL, ((p, TOOL.leaf(p)) for p in parts)))
        assert np.concatenate(found).tolist() == TOOL.plain(text)


def expected(doc_id, text):
    ids = TOOL.plain(text or "")
    return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_awkward_rows(spark):
    long = "a long text, it's " * 40 + "b" * 300 + " end"
    rows = [(1, long, "x"), (1, long, "x"), (1, long + "!", "y"), (None, long, None), (None, None, None), (2, "", "z"), (3, "tie", "t"), (3, "tie", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    for segment, leaf in ((64, 16), (1 << 18, 4096)):
        got = sorted((tuple(r) for r in bpetree.round_trip(docs, segment=segment, leaf=leaf).collect()), key=str)
        assert got == sorted((expected(i, t) for i, t, _ in rows), key=str)
        back = bpetree.decoded(bpetree.encoded(docs, segment=segment, leaf=leaf)).orderBy("part").collect()
        texts = {}
        for r in back:
            if r.part >= 0:
                texts.setdefault((r.doc_id, r.row), []).append(bytes(r.bytes))
        assert b"".join(texts[2, None]) == b""
    assert bpetree.round_trip(docs.where("false")).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r) for r in bpetree.round_trip(docs, segment=5000, leaf=512).collect()}
    assert got == {r.doc_id: expected(r.doc_id, r.text) for r in docs.collect()}

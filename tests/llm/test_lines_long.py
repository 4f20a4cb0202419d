"""Line deduplication: long lines, shared halves, hashes of variants."""

import time

from skein.llm import linededup


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_variant_hashes():
    words = [b"a", b"b", b"b", b"c", b"a"]
    whole, without = linededup.deletions(words)
    without = list(without)
    assert len(set(without)) == 4  # the equal neighbours leave one rest
    assert without == [linededup.deletions(words[:p] + words[p + 1 :])[0] for p in range(5)]
    assert whole == linededup.deletions(list(words))[0] != linededup.deletions(words[::-1])[0] or words == words[::-1]
    assert linededup.deletions([])[0] == 0


def test_very_long_lines(spark):
    base = [f"w{i % 977}" for i in range(100_000)]
    changed, shorter, other = [*base], base[:70_000] + base[70_001:], base[:50_000] + ["z"] * 50_000
    changed[99_999] = "new"
    began = time.monotonic()
    got = linededup.duplicates(docs_of(spark, [" ".join(x) for x in (base, changed, shorter, other, base)])).collect()
    assert sorted((r.doc_id, r.n_words, r.near, r.earlier_doc_id) for r in got) == [(1, 100_000, True, 0), (2, 99_999, True, 0), (4, 100_000, False, 0)]
    assert time.monotonic() - began < 60


def test_all_kinds_beside_each_other(spark):
    """A line that has a longer, an equal and a shorter neighbour, and four words that match only a fifth."""
    texts = ["a b c d e f g", "a b c d e f", "a b c x e f", "a b c d f", "q r s t", "q r s u", "q r s t v", "q r s t"]
    got = {r.doc_id: (r.near, r.earlier_doc_id) for r in linededup.duplicates(docs_of(spark, texts)).collect()}
    assert got == {1: (True, 0), 2: (True, 1), 3: (True, 1), 6: (True, 4), 7: (False, 4)}

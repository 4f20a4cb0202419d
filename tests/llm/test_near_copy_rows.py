"""The near-copy stage decides by row, not by id."""

from pyspark.sql import functions as F

from skein.llm import nearcopies


def test_repeated_and_missing_ids(spark):
    rows = [(7, "a b c d e f g"), (7, "q r s t u v w"), (3, "a b c d e f g"), (None, "q r s t u v w"), (None, "k l m n o p"), (None, "k l m n o p"), (9, "z z y")]
    left = nearcopies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [(3, "a b c d e f g"), (7, "q r s t u v w"), (None, "k l m n o p"), (9, "z z y")]))


def test_texts_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """With a hash that puts all texts of one length together, no text is lost."""
    monkeypatch.setattr(nearcopies, "text_hash", lambda text: F.length(text).cast("long"))
    rows = [(1, "a b c d e f g"), (2, "h i j k l m n"), (3, "a b c d e f g"), (4, "a b c d e f g h"), (5, "other words here and more")]
    left = {r.doc_id for r in nearcopies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left >= {1, 2, 5} and 3 not in left

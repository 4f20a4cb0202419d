"""Search over small passages."""

import pytest
from pyspark.sql import functions as F

from skein.operators import index, search
from skein.plans.adapters import batch

P = "id string, source_id string, title string, sequence int, page_ref string, chapter_ref string, text string"


def passages(spark, *texts, title="t"):
    return spark.createDataFrame([(f"d{i}", f"s{i % 2 + 1}", title, i, f"p.{i}", "c", t) for i, t in enumerate(texts)], P)


def sources(spark, disabled=()):
    rows = [(f"s{i}", f"Source {i}", "snippet", 2, i, f"s{i}" not in disabled) for i in (1, 2, 3)]
    return spark.createDataFrame(rows, "id string, title string, display_mode string, context_words int, sort_order int, enabled boolean")


def found(spark, q, *texts, **how):
    return sorted(r.id for r in search.matches(batch(spark, (q, None)), passages(spark, *texts), **how).collect())


@pytest.mark.parametrize(
    ("q", "texts", "expected"),
    [
        ("alpha beta", ["alpha x", "beta alpha", "gamma"], ["d1"]),
        ('"river stone"', ["stone by the river", "river"], ["d0"]),
        ('"red" "blue"', ["red", "blue", "green"], ["d0", "d1"]),
        ('"red" blue', ["red", "red blue"], ["d1"]),
        ('" " blue', ["blue"], []),
        ("  ", ["blue"], []),
        ("havent got", ["I haven't got it", "have got"], ["d0"]),
        ("spirit", ["spirits", "spiral"], ["d0"]),
    ],
)
def test_matches(spark, q, texts, expected):
    assert found(spark, q, *texts) == expected


def test_strict_phrase(spark):
    texts = ["stone by the river", "a river, stone", "river the stone"]
    assert found(spark, '"river stone"', *texts, phrase_mode="strict") == ["d1"]
    assert set(found(spark, '"river stone"', *texts, phrase_mode="strict")) <= set(found(spark, '"river stone"', *texts))


def test_and_spans_fields(spark):
    rows = spark.createDataFrame([("d0", "s1", "alpha", 0, "p.0", "c", "beta")], P)
    assert search.matches(batch(spark, ("alpha beta", None)), rows).count() == 1


def test_exact_within_fuzzy(spark):
    texts = ["creator", "creators of", "craetor"]
    exact, fuzzy = found(spark, "creator", *texts, fuzzy=False), found(spark, "creator", *texts)
    assert exact == ["d0"]
    assert set(exact) <= set(fuzzy) == {"d0", "d1"}


def test_synonyms(spark):
    synonyms = spark.createDataFrame([("a", ["b z"])], "term string, synonyms array<string>")
    run = lambda q, **how: sorted((r.id, r.by_synonym) for r in search.matches(batch(spark, (q, None)), passages(spark, "only z", "a", "x"), synonyms, **how).collect())
    assert run("A") == [("d0", True), ("d1", False)]
    assert run("A", synonym_combine="and") == [("d1", False)]
    assert run('"a"') == [("d1", False)]


def test_results(spark):
    rows = passages(spark, "red one", "red two", "red three", "blue")
    out = search.results(batch(spark, ("red", ["s2", "s1", "s2"]), ("red", None)), rows, sources(spark)).orderBy("query_id", "group_pos", "pos").collect()
    assert [(r.query_id, r.group_pos, r.pos, r.passage_id) for r in out] == [("q0", 0, 1, "d1"), ("q0", 1, 1, "d0"), ("q0", 1, 2, "d2"), ("q1", 1, 1, "d0"), ("q1", 1, 2, "d2"), ("q1", 2, 1, "d1")]
    assert all(r.citation is None for r in out)
    nested = search.grouped(search.results(batch(spark, ("red", None)), rows, sources(spark))).orderBy("group_pos").collect()
    assert [[x.passage_id for x in r.results] for r in nested] == [["d0", "d2"], ["d1"]]


def test_disabled_source(spark):
    out = search.results(batch(spark, ("red", None), ("red", ["s1"])), passages(spark, "red", "red"), sources(spark, disabled=("s1",)))
    assert [r.passage_id for r in out.collect()] == ["d1"]


def test_hints(spark):
    known = spark.createDataFrame([(["acceptance"], "T", "B", None)], "match array<string>, title string, body string, link struct<label:string,url:string>")
    out = search.hints(batch(spark, ("a", None), ("my Acceptance now", None), ("zebra", None)), known)
    assert sorted(r.query_id for r in out.collect()) == ["q0", "q1"]


def test_adjacent(spark):
    out = search.adjacent(passages(spark, "a", "b", "c", "d", "e")).where("source_id = 's1'").orderBy("sequence").collect()
    assert [(r.previous_id, r.next_id) for r in out] == [(None, "d2"), ("d0", "d4"), ("d2", None)]


def test_version(spark):
    make = lambda *rows: index.version(spark.createDataFrame(list(rows), "id string, content string")).first().version
    assert make(("a", "x"), ("b", "y")) == make(("b", "y"), ("a", "x")) != make(("a", "x"), ("b", "z"))
    assert len(make(("a", "x"))) == 16
    one, two = (index.content_version(passages(spark, *t)).collect() for t in (("a", "b"), ("a", "c")))
    assert {r.version for r in one} != {r.version for r in two}


def test_empty_tables(spark):
    rows = passages(spark, "x").where("false")
    assert search.results(batch(spark, ("red", None)), rows, sources(spark)).count() == 0
    assert index.postings(rows).count() == 0


def test_bm25_orders_by_frequency(spark):
    out = search.bm25(batch(spark, ("red", None)), passages(spark, "red red red", "red a b", "c d e", "f g h")).orderBy(F.desc("score")).collect()
    assert [r.id for r in out] == ["d0", "d1"]

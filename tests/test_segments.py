"""Postings in segments: every place without a shuffle; results are placed without their texts; first hits against a plain loop."""

import random
import re

from pyspark.sql import functions as F

from skein.functions import kwic
from skein.operators import index, search
from skein.plans import adapters as ad
from skein.sources import files, sinks

SF = "/root/testdata/sf0.001"
P = "id string, source_id string, title string, sequence int, page_ref string, chapter_ref string, text string"
ODD = [("a", "s", None, 0, "", "", None), ("b", "s", "", 1, "", "", " .\n"), ("c", "s", "x Y", 2, "", "y", "\n'x’\tz, y\n"), ("d", "s", "ß", 3, "", "𝛂", "𝛂 ﬁ ÉTÉ İ x x"), ("e", "s", "t", 4, "", "t", "t " * 3000)]


def exchanges(df):
    """The columns of each exchange of a plan."""
    todo, out = [df._jdf.queryExecution().executedPlan().initialPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            out.append(re.findall(r"(\w+)#", node.output().mkString(",")))
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_segments_have_every_place_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(index, "SEGMENT_BYTES", 3000)
    monkeypatch.setattr(index, "SEGMENT_ROWS", 7)
    monkeypatch.setattr(index, "SENT_HITS", 5)
    rows = ad.passages(spark, SF).select("id", "source_id", "title", "sequence", "page_ref", "chapter_ref", "text").union(spark.createDataFrame(ODD, P))
    made = index.segments(rows)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = index.token_places(rows).groupBy("term", "field", "id", "source_id").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("places"))
    told = lambda df: sorted(map(repr, df.collect()))
    assert told(index.hits_of(made)) == told(want)
    assert told(index.vocabulary_of(made)) == told(index.vocabulary(rows))
    assert index.segments(rows.where("false")).count() == 0


def test_segments_are_sorted_and_count_repeated_ids(spark):
    rows = spark.createDataFrame([("a", "s", "x", 0, "", "", "y x y"), ("a", "s", "", 1, "", "", "x")], P).coalesce(1)
    assert [(r.term, r.field, r.passages, [(h.id, h.tf, h.places) for h in r.hits]) for r in index.segments(rows).collect()] == [
        ("x", "text", 2, [("a", 1, [1]), ("a", 1, [0])]), ("x", "title", 0, [("a", 1, [0])]), ("y", "text", 1, [("a", 2, [0, 2])]),
    ]


def test_texts_of_results_are_shuffled_once(spark):
    out = search.results(ad.batch(spark, ("erst heon", None), ("thion", ["src3", "src1"])), ad.index(spark, SF), ad.sources(spark, SF), synonyms=ad.synonyms(spark))
    assert sum("text" in columns for columns in exchanges(out)) <= 1


def test_results_of_repeated_ids_have_their_own_texts(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s1", "", 0, "p.1", "c", "red one"), ("a", "s1", "", 1, "p.2", "c", "red two"), ("a", "s2", "", 0, "p.1", "c", "blue")], P)
    sources = spark.createDataFrame([(s, s, "snippet", 9, 1, True) for s in ("s1", "s2")], "id string, title string, display_mode string, context_words int, sort_order int, enabled boolean")
    sinks.write_index(rows, sources.select("id", F.lit("x").alias("content")), str(tmp_path / "ix"))
    for corpus in (rows, files.index(spark, str(tmp_path / "ix"))):
        out = search.results(ad.batch(spark, ("red", None)), corpus, sources).orderBy("source_id", "pos").collect()
        assert [(r.source_id, r.pos, r.kwic.replace(kwic.MARK, "").replace(kwic.END_MARK, "")) for r in out] == [("s1", 1, "red one"), ("s1", 2, "red two"), ("s2", 1, "blue")]


def hit_by_loop(words, terms):
    bare = lambda x: re.sub("[^a-z0-9']", "", x.lower())
    plain, wanted = [bare(w) for w in words], [[bare(x) for x in re.split(r"\s+", t)] for t in terms]
    return next((i for i in range(len(plain)) if any(all(i + j < len(plain) and x in plain[i + j] for j, x in enumerate(t)) for t in wanted)), None)


def test_first_hit_equals_a_loop(spark):
    rng = random.Random(3)
    some = ["a", "ab", "b.a", "é", "É'", "B", "ba", "—", "a1", "İ", "Σ", "aab", "(", "\\"]
    cases = [([], [""]), (["é"], [""]), (["x"], []), (["a", "b"], ["a b "]), (["ab", "—", "b"], ["b é b"])]
    cases += [([rng.choice(some) for _ in range(rng.randrange(8))], [" ".join(rng.choice(some) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3))]) for _ in range(400)]
    rows = spark.createDataFrame([(i, w, t) for i, (w, t) in enumerate(cases)], "i int, w array<string>, t array<string>")
    got = {r.i: r.hit for r in rows.select("i", kwic.first_hit(F.col("w"), F.col("t")).alias("hit")).collect()}
    assert got == {i: hit_by_loop(w, t) for i, (w, t) in enumerate(cases)}

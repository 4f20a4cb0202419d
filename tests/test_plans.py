"""Plans: scans that read the wanted terms alone, work that stays within rows, splitting against a plain loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skein.operators import index, ingest, search, usage, validate
from skein.plans import adapters as ad
from skein.sources import files, sinks

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_reads_wanted_terms(spark):
    found = search.matches(ad.batch(spark, ('"in the" erst', None)), ad.index(spark, SF), phrase_mode="strict")
    told = found._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^]]*In\(term", told) or re.search(r"PushedFilters: \[[^]]*EqualTo\(term", told)
    assert "documents.parquet" not in told


def test_parts_of_the_index_are_written_as_they_are_asked_for(spark, monkeypatch):
    monkeypatch.setattr(ad, "_BUILT", {})
    made, write = [], sinks.write_index
    monkeypatch.setattr(sinks, "write_index", lambda rows, registry, path, parts: (made.append(list(parts)), write(rows, registry, path, parts)))
    assert ad.index_meta(spark, SF).count() == 1 and ad.vocabulary(spark, SF).count() > 0 and made == [["meta"], ["vocabulary"]]
    assert ad.index(spark, SF).vocabulary.count() == ad.vocabulary(spark, SF).count() and made[2:] == [["postings", "passages"]]


def test_many_terms_are_joined(spark, monkeypatch):
    monkeypatch.setattr(search, "MOST_TERMS", 1)
    held = ad.index(spark, SF)
    joined = search.matches(ad.batch(spark, ("the erst", None)), held).collect()
    monkeypatch.setattr(search, "MOST_TERMS", 2000)
    assert sorted(joined) == sorted(search.matches(ad.batch(spark, ("the erst", None)), held).collect())


def test_hyphens_need_no_shuffle(spark):
    assert "Exchange" not in plan(ingest.repair_hyphens(ad.dirty(spark, SF, ad.BREAKS), "doc_id"))


def test_postings_have_all_places(spark):
    rows = spark.createDataFrame([("a", "s", "t", "c", "x y x"), ("b", "s", "x", "", "")], "id string, source_id string, title string, chapter_ref string, text string")
    got = {(r.term, r.field, r.id): (r.tf, r.places) for r in index.postings(rows).collect()}
    assert got == {("x", "text", "a"): (2, [0, 2]), ("y", "text", "a"): (1, [1]), ("t", "title", "a"): (1, [0]), ("c", "chapter_ref", "a"): (1, [0]), ("x", "title", "b"): (1, [0])}
    assert {(r.term, r.field): (r.passages, r.times) for r in index.term_counts(rows).collect()}[("x", "text")] == (1, 2)


def test_postings_shuffle_a_row_for_each_term_of_a_passage(spark):
    """Once, without gathering what arrives; ranges ascend and keep every row, whatever the bounds."""
    rows = ad.passages(spark, SF)
    made = index.postings(rows)
    told = plan(made)
    assert told.count("Exchange") == 1 and "Aggregate" not in told
    want = index.token_places(rows).groupBy("term", "field", "id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("places"))
    assert made.select("term", "field", "id", F.col("tf").cast("long"), "places").exceptAll(want.select("term", "field", "id", "tf", "places")).isEmpty() and made.count() == want.count()
    ends = made.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.min("term").alias("a"), F.max("term").alias("z")).orderBy("p").collect()
    assert len(ends) > 1 and all(x.z <= y.a for x, y in zip(ends, ends[1:]))
    cuts = [("b", 3), ("b", 9), ("ü", 0)]
    cases = [("a", 15, 0), ("b", 2, 0), ("b", 3, 1), ("b", 9, 2), ("c", 0, 2), ("ü", 0, 3), ("𝛂", 1, 3)]
    got = spark.createDataFrame(cases, "term string, split int, want int").select("want", index.part_of(cuts).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def parts_by_loop(text):
    """Parts of a paragraph by the rule, step by step."""
    out, rest = [], re.split(r"(?<=[.!?])\s+", text.strip())
    size = lambda s: len(s.split())
    while sum(map(size, rest)) > 300:
        sums = [sum(map(size, rest[: i + 1])) for i in range(len(rest))]
        best = min(range(len(rest)), key=lambda i: (abs(sums[i] - 150), i)) + 1
        first, rest = rest[:best], rest[best:]
        words = " ".join(first).split()
        if len(first) == 1 and len(words) > 300:
            out += [" ".join(words[:150]), " ".join(words[150:])]
        else:
            out.append(" ".join(first))
        if not rest:
            return out
    return [*out, " ".join(rest)] if rest else out


def test_split_long_equals_a_loop(spark):
    rng = random.Random(5)
    texts = ["", "  ", "one.", " ".join(["w"] * 700)]
    for _ in range(300):
        top = rng.choice((5, 40, 200, 420))
        texts.append("  ".join(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, top))) + rng.choice(".!?") for _ in range(rng.randrange(1, 40))))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.p for r in rows.select("i", ingest.split_long("t").alias("p")).collect()}
    assert got == {i: parts_by_loop(t) for i, t in enumerate(texts)}


def test_numbers_and_blanks_of_the_log(spark):
    made = spark.createDataFrame([("a", 1e10, None), ("b", 2.75, None), ("c", float("nan"), None), ("\t", 1.0, None), ("﻿ ", 1.0, None), (" d\t", -1.0, None)], "q string, result_count double, source_filter array<string>")
    out = {r.q: r.result_count for r in usage.sanitize(made, F.lit("t")).collect()}
    assert set(out) == {"a", "b", "c", " d\t"}
    assert (out["a"], out["b"], out[" d\t"]) == (1e10, 2.75, 0.0)
    log = spark.createDataFrame([("1", "t", "foo", 1.0, None), ("2", "t", "foo\t", 1.0, None), ("3", "s", "x", 1.0, None)], "key string, ts string, q string, result_count double, source_filter array<string>")
    assert [r.key for r in usage.recent_queries(log).collect()] == ["1", "2", "3"]
    assert {(r.norm, r["count"]) for r in usage.query_stats(log).collect()} == {("foo", 2), ("x", 1)}


def test_strict_registry_raises(spark):
    rows = ad.sources(spark, SF).withColumn("color", F.when(F.col("sort_order") == 3, F.lit(None).cast("string")).otherwise(F.col("color")))
    with pytest.raises(Exception, match="bad source src3"):
        validate.strict_registry(rows).collect()


def test_stage_is_never_overwritten(spark, tmp_path):
    sinks.write_stage(spark.range(1), str(tmp_path), "r", "s")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_stage(spark.range(1), str(tmp_path), "r", "s")


def test_bad_files_raise(spark, tmp_path):
    (tmp_path / "src1.json").write_text('[{"id": "a", "sourceId": "other", "text": "x"}]')
    with pytest.raises(Exception, match="bad passage in src1.json"):
        files.passages(spark, str(tmp_path), ad.sources(spark, SF)).collect()
    (tmp_path / "c.json").write_text('[{"chapterRef": "a", "title": "t", "startPage": 1}]')
    with pytest.raises(Exception, match="chapter lacks a key"):
        files.chapters(spark, str(tmp_path / "c.json")).collect()
    with pytest.raises(FileNotFoundError):
        files.registry(spark, [str(tmp_path / "none")])


def test_pages_of_many_sources_are_ingested_apart(spark):
    page = lambda n: "HEAD\n" + " ".join([f"word{n}"] * 24) + " end.\n"
    rows = spark.createDataFrame([(s, p, page(p)) for s in ("bk", "other") for p in (3, 1, 2)], "source_id string, page int, text string")
    out = ingest.ingest(rows).orderBy("id").collect()
    assert [(r.id, r.page_ref) for r in out] == [(f"{s}-unknown-p000{p}", f"p.{p}") for s in ("bk", "other") for p in (1, 2, 3)]
    assert [r.id for r in ingest.ingest(rows, "bk").orderBy("id").collect()] == [r.id for r in out[:3]]

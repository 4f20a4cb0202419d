"""Ingest, daily entries, raw files, validation and usage."""

import json

from pyspark.sql import functions as F

from skein.operators import daily, ingest, registry, usage, validate
from skein.plans import queries
from skein.sources import files, sinks
from skein.streaming import log as stream


def texts(spark, *rows):
    return spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(rows)], "k string, text string")


def test_hyphens(spark):
    rows = texts(spark, "a-\nbe-\nco", "self-\nwill and pgm-\nstep and unfor-\n  tunate", "dis-\n\ngusted x", "no breaks", "")
    out = {r.k: r.text for r in ingest.repair_hyphens(rows, "k").collect()}
    assert out == {"k0": "abe- co", "k1": "self-will and pgm-step and unfortunate", "k2": "disgusted x", "k3": "no breaks", "k4": ""}


def test_hyphen_dictionary(spark):
    words = spark.createDataFrame([("disgusted",), ("well-being",)], "word string")
    rows = ingest.hyphen_candidates(texts(spark, "dis-\ngusted well-\nbeing a-\nbout"), "k", ingest.OVER_LINE)
    out = ingest.hyphen_decisions(rows, words, compounds=()).orderBy("place").collect()
    assert [(r.decision, r.replacement) for r in out] == [("dict match", "disgusted"), ("dict hyphenated", "well-being"), ("default join", "about")]
    counts = ingest.hyphen_counts(ingest.hyphen_decisions(rows, words, compounds=())).first()
    assert tuple(counts) == (3, 2, 1, 1)


def test_strip(spark):
    page = lambda n: f"<<<PAGE {n}>>>\n\nHEAD\nbody {chr(96 + n)} goes on and on\n58"
    rows = ingest.lines(texts(spark, "\n\n".join(page(n) for n in range(1, 5))), "k")
    out = ingest.strip_lines(rows, "k", ["^body b"]).where("reason is not null").groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in out} == {"pattern: ^body b": 1, "digit-only": 4, "auto header/footer": 4}


def test_segment_and_chapters(spark):
    block = lambda n: " ".join(["word"] * n)
    sentences = " ".join(" ".join([f"w{i}"] * 29) + " end." for i in range(11))
    body = f"{block(19)}\n\n<<<PAGE 4>>>\n\n{block(20)}\n\n<<<PAGE 9>>>\n\n{sentences}"
    out = ingest.segment(texts(spark, body), "k").orderBy("seq").collect()
    assert [(r.seq, r.page_ref) for r in out] == [(1, "p.4"), (2, "p.9"), (3, "p.9")]
    assert [len(r.text.split()) for r in out] == [20, 150, 180]
    chapters = spark.createDataFrame([("B", "b", 3, 6), ("A", "a", 2, 5)], "chapter_ref string, title string, start_page int, end_page int")
    told = ingest.assign_chapters(ingest.segment(texts(spark, body), "k"), chapters, F.substring("page_ref", 3, 9).cast("int"))
    assert [r.chapter_ref for r in told.orderBy("seq").collect()] == ["A", "Front Matter", "Front Matter"]
    assert ingest.assign_chapters(told.drop("chapter_ref", "chapter_title"), None, F.lit(1)).first().chapter_ref == "Unknown"


def test_one_long_sentence_is_cut_once(spark):
    out = spark.createDataFrame([(" ".join(["w"] * 700),), (None,)], "t string").select(ingest.split_long("t").alias("p")).collect()
    assert [len(x.split()) for x in out[0].p] == [150, 550]
    assert out[1].p == []


def test_audit_order(spark):
    rows = spark.createDataFrame([("a", " ".join(["w1"] * 5 + ["word"] * 22)), ("b", "1 2 3 4 5 6 word"), ("c", " ".join(["plain"] * 40)), ("d", "")], "id string, text string")
    assert {r.id: r.flag for r in ingest.audit(rows).collect()} == {"a": "short", "b": "non-alpha"}
    known = spark.createDataFrame([("plain",)], "word string")
    assert {r.id: r.flag for r in ingest.audit(rows, known).collect()} == {"a": "unknown words", "b": "non-alpha"}


def test_encoding(spark):
    out = texts(spark, "cafÃ©", "plain\x07", "é").select(ingest.repair_encoding("text").alias("t")).collect()
    assert [r.t for r in out] == ["café", "plain", "é"]


def test_ingest_whole(spark):
    rows = spark.createDataFrame([("bk", p, "HEAD\n" + " ".join(["word"] * 24) + " self-\nwill.\n") for p in (1, 2, 3)], "source_id string, page int, text string")
    out = ingest.ingest(rows, "bk").orderBy("sequence").collect()
    assert [r.id for r in out] == ["bk-unknown-p0001", "bk-unknown-p0002", "bk-unknown-p0003"]
    assert all("self-will" in r.text and "HEAD" not in r.text for r in out)


def test_daily(spark):
    rows = spark.createDataFrame([(0, 'noise\nJUNE  5\n"A TITLE"\nbody  one\n\nbody two'), (1, "June 5\nOther\nlate"), (2, "no date"), (3, "MAY 1")], "page_pos int, text string")
    out = daily.entries(rows).collect()
    assert [(r.id, r.title, r.chapter_ref, r.text, r.sequence) for r in out] == [("dr-06-05", "A TITLE", "June 5", "body one body two", 1)]
    calendar = files.calendar(spark)
    assert calendar.count() == 366
    have = spark.createDataFrame([("01-01", "t", "x"), ("01-02", "t", "y")], "date string, title string, text string")
    assert daily.missing(calendar, have).count() == 364
    merged = daily.resumed(calendar, have, spark.createDataFrame([("01-02", "n", "new"), ("02-29", "n", "leap")], "date string, title string, text string"))
    assert sorted((r.date, r.text, r.reused) for r in merged.collect()) == [("01-01", "x", True), ("01-02", "y", True), ("02-29", "leap", False)]
    assert daily.checks(daily.entries(queries.daily_texts(spark, "/root/testdata/sf0.001"))).first().has_leap_day


def test_html(spark):
    html = '<h1> A <b>T</b></h1><div class="field--name-body x"><p>one</p>\n two</div>'
    rows = spark.createDataFrame([(1, html), (2, "<p>x</p>"), (3, None)], "page_id long, html string")
    assert [(r.title, r.text) for r in daily.extract_html(rows).orderBy("page_id").collect()] == [("A T", "one two"), ("Daily Reflection", None), ("Daily Reflection", None)]


def test_registry(spark):
    rows = spark.createDataFrame([("green-book", "Green Book", "GB", 1, True), ("steps", "Steps and Ways", "S", 2, False)], "id string, title string, short_title string, sort_order int, enabled boolean")
    names = spark.createDataFrame([("Green Book (2nd).pdf",), ("zzz.txt",)], "name string")
    out = {r.name: (r.status, r.suggested_source_id) for r in registry.scan_raw(names, rows).collect()}
    assert out == {"Green Book (2nd).pdf": ("existing", "green-book"), "zzz.txt": ("new", "zzz")}
    assert sorted((r.id, r.group_pos) for r in registry.active(rows, ["steps", "?", "green-book", "steps"]).collect()) == [("green-book", 2), ("steps", 0)]
    assert [r.id for r in registry.active(rows).collect()] == ["green-book"]
    assert registry.toggled(["a"], "a") == ["a"]
    assert registry.toggled(["a"], "b") == ["a", "b"]


def test_validate_json(spark):
    good = {"id": "a", "sourceId": "s", "title": "", "sequence": 1, "date": None, "text": "x"}
    cases = [good, good, good | {"id": "b", "sequence": "1"}, {k: v for k, v in good.items() if k != "date"} | {"id": "c"}, good | {"id": "d", "text": " "}, good | {"id": "e", "sourceId": "z", "pageRef": 3}]
    rows = spark.createDataFrame([("s", n, json.dumps(c)) for n, c in enumerate(cases)], "file_source string, n int, json string")
    out = sorted((r.n, r.rule.split(" must")[0]) for r in validate.passages_json(rows).collect())
    assert out == [(1, "duplicate id"), (2, "sequence"), (3, "date"), (4, "text"), (5, "pageRef"), (5, "sourceId")]


def test_final_gate(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s", 1, "x"), ("b", "s", 3, "y\nz")], "id string, source_id string, sequence int, text string")
    assert sorted(r.rule for r in validate.final(rows).collect()) == ["sequence has a gap", "text has a line end"]
    assert not sinks.write_final(rows, validate.final(rows), str(tmp_path / "a"))
    assert sinks.write_final(rows.limit(1), validate.final(rows.limit(1)), str(tmp_path / "b"))


def test_usage(spark):
    made = spark.createDataFrame([("x" * 600, -3.0, [f"{i}" * 60 for i in range(9)] + ["a", "b", None]), (" ", 1.0, None), (None, 1.0, None), ("ok", None, None)], "q string, result_count double, source_filter array<string>")
    out = usage.sanitize(made, F.lit("t")).collect()
    assert [(len(r.q), r.result_count) for r in out] == [(500, 0), (2, 0)]
    assert ([len(x) for x in out[0].source_filter], out[1].source_filter) == ([50] * 9 + [1], None)
    log = spark.createDataFrame([("1", "t1", "Fear", 2, ["s1", "s1"]), ("2", "t2", "fear ", 3, None), ("3", "t3", "hope", 1, []), ("4", "t4", " ", 9, ["s1"])], "key string, ts string, q string, result_count int, source_filter array<string>")
    top = usage.top_queries(log).collect()
    assert [(r.q, r["count"], r.total_results, r.last_seen) for r in top] == [("Fear", 2, 5, "t2"), ("hope", 1, 1, "t3")]
    assert [(r.source_id, r["count"]) for r in usage.filter_usage(log).collect()] == [("s1", 2)]
    assert tuple(usage.summary(log).first()) == (3, "t1", "t3")
    assert tuple(usage.summary(log.where("false")).first()) == (0, None, None)
    queue = spark.range(105).select(F.format_string("%04d", "id").alias("key"))
    assert sorted(r.key for r in usage.newest(queue).collect()) == [f"{i:04d}" for i in range(5, 105)]
    assert len(usage.dashboard(log).first().top_queries) == 2


def test_payload(spark):
    rows = spark.createDataFrame([('{"q": "a", "resultCount": 2, "sourceFilter": ["s1", 5]}',), ('{"q": 3}',), ('"x"',), ("not json",)], "payload string")
    assert [(r.q, r.result_count, r.source_filter) for r in usage.parse_payload(rows).collect()] == [("a", 2.0, ["s1"])]


def test_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    source = {"id": "s1", "title": "S", "shortTitle": "S", "description": "", "copyright": "unknown", "displayMode": "snippet", "contextWords": 3, "color": "#1", "sortOrder": 1, "enabled": True}
    (tmp_path / "sources.json").write_text(json.dumps({"sources": [source | {"id": "s2", "sortOrder": 2, "enabled": False}, source]}))
    (tmp_path / "p" / "s1.json").write_text(json.dumps([{"id": "a", "sourceId": "s1", "text": "x"}]))
    rows = files.registry(spark, [str(tmp_path / "none.json"), str(tmp_path / "sources.json")])
    assert [r.id for r in rows.collect()] == ["s1", "s2"]
    assert validate.registry(rows).count() == 0
    assert validate.strict_registry(rows).count() == 2
    found = files.passages(spark, str(tmp_path / "p"), rows).collect()
    assert [(r.id, r.title, r.sequence, r.date) for r in found] == [("a", "", 0, None)]
    names = files.file_names(spark, str(tmp_path / "p"))
    assert [r.name for r in names.collect()] == ["s1.json"]
    assert files.missing_files(rows, names).count() == 0
    (tmp_path / "book.txt").write_bytes(b"first\r\nline\n<<<PAGE 7>>>\nseventh")
    assert [(r.page, r.text) for r in files.text_pages(spark, str(tmp_path / "book.txt")).orderBy("page").collect()] == [(1, "first\nline\n"), (7, "seventh")]
    (tmp_path / "ff.txt").write_bytes(b"one\x0ctwo\xff")
    assert [r.text for r in files.form_feed_pages(spark, str(tmp_path / "ff.txt")).collect()] == ["one", "two�"]
    (tmp_path / "syn.json").write_text('{"a": ["b", "c d"]}')
    assert files.synonyms(spark, str(tmp_path / "syn.json")).first().synonyms == ["b", "c d"]


def test_index_and_log_sinks(spark, tmp_path):
    rows = queries.ad.passages(spark, "/root/testdata/sf0.001").limit(20)
    sinks.write_index(rows, spark.createDataFrame([("s", "c")], "id string, content string"), str(tmp_path / "ix"))
    stored = files.index(spark, str(tmp_path / "ix"))
    assert stored.passages.count() == 20
    assert stored.vocabulary.count() > 0
    log = spark.createDataFrame([("2024-01-01T00:00:00.000Z", "q", 1, ["s"])], "ts string, q string, result_count int, source_filter array<string>")
    sinks.append_log(log, str(tmp_path / "log"))
    sinks.append_log(log, str(tmp_path / "log"))
    again = files.log(spark, str(tmp_path / "log")).collect()
    assert [(r.q, r.result_count, r.source_filter) for r in again] == [("q", 1, ["s"])] * 2
    assert all(r.key.startswith("2024-01-01T00-00-00-000Z-") for r in again)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"q":"a","resultCount":-1}\n{"q":"  "}\n')
    for _ in range(2):  # the checkpoint keeps the second run from writing again
        stream.write_log(stream.posted(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r.q, r.result_count) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 0)]


def test_encoding_repair_sends_only_what_it_must(spark):
    """What stays in the JVM is what Python would leave alone."""
    import random
    import re
    import unicodedata

    rng = random.Random(8)
    pools = ["abc é ñ ü\x07\n", "Ã©â€™Â ", "éÅ豈가", "“x” – €…", "日本語йЖй", "\x00\x1f\x7fz"]
    made = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(9))) for _ in range(400)]
    made += ["naïve café".encode().decode("cp1252"), "naïve".encode().decode("cp1252").encode().decode("cp1252"), "plain é", ""]

    def by_hand(text):
        for _ in range(2):
            try:
                again = text.encode("cp1252").decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                break
            text = again
        return unicodedata.normalize("NFC", re.sub(ingest.CONTROLS, "", text))

    rows = spark.createDataFrame([*enumerate(made), (-1, None)], "i long, text string")
    got = {r.i: r.t for r in rows.select("i", ingest.repair_encoding("text").alias("t")).collect()}
    assert got.pop(-1) is None
    assert got == {i: by_hand(t) for i, t in enumerate(made)}

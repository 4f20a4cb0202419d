"""Scalar functions, the query language and keyword in context."""

import pytest
from pyspark.sql import functions as F

from skein.functions import kwic as kw
from skein.functions import query, text


def value(spark, column, **inputs):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
    return frame.select(column.alias("x")).first().x


def at(spark, column, x):
    return value(spark, column, x=x)


def test_parse(spark):
    parsed = at(spark, query.parse(F.col("x")), 'fear "let go" now "x y"')
    assert (parsed.phrases, parsed.keywords) == (["let go", "x y"], ["fear", "now"])
    parsed = at(spark, query.parse(F.col("x")), '"open')
    assert (parsed.phrases, parsed.keywords) == ([], ['"open'])
    assert at(spark, query.parse(F.col("x")), '" " a').phrases == [""]


def test_tokens(spark):
    assert {at(spark, F.lower(text.normalize_query(F.col("x"))), w) for w in ("Haven’t", "haven't", "havenʼt")} == {"havent"}
    assert at(spark, text.tokenize(F.col("x")), "Haven't got — self-will, a\tb $5") == ["havent", "got", "self", "will", "a\tb", "$5"]
    assert at(spark, text.tokenize(F.col("x").cast("string")), None) == []


def test_fuzzy_radius(spark):
    rows = spark.range(1, 16).select(text.fuzzy_radius(F.repeat(F.lit("a"), F.col("id").cast("int"))).alias("r")).collect()
    assert [r.r for r in rows] == [0, 0, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 3, 3, 3]


def mark(x):
    return f"{kw.MARK}{x}{kw.END_MARK}"


@pytest.mark.parametrize(
    ("body", "terms", "context", "expected"),
    [
        ("w1 w2 w3 w4 w5 w6 w7 w8 w9", ["w5"], 2, f"…w3 w4 {mark('w5')} w6 w7…"),
        ("w1 w2 w3", ["w1"], 1, f"{mark('w1')} w2…"),
        ("w1 w2 w3", ["zz"], 2, "w1 w2…"),
        ("no fear now", ["ear"], 5, f"no f{mark('ear')} now"),
        ("a b  let\ngo on", ["let go"], 1, f"…b {mark('let go')}…"),
        ("", ["x"], 2, ""),
    ],
)
def test_clip(spark, body, terms, context, expected):
    assert value(spark, kw.clip(F.col("b"), F.array(*[F.lit(t) for t in terms]), F.lit(context)), b=body) == expected


def test_highlight(spark):
    assert value(spark, kw.highlight(F.col("b"), F.array(F.lit("b"))), b='a<b & "c"') == f"a&lt;{mark('b')} &amp; &quot;c&quot;"
    assert value(spark, kw.highlight(F.col("b"), F.array(F.lit("in"), F.lit("inner"))), b="inner in") == f"{mark('inner')} {mark('in')}"
    assert value(spark, kw.highlight(F.col("b"), F.array(F.lit("a.b"))), b="aXb a.b") == f"aXb {mark('a.b')}"
    assert value(spark, kw.highlight(F.col("b"), F.array().cast("array<string>")), b="a&b") == "a&amp;b"


def test_kwic_modes(spark):
    row = spark.range(1).select(F.lit("one two three").alias("t"), F.array(F.lit("two")).alias("k"))
    shown = row.select(*[kw.kwic(F.col("t"), F.col("k"), F.lit(m), F.lit(0)).alias(m) for m in ("full-text", "snippet")]).first()
    assert (shown["full-text"], shown["snippet"]) == (f"one {mark('two')} three", f"…{mark('two')}…")


def test_citation(spark):
    made = kw.citation(F.lit("text"), F.lit("T"), F.lit("C"), F.lit("p.58"))
    assert value(spark, made) == "text\n\n— T, C, p.58"
    assert value(spark, kw.citation(F.lit("text"), F.lit("T"), F.lit(""), F.lit(None).cast("string"))) == "text\n\n— T"
    assert value(spark, kw.citation(F.lit("t"), F.lit("T"), F.lit("C"), F.lit("p.1"), F.lit("snippet"), True)) is None


def test_scalars(spark):
    assert at(spark, text.chapter_slug(F.col("x")), "Chapter 5 — How It Works") == "chapter-5-how-it-works"
    assert value(spark, text.passage_id(F.lit("bb"), F.lit("How"), F.lit(7))) == "bb-how-p0007"
    assert value(spark, text.passage_id(F.lit("bb"), F.lit("How"), F.lit(12345))) == "bb-how-p12345"
    assert at(spark, text.space_dashes(F.col("x")), "a—b—c") == "a — b—c"
    assert at(spark, text.space_dashes(F.col("x")), "pp. 1–5") == "pp. 1 — 5"
    assert at(spark, text.normalize_text(F.col("x")), "ﬁne  “q”\t \r\nx") == 'fine "q"\nx'
    assert at(spark, text.teaser(F.col("x")), "a" * 195 + " " + "b" * 14) == "a" * 195 + "…"
    assert at(spark, text.teaser(F.col("x")), "a" * 210) == "a" * 200 + "…"
    assert at(spark, text.teaser(F.col("x")), "short") == "short"
    assert at(spark, text.date_label(F.col("x")), "02-29") == "February 29"
    assert at(spark, text.label(F.col("x"), "copyright"), "odd") == "odd"
    assert value(spark, text.filter_label(F.lit(None).cast("array<string>"))) == "all"
    assert value(spark, text.link(F.lit("http://x/{{date}}?a={{b}}"), F.create_map(F.lit("date"), F.lit("06 28")))) == "http://x/06+28?a={{b}}"
    assert value(spark, text.query_of_link(text.share_link(F.lit("http://x/"), F.lit('"a b" c&d')))) == '"a b" c&d'

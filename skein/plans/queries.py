"""One query for each group of operators, over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import kwic as kw
from skein.functions import text as tx
from skein.functions.query import highlight_terms, keywords, phrases
from skein.operators import daily, index, ingest, registry, search, usage, validate
from skein.plans import adapters as ad
from skein.sources import files
from skein.sources.shared import shared_dir
from skein.streaming import log as stream

HEADER = "RUNNING HEAD\n42\n"
ARTICLE = r"(?is)<article[^>]*>(.*?)</article>"
RAW_FILES = ("src1-part.txt", "Source 12.pdf", "notes.md", "SRC3.html", "source-seven (final).txt")


def sources_enabled(spark: SparkSession, d: str) -> DataFrame:
    return registry.enabled(ad.sources(spark, d)).select("id", "title", "display_mode", "context_words", "sort_order")


def source_cards(spark: SparkSession, d: str) -> DataFrame:
    return registry.cards(ad.sources(spark, d))


def passage_counts(spark: SparkSession, d: str) -> DataFrame:
    return index.passage_counts(ad.passages(spark, d))


def postings_tf(spark: SparkSession, d: str) -> DataFrame:
    return index.term_counts(ad.passages(spark, d))


def postings_top_terms(spark: SparkSession, d: str) -> DataFrame:
    return index.vocabulary(ad.passages(spark, d)).orderBy(F.desc("passages"), "term").limit(50)


def index_version(spark: SparkSession, d: str) -> DataFrame:
    return index.content_version(ad.passages(spark, d))


def registry_version(spark: SparkSession, d: str) -> DataFrame:
    return index.version(ad.sources(spark, d).select("id", F.concat_ws("|", "title", "display_mode", "copyright").alias("content")))


def query_parse(spark: SparkSession, d: str) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    q = F.concat(F.lit('fear "'), F.substring(F.col("text"), F.lit(1), half), F.lit('" '), F.substring(F.col("text"), half + 1, F.length("text")))
    rows = ad.table(spark, d, "benchmark").select("item_id", q.alias("q"))
    return rows.select("item_id", F.array_join(phrases(F.col("q")), "|").alias("phrases"), F.array_join(keywords(F.col("q")), "|").alias("keywords"), F.array_join(highlight_terms(F.col("q")), "|").alias("terms"))


def found(spark: SparkSession, d: str, *asked, **how) -> DataFrame:
    return search.matches(ad.batch(spark, *[(q, None) for q in asked]), ad.index(spark, d), **how)


def search_keyword_and(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d, "the of", "Chapter thion", "nicht  und").select("query_id", "id")


def search_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d, "thionn eree", "queenele", "to").select("query_id", "id")


def benchmark_phrases(spark: SparkSession, d: str) -> DataFrame:
    first = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    return ad.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.concat(F.lit('"'), first, F.lit('"')).alias("q"))


def search_phrase_observed(spark: SparkSession, d: str) -> DataFrame:
    return search.matches(benchmark_phrases(spark, d), ad.index(spark, d)).select("query_id", "id")


def search_phrase_strict(spark: SparkSession, d: str) -> DataFrame:
    return search.matches(benchmark_phrases(spark, d), ad.index(spark, d), phrase_mode="strict").select("query_id", "id")


def search_multi_phrase(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d, '"nicht ein" "elle de"', '"erst"').select("query_id", "id")


def search_phrase_and_keyword(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d, '"the of" erst', '" " erst', '"in the" "de la" to').select("query_id", "id")


def search_synonyms(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d, "thion", "Erst the", '"thion"', synonyms=ad.synonyms(spark))


def search_grouped(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: queries to grouped, ordered, highlighted and cited results."""
    queries = ad.batch(spark, ("erst heon", None), ('"in the" erst', None), ("thion", None))
    return search.results(queries, ad.index(spark, d), ad.sources(spark, d), synonyms=ad.synonyms(spark))


def search_source_filter_order(spark: SparkSession, d: str) -> DataFrame:
    queries = ad.batch(spark, ("the erst", ["src3", "src1", "src9", "nowhere", "src3"]), ("nicht", ["src2", "src0"]))
    return search.results(queries, ad.index(spark, d), ad.sources(spark, d)).select("query_id", "group_pos", "pos", "source_id", "passage_id")


def search_topics_batch(spark: SparkSession, d: str) -> DataFrame:
    queries = search.topic_queries(spark.createDataFrame([(t,) for t in ad.TOPICS], "topic string"))
    return search.result_counts(search.matches(queries, ad.index(spark, d)))


def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(ad.batch(spark, ("erst heon", None)), ad.passages(spark, d)).select("query_id", "id", F.round("score", 6).alias("score"))


def kwic_clip(spark: SparkSession, d: str) -> DataFrame:
    terms = highlight_terms(F.lit('"in the" tiona DER'))
    return ad.passages(spark, d).select("id", kw.clip(F.col("text"), terms, F.lit(8)).alias("kwic"))


def kwic_full(spark: SparkSession, d: str) -> DataFrame:
    terms = highlight_terms(F.lit("in inn. the é &"))
    return ad.passages(spark, d).select("id", kw.highlight(F.col("text"), terms).alias("kwic"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.passages(spark, d).join(ad.sources(spark, d).select(F.col("id").alias("source_id"), F.col("title").alias("source_title"), "display_mode"), "source_id")
    return rows.select("id", kw.citation(F.col("text"), F.col("source_title"), F.col("chapter_ref"), F.col("page_ref"), F.col("display_mode"), True).alias("citation"))


def exception_hints(spark: SparkSession, d: str) -> DataFrame:
    """Known exceptions that what people said touches."""
    said = ad.table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.substring_index(F.col("text"), " ", 2).alias("q"))
    return search.hints(said, ad.exceptions(spark)).select("query_id", "title", "body").distinct()


def adjacent_passages(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("turn").alias("sequence"))
    return search.adjacent(rows)


def passage_lookup(spark: SparkSession, d: str) -> DataFrame:
    return search.lookup(ad.passages(spark, d), "src7", "doc-7").select("id", "source_id", "sequence", "text")


def page_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    return ingest.blocks(ad.marked(spark, d), "doc_id").select("doc_id", "block_pos", F.col("page_").alias("page"), F.md5(F.col("block").cast("binary")).alias("block"))


def segment_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return ingest.segment(ad.marked(spark, d), "doc_id").select("doc_id", "seq", "page_ref", F.md5(F.col("text").cast("binary")).alias("text"))


def split_long(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.table(spark, d, "documents").select("doc_id", F.posexplode(ingest.split_long(F.coalesce("text", F.lit("")))).alias("part", "text"))
    return rows.select("doc_id", "part", tx.n_words(F.col("text")).alias("n_words"), F.md5(F.col("text").cast("binary")).alias("text"))


def chapter_assign(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.segment(ad.marked(spark, d), "doc_id", split=False)
    return ingest.assign_chapters(rows, ad.chapters(spark), tx.page_number(F.col("page_ref"))).select("doc_id", "seq", "chapter_ref", "chapter_title")


def chapter_distribution(spark: SparkSession, d: str) -> DataFrame:
    return ingest.chapter_distribution(chapter_assign(spark, d))


def strip_headers(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.lines(ad.marked(spark, d, HEADER), "doc_id")
    return ingest.strip_lines(rows, "doc_id", ["^Licensed under"]).where("reason is not null").select("doc_id", "line_no", "reason")


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return ad.dirty(spark, d).select("doc_id", tx.count_ligatures(F.col("text")).alias("ligatures"), F.md5(tx.normalize_text(F.col("text")).cast("binary")).alias("text"))


def hyphen_decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.dirty(spark, d, ad.BREAKS)
    words = spark.createDataFrame([("tion",), ("tion-x",), ("being",), ("ti-on",)], "word string")
    decided = ingest.hyphen_decisions(ingest.hyphen_candidates(rows, "doc_id", ingest.OVER_LINE), words)
    return decided.select("doc_id", "place", "left", "right", "decision", "replacement")


def hyphen_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.dirty(spark, d, ad.BREAKS)
    return ingest.hyphen_counts(ingest.hyphen_decisions(ingest.hyphen_candidates(rows, "doc_id", ingest.OVER_LINE)))


def hyphen_repair(spark: SparkSession, d: str) -> DataFrame:
    return ingest.repair_hyphens(ad.dirty(spark, d, ad.BREAKS), "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))


def passage_ids(spark: SparkSession, d: str) -> DataFrame:
    chapter = F.concat(F.lit("Chapter "), (F.col("doc_id") % 9).cast("string"), F.lit(" — How It’s  Done -- in "), F.col("lang"))
    rows = ad.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("int").alias("seq"), "source", chapter.alias("chapter"))
    return rows.select("doc_id", tx.passage_id(F.col("source"), F.col("chapter"), F.col("seq")).alias("id"), tx.slug(F.col("chapter")).alias("slug"))


def faulty(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("sequence")
    return ad.passages(spark, d).withColumns({
        "id": F.when((n % 50 == 7) | (n % 50 == 32), F.concat(F.lit("doc-"), (n - n % 50).cast("string"))).when(n % 97 == 5, "").otherwise(F.col("id")), "text": F.when(n % 31 == 3, " \n ").otherwise(F.col("text")),
        "title": F.when(n % 43 == 2, F.lit(None).cast("string")).otherwise(F.col("title")), "source_id": F.when(n % 59 == 1, "nowhere").when(n % 50 == 32, "src2").otherwise(F.lit("src0")),
    })


def validate_passages(spark: SparkSession, d: str) -> DataFrame:
    return validate.passages(faulty(spark, d), ad.sources(spark, d)).groupBy("row", "rule").agg(F.count("*").alias("times"))


def validate_registry(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("sort_order")
    rows = ad.sources(spark, d).withColumns({
        "display_mode": F.when(n % 4 == 1, "whole").otherwise(F.col("display_mode")), "copyright": F.when(n % 5 == 2, F.lit(None).cast("string")).otherwise(F.col("copyright")), "enabled": F.when(n == 3, F.lit(None).cast("boolean")).otherwise(F.col("enabled")),
        "id": F.when(n == 6, "src5").otherwise(F.col("id")),
    })
    return validate.registry(rows)


def validate_final(spark: SparkSession, d: str) -> DataFrame:
    return validate.final(faulty(spark, d).where("id <> ''")).groupBy("row", "rule").agg(F.count("*").alias("times"))


def audit_flags(spark: SparkSession, d: str) -> DataFrame:
    return ingest.audit(ad.passages(spark, d))


def audit_unknown_words(spark: SparkSession, d: str) -> DataFrame:
    known = index.vocabulary(ad.passages(spark, d)).where("passages >= 20").select(F.col("term").alias("word"))
    return ingest.unknown_words(ad.passages(spark, d), known).select("id", "n_unknown", F.array_join("first_unknown", " ").alias("first_unknown"))


def audit_top_words(spark: SparkSession, d: str) -> DataFrame:
    return ingest.top_words(ad.passages(spark, d))


def html_extract(spark: SparkSession, d: str) -> DataFrame:
    return daily.extract_html(ad.table(spark, d, "pages"), ARTICLE)


def daily_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Each day of the calendar with the number of pages that are for it."""
    pages = daily.parse_pages(daily_texts(spark, d)).groupBy("date").agg(F.count("*").alias("n"))
    return files.calendar(spark).join(pages, "date", "left").select("date", tx.date_label(F.col("date")).alias("label"), F.coalesce("n", F.lit(0)).alias("pages"))


def daily_texts(spark: SparkSession, d: str) -> DataFrame:
    """A page of each document, for a day that follows from its number; those of each fifth day end with the date."""
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 366).cast("int"))
    told = F.concat(F.lit('\n"THE  TITLE OF '), F.col("doc_id").cast("string"), F.lit('"\n'), F.coalesce("text", F.lit("")))
    text = F.concat(F.lit("noise  line\n\n  "), F.upper(F.date_format(day, "MMMM")), F.lit("  "), F.date_format(day, "d"), F.when(F.dayofmonth(day) % 5 == 0, "").otherwise(told))
    return ad.table(spark, d, "documents").select(F.col("doc_id").alias("page_pos"), text.alias("text"))


def daily_parse(spark: SparkSession, d: str) -> DataFrame:
    return daily.entries(daily_texts(spark, d)).select("id", "title", "sequence", "date", "chapter_ref", F.md5(F.col("text").cast("binary")).alias("text"))


def resume_missing(spark: SparkSession, d: str) -> DataFrame:
    return daily.missing(files.calendar(spark), daily.entries(daily_texts(spark, d)))


def raw_overlap(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in RAW_FILES], "name string")
    return registry.raw_overlap(names, ad.sources(spark, d)).select("name", "id", "raw_slug", "entry_slug", "title_slug", "overlap")


def raw_scan(spark: SparkSession, d: str) -> DataFrame:
    return registry.scan_raw(spark.createDataFrame([(n,) for n in RAW_FILES], "name string"), ad.sources(spark, d))


def log_sanitize(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.log(spark, d)
    return usage.sanitize(rows.withColumn("q", F.when(F.col("key") % 11 == 0, F.repeat("q", 200)).otherwise(F.col("q"))), F.col("ts")).select("ts", "q", "result_count", tx.filter_label(F.col("source_filter")).alias("source_filter"))


def log_fifo(spark: SparkSession, d: str) -> DataFrame:
    return usage.newest(ad.log(spark, d)).select("key", "ts", "q")


def stats_queries(spark: SparkSession, d: str) -> DataFrame:
    return usage.query_stats(ad.log(spark, d))


def stats_top_queries(spark: SparkSession, d: str) -> DataFrame:
    return usage.top_queries(ad.log(spark, d))


def stats_recent(spark: SparkSession, d: str) -> DataFrame:
    return usage.recent_queries(ad.log(spark, d)).withColumn("source_filter", tx.filter_label(F.col("source_filter")))


def stats_filter_usage(spark: SparkSession, d: str) -> DataFrame:
    return usage.filter_usage(ad.log(spark, d))


def stats_summary(spark: SparkSession, d: str) -> DataFrame:
    return usage.summary(ad.log(spark, d))


def teasers(spark: SparkSession, d: str) -> DataFrame:
    return ad.passages(spark, d).select("id", tx.teaser(F.col("text"), 60).alias("teaser"))


def log_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events through the streaming log into the shared folder, and read back."""
    base = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    schema = ad.table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    posted = rows.select(F.col("event_type").alias("q"), F.floor("value").cast("double").alias("result_count"), F.array(F.concat(F.lit("src"), (F.col("event_id") % 3).cast("string"))).alias("source_filter"), F.col("ts").cast("string").alias("ts"))
    stream.write_log(posted, f"{base}/out", f"{base}/checkpoint", F.col("ts")).awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("q").agg(F.count("*").alias("records"), F.sum("result_count").alias("results"))


ALL = (
    sources_enabled, source_cards, passage_counts, postings_tf, postings_top_terms, index_version, registry_version, query_parse, search_keyword_and, search_fuzzy, search_phrase_observed, search_phrase_strict, search_multi_phrase,
    search_phrase_and_keyword, search_synonyms, search_grouped, search_source_filter_order, search_topics_batch, search_bm25, kwic_clip, kwic_full, citations, exception_hints, adjacent_passages, passage_lookup,
    page_carry_forward, segment_paragraphs, split_long, chapter_assign, chapter_distribution, strip_headers, normalize_text, hyphen_decisions, hyphen_counts, hyphen_repair, passage_ids, validate_passages, validate_registry,
    validate_final, audit_flags, audit_unknown_words, audit_top_words, html_extract, daily_calendar, daily_parse, resume_missing, raw_overlap, raw_scan, log_sanitize, log_fifo, stats_queries, stats_top_queries, stats_recent,
    stats_filter_usage, stats_summary, teasers, log_stream,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}

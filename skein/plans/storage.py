"""Queries that write files and read them back: registries, passages, pages, maps, the index, the log; and the same in SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.operators import index, ingest, search, usage, validate
from skein.plans import adapters as ad
from skein.plans.adapters import LOG_SQL, PASSAGES_SQL, SOURCES_SQL, quoted
from skein.schemas import SOURCE_JSON
from skein.sources import files, sinks
from skein.sources.shared import shared_dir
from skein.streaming import log as stream

TERMS = ("the", "erst", "of", "nicht", "en", "chapter")
PATTERNS = ("^Licensed under", "^Contact")


def base(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def md5(column: str) -> F.Column:
    return F.md5(F.col(column).cast("binary")).alias(column)


def read_registry(spark: SparkSession, d: str) -> DataFrame:
    """A registry under ``sources``, found after a path that isn't there."""
    at, rows = base(spark), ad.sources(spark, d)
    objects = rows.select(F.to_json(F.struct(*[F.col(c).alias(SOURCE_JSON.get(c, c)) for c in rows.columns])).alias("j")).collect()  # a registry: one row a source
    sinks.write_text(spark, '{"sources": [' + ", ".join(r.j for r in objects) + "]}", f"{at}/registry")
    return files.registry(spark, [f"{at}/nowhere", f"{at}/registry"]).select("id", "title", "short_title", "copyright", "display_mode", "context_words", "sort_order", "enabled")


def written_passages(spark: SparkSession, d: str, where: str) -> str:
    """A passage file for each source that ``where`` selects."""
    at = base(spark)
    sinks.write_passages(ad.passages(spark, d).where("text <> ''").join(ad.sources(spark, d).where(where).select(F.col("id").alias("source_id")), "source_id", "left_semi"), at)
    return at


def read_passages(spark: SparkSession, d: str) -> DataFrame:
    rows = files.passages(spark, written_passages(spark, d, "true"), ad.sources(spark, d))
    return rows.select("id", "source_id", "title", "sequence", "date", "page_ref", "chapter_ref", md5("text"))


def list_files(spark: SparkSession, d: str) -> DataFrame:
    return files.file_names(spark, written_passages(spark, d, "sort_order % 4 <> 2")).where("size > 0").select("name")


def missing_sources(spark: SparkSession, d: str) -> DataFrame:
    return files.missing_files(ad.sources(spark, d), files.file_names(spark, written_passages(spark, d, "sort_order % 4 <> 2")))


def read_text_pages(spark: SparkSession, d: str) -> DataFrame:
    """Text files of a page a document, with markers."""
    at = base(spark)
    rows = ad.table(spark, d, "documents").where("source is not null").select("source", "doc_id", F.concat(F.lit("<<<PAGE "), F.col("doc_id").cast("string"), F.lit(">>>\n"), F.coalesce("text", F.lit(""))).alias("line"))
    sinks.write_named(rows, at, "source", "line", "doc_id", extension="txt")
    return files.text_pages(spark, at).select("source_id", "page", md5("text"))


def read_form_feeds(spark: SparkSession, d: str) -> DataFrame:
    at = base(spark)
    rows = ad.table(spark, d, "documents").where("source is not null").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("line"))
    sinks.write_named(rows, at, "source", "line", "doc_id", extension="txt", line_end="\f")
    return files.form_feed_pages(spark, at).select("source_id", "page_pos", md5("text"))


def read_chapters(spark: SparkSession, d: str) -> DataFrame:
    """A chapter map, written as JSON and read back: each source with the range of its documents."""
    at, page = base(spark), F.col("doc_id")
    spans = ad.table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.min(page).alias("a"), F.max(page).alias("z"))
    chapter = F.struct(F.col("z").alias("endPage"), F.col("a").alias("startPage"), F.concat(F.lit("The "), "source").alias("title"), F.col("source").alias("chapterRef"))
    spans.agg(F.to_json(F.sort_array(F.collect_list(chapter))).alias("value")).coalesce(1).write.text(at)
    return files.chapters(spark, at)


def strip_from_file(spark: SparkSession, d: str) -> DataFrame:
    """Lines that go by the patterns of a file."""
    at = base(spark)
    sinks.write_text(spark, json.dumps(PATTERNS), at)
    rows = ingest.lines(ad.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    return ingest.strip_lines(rows, "doc_id", files.strip_patterns(spark, at)).where("reason is not null").select("doc_id", "line_no", "reason")


def read_words(spark: SparkSession, d: str) -> DataFrame:
    at = base(spark)
    ad.table(spark, d, "part").select(F.concat(F.lit("  "), F.upper("p_type"), F.lit(" ")).alias("value")).union(spark.createDataFrame([("",)], "value string")).write.text(at)
    return files.words(spark, at)


def read_topics(spark: SparkSession, d: str) -> DataFrame:
    """Brands as topics, in alphabetical order, and the queries that they stand for."""
    rows = files.topics_of(ad.table(spark, d, "items"), "brand")
    at = F.row_number().over(Window.orderBy(F.lower("topic"), "topic"))  # a list as short as its table of topics
    return search.topic_queries(rows).join(rows.select(F.col("topic").alias("query_id"), at.alias("pos")), "query_id")


def index_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return ad.vocabulary(spark, d).where("passages >= 3")


def index_postings(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.index(spark, d).postings.where(F.col("term").isin(*TERMS))
    return rows.select("term", "field", "id", "source_id", "tf", F.element_at("places", 1).alias("first"), F.element_at("places", -1).alias("last"))


def index_meta(spark: SparkSession, d: str) -> DataFrame:
    return ad.index_meta(spark, d).select("version", F.inline("sources")).select("version", F.col("id").alias("source_id"), "passage_count")


def version_change(spark: SparkSession, d: str) -> DataFrame:
    """Whether a client with some version is told of another."""
    now = ad.index_meta(spark, d).select(F.col("version").alias("now"))
    case = lambda name, current, latest: F.struct(F.lit(name).alias("name"), current.alias("current"), latest.alias("latest"))
    known, none = F.col("now"), F.lit(None).cast("string")
    cases = now.select(F.explode(F.array(case("same", known, known), case("older", F.lit("x"), known), case("none yet", none, known), case("unknown", known, F.lit("")))).alias("c"))
    return cases.select("c.name", index.version_changed(F.col("c.latest"), F.col("c.current")).alias("changed"))


def read_stage(spark: SparkSession, d: str) -> DataFrame:
    at = base(spark)
    sinks.write_stage(index.passage_counts(ad.passages(spark, d), total=False), at, "r1", "counts")
    return spark.read.schema("source_id string, passages long").json(f"{at}/run=r1/counts")


def final_gate(spark: SparkSession, d: str) -> DataFrame:
    """What comes of faulty passages, which aren't written, and of good ones."""
    at = base(spark)
    good = files.with_sequence(ad.passages(spark, d).where(tx.trimmed(F.col("text")) != "").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" "))).withColumn("at", F.col("sequence")), "source_id", "at", "id").drop("at")
    faulty = good.withColumn("sequence", F.col("sequence") + 1)
    told = [(name, sinks.write_final(rows, validate.final(rows), f"{at}/{name}")) for name, rows in (("faulty", faulty), ("good", good))]
    read = spark.read.schema("id string").json(f"{at}/good").agg(F.count("id").alias("passages"))
    return spark.createDataFrame(told, "name string, written boolean").crossJoin(read).select("name", "written", F.when(F.col("written"), F.col("passages")).alias("passages"))


def report_files(spark: SparkSession, d: str) -> DataFrame:
    """The audit report, written and read back line by line."""
    at = base(spark)
    rows = ad.dirty(spark, d, ad.BREAKS)
    decisions = ingest.hyphen_decisions(ingest.hyphen_candidates(rows, "doc_id", ingest.OVER_LINE))
    stages = ad.passages(spark, d).agg(F.count("*").alias("n"), F.count_if(tx.trimmed(F.col("text")) == "").alias("blank")).select(F.posexplode(F.array(F.format_string("read: %d", "n"), F.format_string("blank: %d", "blank"))).alias("pos", "line"))
    sinks.write_report(ingest.audit_report("all", ad.passages(spark, d), decisions, stages), at)
    return spark.read.text(at).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("times"))


def log_files(spark: SparkSession, d: str) -> DataFrame:
    """Sanitised records appended in two batches, beside a file with broken lines, and read back."""
    at, rows = base(spark), ad.log(spark, d)
    for k in (0, 1):
        sinks.append_log(usage.sanitize(rows.where(F.col("key").cast("long") % 2 == k), F.col("ts")), at)
    spark.createDataFrame([("[1]",), ("{broken",), ('{"q": "  "}',), ('{"q": null}',)], "value string").write.mode("append").text(at)
    return files.log(spark, at).groupBy("q").agg(F.count("*").alias("records"), F.sum("result_count").alias("results"), F.countDistinct("key").alias("keys"))


def log_delivered(spark: SparkSession, d: str) -> DataFrame:
    """A client's queue: records put in, the oldest pushed out, and after a delivery those that weren't accepted."""
    rows = usage.client_record(ad.log(spark, d), F.col("key"), F.col("ts"))
    queue = usage.enqueue(rows.where(F.col("key") < "000000000150"), rows.where(F.col("key") == "000000000150"))
    return usage.delivered(queue, queue.where(F.col("key").cast("long") % 3 == 0)).select("key", "ts", "q", "result_count")


def log_server_time(spark: SparkSession, d: str) -> DataFrame:
    """Records of a batch carry one time of the server, in ISO form."""
    at = base(spark)
    posted = ad.log(spark, d).select("q", F.col("result_count").alias("resultCount"), F.col("source_filter").alias("sourceFilter"), F.lit("1999").alias("ts"))
    posted.coalesce(1).write.json(f"{at}/in")
    stream.write_log(stream.posted(spark, f"{at}/in"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    shape = F.col("ts").rlike(r"^20\d\d-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$")
    return spark.read.parquet(f"{at}/out").agg(F.count("*").alias("records"), F.countDistinct("ts").alias("times"), F.bool_and(shape).alias("iso"))


ALL = (
    read_registry, read_passages, list_files, missing_sources, read_text_pages, read_form_feeds, read_chapters, strip_from_file, read_words, read_topics, index_vocabulary, index_postings, index_meta, version_change, read_stage,
    final_gate, report_files, log_files, log_delivered, log_server_time,
)


def oracle_sql() -> dict[str, str]:
    from skein.plans import oracle as o

    return {
        "read_registry": f"WITH {SOURCES_SQL} SELECT id, title, short_title, copyright, display_mode, context_words, sort_order, enabled FROM sources",
        "read_passages": f"WITH {PASSAGES_SQL}, {SOURCES_SQL} SELECT p.id, source_id, coalesce(p.title, '') AS title, sequence, CAST(NULL AS VARCHAR) AS date, page_ref, chapter_ref, md5(text) AS text FROM passages p JOIN sources s ON source_id = s.id WHERE enabled AND text <> ''",
        "list_files": f"WITH {PASSAGES_SQL}, {SOURCES_SQL} SELECT DISTINCT source_id || '.json' AS name FROM passages JOIN sources s ON source_id = s.id WHERE text <> '' AND sort_order % 4 <> 2",
        "missing_sources": f"WITH {SOURCES_SQL} SELECT id FROM sources WHERE enabled AND sort_order % 4 = 2",
        "read_text_pages": r"SELECT source AS source_id, CAST(doc_id AS INT) AS page, md5(regexp_replace(coalesce(text, '') || chr(10), '\r\n?', chr(10), 'g')) AS text FROM documents WHERE source IS NOT NULL",
        "read_form_feeds": "SELECT source AS source_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS page_pos, md5(coalesce(text, '')) AS text FROM documents WHERE source IS NOT NULL UNION ALL SELECT source, CAST(count(*) AS INT), md5('') FROM documents WHERE source IS NOT NULL GROUP BY source",
        "read_chapters": "SELECT source AS chapter_ref, 'The ' || source AS title, CAST(min(doc_id) AS INT) AS start_page, CAST(max(doc_id) AS INT) AS end_page FROM documents WHERE source IS NOT NULL GROUP BY source",
        "strip_from_file": r"""WITH l AS (SELECT doc_id, unnest(range(0, len(x))) AS line_no, trim(unnest(x), E' \t\n\r') AS s FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))
            SELECT doc_id, CAST(line_no AS INT) AS line_no, CASE WHEN regexp_matches(s, '^Licensed under') THEN 'pattern: ^Licensed under' WHEN regexp_matches(s, '^Contact') THEN 'pattern: ^Contact' ELSE 'digit-only' END AS reason FROM l
            WHERE regexp_matches(s, '^Licensed under') OR regexp_matches(s, '^Contact') OR regexp_matches(s, '^\d+$')""",
        "read_words": "SELECT DISTINCT lower(p_type) AS word FROM part",
        "read_topics": "SELECT brand AS query_id, lower(brand) AS q, CAST(row_number() OVER (ORDER BY lower(brand), brand) AS INT) AS pos FROM (SELECT DISTINCT brand FROM items WHERE brand IS NOT NULL)",
        "index_vocabulary": f"WITH {PASSAGES_SQL}, {o.TOKENS_SQL} SELECT term, count(*) AS passages FROM toks GROUP BY term HAVING count(*) >= 3",
        "index_postings": f"WITH {PASSAGES_SQL}, {o.PLACES_SQL} SELECT term, field, p.id, source_id, CAST(count(*) AS INT) AS tf, CAST(min(pos) AS INT) AS first, CAST(max(pos) AS INT) AS last FROM places p JOIN passages USING (id) WHERE term IN ({', '.join(map(quoted, TERMS))}) GROUP BY ALL",
        "index_meta": f"""WITH {SOURCES_SQL}, {PASSAGES_SQL}, v AS (SELECT substr(sha256(string_agg(id || ':' || title || '|' || display_mode || '|' || copyright || chr(10), '' ORDER BY id)), 1, 16) AS version FROM sources)
            SELECT version, source_id, count(*) AS passage_count FROM passages, v GROUP BY version, source_id""",
        "version_change": "SELECT * FROM (VALUES ('same', false), ('older', true), ('none yet', true), ('unknown', false)) AS v(name, changed)",
        "read_stage": f"WITH {PASSAGES_SQL} SELECT source_id, count(*) AS passages FROM passages GROUP BY source_id",
        "final_gate": f"WITH {PASSAGES_SQL} SELECT 'faulty' AS name, false AS written, CAST(NULL AS BIGINT) AS passages UNION ALL SELECT 'good', true, count(*) FROM passages WHERE trim(text, E' \\n\\t\\r') <> ''",
        "report_files": f"""WITH {PASSAGES_SQL}, {o.CANDIDATES_SQL}, {o.DECIDED_SQL % (quoted('?'), quoted('?'))},
            w AS (SELECT sequence, id, unnest(range(0, len(x))) AS pos, unnest(x) AS word FROM (SELECT sequence, id, {o.WORDS_SQL % 'lower(text)'} AS x FROM passages)),
            t AS (SELECT word, count(*) AS times FROM w GROUP BY word ORDER BY times DESC, min((sequence, id, pos)) LIMIT 20),
            m AS (SELECT id, len({o.WORDS_SQL % 'text'}) AS n_words, len(regexp_extract_all(text, '[^a-zA-Z\\s]')) AS non_alpha, length(text) AS n_chars FROM passages),
            r AS (SELECT *, (2000 * non_alpha + n_chars) // (2 * n_chars) AS p FROM m WHERE n_chars > 0),
            f AS (SELECT id || ': ' || CASE WHEN n_words BETWEEN 20 AND 29 THEN printf('Short passage (%d words)', n_words) WHEN non_alpha / n_chars > 0.05 THEN printf('High non-alpha ratio %d.%d%% (%d/%d chars)', p // 10, p % 10, non_alpha, n_chars) END AS line FROM r),
            j AS (SELECT printf('%s %d: %s-%s > %s%s', CAST(doc_id AS VARCHAR), place, left_, right_, left_, right_) AS line FROM decided WHERE decision = 'default join'),
            l AS (SELECT 'Passages of all: ' || count(*) AS line FROM passages UNION ALL SELECT 'read: ' || count(*) FROM passages UNION ALL SELECT 'blank: ' || count(*) FILTER (trim(text, E' \\n\\t\\r') = '') FROM passages
                  UNION ALL SELECT 'Most frequent words: ' || count(*) FROM t UNION ALL SELECT printf('%6d  %s', times, word) FROM t UNION ALL SELECT 'Passages to look at: ' || count(line) FROM f UNION ALL SELECT line FROM f WHERE line IS NOT NULL
                  UNION ALL SELECT 'Default joins of hyphens: ' || count(*) FROM j UNION ALL SELECT line FROM j)
            SELECT line, count(*) AS times FROM l GROUP BY line""",
        "log_files": f"WITH {LOG_SQL} SELECT substr(l.q, 1, 500) AS q, count(*) AS records, sum(greatest(l.result_count, 0)) AS results, count(*) AS keys FROM log l JOIN asked USING (key) GROUP BY 1",
        "log_delivered": f"WITH {LOG_SQL}, r AS (SELECT key, ts, q, result_count FROM log WHERE key <= '000000000150' ORDER BY key DESC LIMIT 100) SELECT * FROM r WHERE CAST(key AS BIGINT) % 3 <> 0",
        "log_server_time": f"WITH {LOG_SQL} SELECT count(*) AS records, CAST(1 AS BIGINT) AS times, true AS iso FROM asked",
    }

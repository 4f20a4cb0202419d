"""Readers of registries, passages, pages and maps."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import unix_lines, unpadded
from skein.operators.index import Index, hits_of
from skein.schemas import CHAPTER, PASSAGE, PASSAGE_JSON, SOURCE, SOURCE_JSON

#: A pattern for a page marker line (fixed format).
PAGE_MARKER = r"^<<<PAGE (\d+)>>>$"


def first_present(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first of ``paths`` that exists, in any file system Spark knows."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return path
    raise FileNotFoundError(", ".join(paths))


def json_rows(spark: SparkSession, paths: str | Sequence[str], ddl: str, names: dict[str, str], root: str | None = None) -> DataFrame:
    """Rows of JSON arrays, or of the array under ``root`` of JSON objects, with columns by our names and file_name."""
    columns = [(c.split()[0], c.split(None, 1)[1]) for c in split_ddl(ddl)]
    fields = ", ".join(f"`{names.get(c, c)}` {t}" for c, t in columns)
    text = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_name").alias("file_name"))
    rows = F.from_json("value", f"array<struct<{fields.replace('` ', '`:')}>>")
    if root:
        inside = F.from_json(F.get_json_object("value", f"$.{root}"), f"array<struct<{fields.replace('` ', '`:')}>>")
        rows = F.when(F.ltrim("value").startswith("{"), inside).otherwise(rows)
    out = text.select("file_name", rows.alias("rows"))
    out = out.select("file_name", F.explode(F.coalesce("rows", F.when(F.lit(True), F.raise_error(F.concat(F.lit("not an array of rows: "), "file_name"))).cast(out.schema["rows"].dataType))).alias("r"))
    return out.select(*[F.col(f"r.`{names.get(c, c)}`").alias(c) for c, _ in columns], "file_name")


def split_ddl(ddl: str) -> list[str]:
    """Top-level columns of a DDL string."""
    out, depth = [""], 0
    for ch in ddl:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            out.append("")
        else:
            out[-1] += ch
    return [c.strip() for c in out]


def registry(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Sources of the first registry present, as a plain array or under ``sources``, by sort order."""
    path = paths if isinstance(paths, str) else first_present(spark, paths)
    return json_rows(spark, path, SOURCE, SOURCE_JSON, "sources").drop("file_name").orderBy("sort_order")


def passages(spark: SparkSession, directory: str, sources: DataFrame) -> DataFrame:
    """Passages of all files ``<source id>.json`` of enabled sources, with defaults filled in.

    A passage without id or text, or of another source than its file's, is an error.  Files of disabled or unknown sources
    are left out; ``missing_files`` tells which enabled sources have none.
    """
    rows = json_rows(spark, f"{directory}/*.json", PASSAGE, PASSAGE_JSON)
    rows = rows.withColumn("file_source", F.regexp_replace("file_name", r"\.json$", "")).join(sources.where("enabled").select(F.col("id").alias("file_source")), "file_source", "left_semi")
    bad = (F.coalesce("id", F.lit("")) == "") | (F.coalesce("text", F.lit("")) == "") | ~F.col("source_id").eqNullSafe(F.col("file_source"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad passage in "), "file_name"))).otherwise(F.col("id"))
    return rows.select(checked.alias("id"), "source_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("sequence", F.lit(0)).alias("sequence"), "date", "page_ref", "chapter_ref", "text", "link_data")


def file_names(spark: SparkSession, directory: str) -> DataFrame:
    """(name, size) of plain, visible files, by lower-case name.  Contents aren't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(directory).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))
    return listed.where(~F.col("name").startswith(".")).orderBy(F.lower("name"))


def missing_files(sources: DataFrame, names: DataFrame) -> DataFrame:
    """Enabled sources without a passage file."""
    have = names.select(F.regexp_replace("name", r"\.json$", "").alias("id"))
    return sources.where("enabled").join(have, "id", "left_anti").select("id")


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, page, text) of text files: lines as written, CRLF as LF; page markers split a file, which begins on page 1."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("source_id"), unix_lines(F.col("value")).alias("value"))
    parts = F.concat(F.lit("<<<PAGE 1>>>\n"), "value")
    found = files.select("source_id", F.posexplode(F.arrays_zip(F.regexp_extract_all(parts, F.lit(r"(?m)^<<<PAGE (\d+)>>>$"), F.lit(1)).alias("page"), F.slice(F.split(parts, r"(?m)^<<<PAGE \d+>>>\n?"), 2, 1 << 30).alias("text"))).alias("n", "p"))
    return found.where((F.col("n") > 0) | (F.col("p.text") != "")).select("source_id", F.col("p.page").cast("int").alias("page"), F.coalesce(F.col("p.text"), F.lit("")).alias("text"))


def form_feed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, page_pos, text) of files whose pages end in form feeds; bytes that aren't UTF-8 are replaced."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    files = spark.read.format("binaryFile").load(path).select(name.alias("source_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("value"))
    return files.select("source_id", F.posexplode(F.split("value", "\f")).alias("page_pos", "text"))


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, page, text) of PDF files, lines without blanks at their ends.  Needs the package pdfplumber on the executors."""
    import pandas as pd

    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def extract(frames):
        import io

        import pdfplumber

        for frame in frames:
            rows = []
            for file, content in zip(frame["path"], frame["content"], strict=True):
                name = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    for number, page in enumerate(pdf.pages, 1):
                        text = (page.extract_text(layout=False) or "").replace("\r\n", "\n")
                        rows.append((name, number, "\n".join(line.rstrip() for line in text.split("\n"))))
            yield pd.DataFrame(rows, columns=["source_id", "page", "text"])

    return files.mapInPandas(extract, "source_id string, page int, text string")


def chapters(spark: SparkSession, path: str) -> DataFrame:
    """Chapter ranges by start page; a row without one of the required keys is an error."""
    rows = json_rows(spark, path, CHAPTER, {"chapter_ref": "chapterRef", "start_page": "startPage", "end_page": "endPage"}).drop("file_name")
    lacking = F.col("chapter_ref").isNull() | F.col("title").isNull() | F.col("start_page").isNull() | F.col("end_page").isNull()
    return rows.withColumn("chapter_ref", F.when(lacking, F.raise_error(F.lit("chapter lacks a key"))).otherwise(F.col("chapter_ref"))).orderBy("start_page")


def strip_patterns(spark: SparkSession, path: str) -> list[str]:
    """Patterns of a JSON list, a short one, from any file system Spark knows."""
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def words(spark: SparkSession, path: str | None) -> DataFrame:
    """A word list, one per line, lower-case.  Without a path it is empty, and operators fall back on their other rules."""
    if path is None:
        return spark.createDataFrame([], "word string")
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(term, synonyms) of a JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("term", "synonyms"))


def exceptions(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, "match array<string>, title string, body string, link struct<label:string,url:string>", {}).drop("file_name")


def log(spark: SparkSession, path: str) -> DataFrame:
    """Log records of JSON lines, with their keys; lines that aren't objects, or without a query, are left out."""
    rows = spark.read.schema("key string, ts string, q string, resultCount double, sourceFilter array<string>, bad string").option("columnNameOfCorruptRecord", "bad").json(path)
    kept = rows.where(F.col("bad").isNull() & (F.coalesce(unpadded(F.col("q")), F.lit("")) != ""))
    return kept.select("key", "ts", "q", F.coalesce(F.col("resultCount"), F.lit(0.0)).alias("result_count"), F.col("sourceFilter").alias("source_filter"))


def calendar(spark: SparkSession) -> DataFrame:
    """(date) ``MM-DD`` of every day of a leap year, in order."""
    return spark.sql("SELECT date_format(d, 'MM-dd') AS date FROM (SELECT explode(sequence(date'2000-01-01', date'2000-12-31')) AS d)")


def index(spark: SparkSession, path: str) -> Index:
    """The stored index: postings, vocabulary and passages."""
    held = [spark.read.parquet(f"{path}/{name}") for name in ("postings", "vocabulary", "passages")]
    return Index(hits_of(held[0]), *held[1:], stored=True)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vocabulary")


def index_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row: version, sources (id, passage_count), built_at."""
    return spark.read.schema("version string, sources array<struct<id:string,passage_count:long>>, built_at timestamp").json(f"{path}/meta")


def topics(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "topic string").orderBy(F.lower("topic"))


def topics_of(rows: DataFrame, column: str) -> DataFrame:
    """The values of a column as topics, each once, in alphabetical order; nulls are none."""
    return rows.select(F.col(column).alias("topic")).where("topic is not null").distinct().orderBy(F.lower("topic"), "topic")


def with_sequence(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``sequence`` from 1 within ``key``."""
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy(key).orderBy(*order)))

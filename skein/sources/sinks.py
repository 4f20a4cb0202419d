"""Writers of the index, of stages, of final passages and of the log."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.index import meta, segments, vocabulary, vocabulary_of
from skein.schemas import PASSAGE_JSON
from skein.sources.shared import cleaned

#: What an index consists of.
PARTS = ("postings", "vocabulary", "passages", "meta")
#: Rows of a page of its files, at most: the least that a search of a term reads.
PAGE_ROWS = 1000


def write_index(passages: DataFrame, files: DataFrame, path: str, parts: Sequence[str] = PARTS) -> None:
    """Postings in segments sorted by term, vocabulary, and passages with a number ``row_`` each, all as Parquet, and one line of metadata; or
    some of these, each of which follows from the passages alone.

    A segment is written by the task that reads its passages, so that postings are never shuffled; its pages are short, so that a
    search skips those without its terms."""
    spark = passages.sparkSession
    parquet = lambda rows, part: rows.write.mode("overwrite").option("compression", "zstd").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/{part}")
    with cleaned(spark):
        if "postings" in parts:
            parquet(segments(passages), "postings")
        if "vocabulary" in parts:
            parquet(vocabulary_of(spark.read.parquet(f"{path}/postings")) if "postings" in parts else vocabulary(passages), "vocabulary")
        if "passages" in parts:
            parquet(passages.withColumn("row_", F.monotonically_increasing_id()), "passages")
        if "meta" in parts:
            meta(passages, files).withColumn("built_at", F.current_timestamp()).write.mode("overwrite").json(f"{path}/meta")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A short text as the one file of a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def write_named(rows: DataFrame, path: str, name: str, line: str, *order: str, extension: str = "json", line_end: str = "\n") -> None:
    """A file ``<name>.<extension>`` for each value of the column ``name``, with the lines of its rows in ``order``.

    Spark writes the files, one task for each name; the driver only gives them their names.
    """
    spark, staged = rows.sparkSession, f"{path}/_staged-{uuid.uuid4().hex}"
    dealt = rows.repartition(name).sortWithinPartitions(name, *order).select(F.col(name).alias("name_"), F.col(line).alias("value"))
    dealt.write.partitionBy("name_").option("lineSep", line_end).text(staged)
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in files.listStatus(at(staged)):
        if folder.isDirectory():
            called = unquote(folder.getPath().getName().split("=", 1)[1])
            for part in files.listStatus(folder.getPath()):
                if part.getPath().getName().startswith("part-"):
                    if not files.rename(part.getPath(), at(f"{path}/{called}.{extension}")):
                        raise FileExistsError(f"{path}/{called}.{extension}")
    files.delete(at(staged), True)


def write_passages(passages: DataFrame, path: str) -> None:
    """A JSON array ``<source id>.json`` for each source, passages by sequence, a passage a line.

    The brackets stand in the lines of a source's first and last passage, so that all of a file comes from one set of rows."""
    fields = [F.col(c).alias(PASSAGE_JSON.get(c, c)) for c in passages.columns]
    order = Window.partitionBy("source_id").orderBy("sequence", "id")
    place, last = F.row_number().over(order), F.lead(F.lit(True)).over(order).isNull()
    text = F.concat(F.when(place == 1, "[").otherwise(","), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), F.when(last, "\n]").otherwise(""))
    write_named(passages.select("source_id", "sequence", "id", place.alias("place"), text.alias("line")), path, "source_id", "line", "sequence", "id", "place")


def write_stage(rows: DataFrame, path: str, run: str, stage: str) -> None:
    """A stage's result under its run; an earlier one is never overwritten."""
    rows.write.mode("errorifexists").json(f"{path}/run={run}/{stage}")


def write_final(passages: DataFrame, errors: DataFrame, path: str) -> bool:
    """Write passages only if the checks found nothing; tells whether it did."""
    if not errors.isEmpty():
        return False
    passages.write.mode("overwrite").json(path)
    return True


def append_log(records: DataFrame, path: str) -> None:
    """Append records under keys of time stamp and a random part."""
    keyed = records.withColumn("key", F.concat(F.translate("ts", ":.", "--"), F.lit("-"), F.substring(F.uuid(), 1, 8)))
    out = keyed.select("key", "ts", "q", F.col("result_count").alias("resultCount"), F.col("source_filter").alias("sourceFilter"))
    out.write.mode("append").option("ignoreNullFields", False).json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """The lines of an audit report (section, name, pos, line) in order, over files whose names are in order too."""
    lines.orderBy("section", "name", "pos").select("line").write.mode("overwrite").text(path)

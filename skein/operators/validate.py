"""Data-quality rules: each yields rows (row, rule, detail) of what it finds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import trimmed
from skein.schemas import COPYRIGHTS, DISPLAY_MODES


def violations(rows: DataFrame, row: Column, rules: Mapping[str, Column]) -> DataFrame:
    """(row, rule) for each rule whose condition for being broken holds; null counts as broken."""
    broken = F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items()])
    return rows.select(row.alias("row"), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def repeated(column: str, *order: str, within: tuple[str, ...] = ()) -> Column:
    """Whether an earlier row, of those that agree in ``within``, has the same non-empty value.  Rows with an empty one are
    dealt over many windows, as none of them is looked at."""
    empty = F.coalesce(F.col(column), F.lit("")) == ""
    apart = F.when(empty, F.pmod(F.xxhash64(*order), F.lit(256)))
    return ~empty & (F.row_number().over(Window.partitionBy(*within, column, apart).orderBy(*order)) > 1)


def registry(sources: DataFrame) -> DataFrame:
    """Errors of a typed registry (columns of schemas.SOURCE): all are collected."""
    rows = sources.withColumn("again", repeated("id", "sort_order"))
    return violations(rows, F.col("id"), {
        "id must be a non-empty string": F.coalesce(F.col("id"), F.lit("")) == "", "duplicate id": F.col("again"), "title must be a string": F.col("title").isNull(), "shortTitle must be a string": F.col("short_title").isNull(),
        "displayMode is unknown": ~F.col("display_mode").isin(*DISPLAY_MODES), "copyright is unknown": ~F.col("copyright").isin(*COPYRIGHTS),
        "contextWords must be a number": F.col("context_words").isNull(), "sortOrder must be a number": F.col("sort_order").isNull(), "enabled must be a boolean": F.col("enabled").isNull(),
    })


def strict_registry(sources: DataFrame) -> DataFrame:
    """The registry itself; the first broken row raises when it is read.  Description and color are required too."""
    bad = F.lit(False)
    for c in ("id", "title", "short_title", "description", "display_mode", "copyright", "context_words", "color", "sort_order", "enabled"):
        bad = bad | F.col(c).isNull()
    bad = bad | (F.col("id") == "") | ~F.col("display_mode").isin(*DISPLAY_MODES) | ~F.col("copyright").isin(*COPYRIGHTS)
    return sources.withColumn("id", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("bad source "), F.coalesce("id", F.lit("?"))))).otherwise(F.col("id")))


def is_kind(value: Column, kind: str) -> Column:
    return F.coalesce(F.call_function("schema_of_variant", value).rlike(kind), F.lit(False))


def passages_json(raw: DataFrame) -> DataFrame:
    """Errors of passages as JSON text (columns file_source, n, json), by exact type: a missing date is an error where a null
    one isn't; a missing or null pageRef is fine.  Columns: file_source, n, rule."""
    v = lambda f: F.try_variant_get("v", f"$.{f}", "variant")
    missing, null = lambda f: v(f).isNull(), lambda f: F.is_variant_null(v(f))
    rows = raw.withColumn("v", F.try_parse_json("json"))
    text = lambda f: F.when(is_kind(v(f), "^STRING"), F.try_variant_get("v", f"$.{f}", "string"))
    rows = rows.withColumns({"id_": text("id"), "text_": text("text"), "source_": text("sourceId")})
    rows = rows.withColumn("again", (F.coalesce("id_", F.lit("")) != "") & (F.row_number().over(Window.partitionBy("file_source", "id_").orderBy("n")) > 1))
    rules = {
        "id must be a non-empty string": F.coalesce("id_", F.lit("")) == "", "duplicate id": F.col("again"), "sourceId must match registry id": ~F.col("source_").eqNullSafe(F.col("file_source")), "title must be a string": ~is_kind(v("title"), "^STRING"),
        "sequence must be a number": ~is_kind(v("sequence"), "^(BIGINT|DECIMAL|DOUBLE|INT|TINYINT|SMALLINT|FLOAT)"), "date must be a string or null": missing("date") | ~(null("date") | is_kind(v("date"), "^STRING")),
        "pageRef must be a string or null": ~(missing("pageRef") | null("pageRef") | is_kind(v("pageRef"), "^STRING")), "text must be a non-empty string": F.coalesce(trimmed(F.col("text_")), F.lit("")) == "",
    }
    broken = F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items()])
    return rows.select("file_source", "n", F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def passages(rows: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Errors of typed passages: (row, rule), row the id.  An id may stand once in a source's file; ``corpus`` looks across files."""
    marked = rows.withColumn("again", repeated("id", "sequence", within=("source_id",)))
    rules = {
        "id must be a non-empty string": F.coalesce(F.col("id"), F.lit("")) == "", "duplicate id": F.col("again"), "title must be a string": F.col("title").isNull(), "sequence must be a number": F.col("sequence").isNull(),
        "text must be a non-empty string": F.coalesce(trimmed(F.col("text")), F.lit("")) == "",
    }
    if sources is not None:
        marked = marked.join(sources.select(F.col("id").alias("source_id"), F.lit(True).alias("known")), "source_id", "left")
        rules["sourceId must match registry id"] = F.col("known").isNull()
    return violations(marked, F.col("id"), rules)


def build_time(rows: DataFrame) -> DataFrame:
    """Errors that stop an index build: white space alone passes as text here."""
    return violations(rows, F.col("id"), {"id is empty": F.coalesce(F.col("id"), F.lit("")) == "", "text is empty": F.coalesce(F.col("text"), F.lit("")) == "", "sourceId is empty": F.coalesce(F.col("source_id"), F.lit("")) == ""})


def duplicate_ids(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.count("*").alias("times")).where("times > 1")


def sequence_gaps(rows: DataFrame) -> DataFrame:
    """(source_id, sequence, expected): the first row of each source whose sequence isn't its ordinal."""
    order = Window.partitionBy("source_id").orderBy("sequence", "id")
    wrong = rows.select("source_id", "sequence", F.row_number().over(order).alias("expected")).where("sequence <> expected")
    return wrong.groupBy("source_id").agg(F.min(F.struct("expected", "sequence")).alias("w")).select("source_id", "w.sequence", "w.expected")


def final(rows: DataFrame) -> DataFrame:
    """Errors that keep ingested passages from being published: (row, rule)."""
    gaps = sequence_gaps(rows).select(F.concat(F.col("source_id"), F.lit("#"), F.col("expected").cast("string")).alias("row"), F.lit("sequence has a gap").alias("rule"))
    twice = duplicate_ids(rows).select(F.col("id").alias("row"), F.lit("duplicate id").alias("rule"))
    texts = violations(rows, F.col("id"), {"text is blank": F.coalesce(trimmed(F.col("text")), F.lit("")) == "", "text has a line end": F.contains("text", F.lit("\n"))})
    return gaps.unionByName(twice).unionByName(texts)


def corpus(rows: DataFrame, daily_source: str = "daily-reflections") -> DataFrame:
    """Opt-in checks over all files: ids unique across files, no HTML in texts, 366 dates in the daily source."""
    twice = duplicate_ids(rows).select(F.col("id").alias("row"), F.lit("duplicate id").alias("rule"))
    html = rows.where(F.col("text").rlike(r"<[A-Za-z/][^>]*>")).select(F.col("id").alias("row"), F.lit("text has HTML").alias("rule"))
    days = rows.where(F.col("source_id") == daily_source).agg(F.countDistinct("date").alias("n")).where("n not in (0, 366)").select(F.lit(daily_source).alias("row"), F.lit("not 366 dates").alias("rule"))
    return twice.unionByName(html).unionByName(days)

"""Daily entries: parsing of pages, lookup by date, HTML extraction and resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import collapsed, date_label, teaser

#: Names of the months, and a line with a month and a day (fixed formats).
MONTHS = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")
DATE_LINE = rf"(?i)^({'|'.join(MONTHS)})\s+(\d{{1,2}})"
SOURCE_ID = "daily-reflections"


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_pos, date, title, chapter_ref, text) of pages that have a line with month and day and a line after it, the title.

    Quotes around the title go; the lines after it are the text.  Day numbers aren't checked; a text may be empty.
    """
    clean = F.filter(F.transform(F.split(F.regexp_replace("text", r"\r\n?|[\f\u000b\u0085  ]", "\n"), "\n"), collapsed), lambda x: x != "")
    at = F.array_position(F.transform("lines", lambda x: x.rlike(DATE_LINE)), True).cast("int")
    rows = pages.select("page_pos", clean.alias("lines")).withColumn("at", at).where((F.col("at") > 0) & (F.col("at") < F.size("lines")))
    line = F.element_at("lines", F.col("at"))
    month, day = F.upper(F.regexp_extract(line, DATE_LINE, 1)), F.regexp_extract(line, DATE_LINE, 2)
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month).cast("int")
    title = F.trim(F.regexp_replace(F.regexp_replace(F.element_at("lines", F.col("at") + 1), '^"+|"+$', ""), "^'+|'+$", ""))
    body = F.array_join(F.slice("lines", F.col("at") + 2, F.size("lines")), " ")
    return rows.select("page_pos", F.format_string("%02d-%s", number, F.lpad(day, 2, "0")).alias("date"), title.alias("title"), F.concat(F.initcap(F.lower(month)), F.lit(" "), day.cast("int").cast("string")).alias("chapter_ref"), body.alias("text"))


def entries(pages: DataFrame) -> DataFrame:
    """Passages of the daily source: of several pages for a date the first, numbered by date."""
    first = parse_pages(pages).groupBy("date").agg(F.min_by(F.struct("title", "chapter_ref", "text"), "page_pos").alias("e"))
    numbered = first.withColumn("sequence", F.row_number().over(Window.orderBy("date")))  # at most one row a day of the year
    return numbered.select(F.concat(F.lit("dr-"), "date").alias("id"), F.lit(SOURCE_ID).alias("source_id"), "e.title", "sequence", "date", F.lit(None).cast("string").alias("page_ref"), "e.chapter_ref", "e.text", F.lit(None).cast("map<string,string>").alias("link_data"))


def checks(found: DataFrame, least: int = 300) -> DataFrame:
    """One row: entries, enough, has_leap_day."""
    return found.agg(F.count("*").alias("entries"), (F.count("*") >= least).alias("enough"), F.coalesce(F.bool_or(F.col("date") == "02-29"), F.lit(False)).alias("has_leap_day"))


def by_date(passages: DataFrame, month_day: str) -> DataFrame:
    """The daily entry of a date; none is put in its place if it is missing."""
    return passages.where((F.col("source_id") == SOURCE_ID) & (F.col("date") == month_day)).orderBy("sequence", "id").limit(1)


def dry_run(calendar: DataFrame) -> DataFrame:
    """The first date alone: what a trial run fetches."""
    return calendar.orderBy("date").limit(1)


def missing(calendar: DataFrame, existing: DataFrame) -> DataFrame:
    """Dates still to fetch."""
    return calendar.join(existing.select("date"), "date", "left_anti")


def resumed(calendar: DataFrame, existing: DataFrame, fetched: DataFrame) -> DataFrame:
    """(date, title, text, reused): the entry that exists, or else the fetched one; dates with neither are left out."""
    old, new = existing.select("date", F.struct("title", "text").alias("old")), fetched.select("date", F.struct("title", "text").alias("new"))
    rows = calendar.join(old, "date", "left").join(new, "date", "left").withColumn("e", F.coalesce("old", "new"))
    return rows.where("e is not null").select("date", "e.title", "e.text", F.col("old").isNotNull().alias("reused"))


def card(passages: DataFrame, size: int = 250) -> DataFrame:
    return passages.select("id", "date", date_label(F.col("date")).alias("label"), F.coalesce("chapter_ref", "title").alias("heading"), teaser(F.col("text"), size).alias("teaser"))


def plain(html: Column) -> Column:
    """Text of an HTML fragment: tags as spaces, white space collapsed; null where nothing is left."""
    text = collapsed(F.regexp_replace(html, "<[^>]+>", " "))
    return F.when(text != "", text)


def extract_html(pages: DataFrame, body: str = r'(?is)<div[^>]*class="[^"]*field--name-body[^"]*"[^>]*>(.*?)</div>', title_class: str = "title", default_title: str = "Daily Reflection") -> DataFrame:
    """(page_id, title, text): the first level-1 heading, or a level-2 heading of ``title_class``, or the default; the text of
    the container that ``body`` matches, null without one."""
    head = lambda p: plain(F.regexp_extract("html", p, 1))
    title = F.coalesce(head(r"(?is)<h1[^>]*>(.*?)</h1>"), head(rf'(?is)<h2[^>]*class="[^"]*{title_class}[^"]*"[^>]*>(.*?)</h2>'), F.lit(default_title))
    return pages.select("page_id", title.alias("title"), plain(F.regexp_extract("html", body, 1)).alias("text"))

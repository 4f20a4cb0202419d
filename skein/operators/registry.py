"""Sources: filters, labels, exceptions, and matching of raw files to the registry."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from skein.functions.text import label, slug, status_badge, token_set


def enabled(sources: DataFrame) -> DataFrame:
    return sources.where("enabled").orderBy("sort_order", "id")


def active(sources: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """(id, group_pos): given ids in their order, each once, unknown ones dropped, disabled ones allowed; else the enabled
    sources in registry order."""
    if ids is None:
        return sources.where("enabled").select("id", F.col("sort_order").alias("group_pos"))
    asked = sources.sparkSession.createDataFrame([(i, n) for n, i in enumerate(dict.fromkeys(ids))], "id string, group_pos int")
    return asked.join(sources.select("id"), "id", "left_semi")


def toggled(active_ids: list[str], source_id: str) -> list[str]:
    """A source switched on or off; the last one stays on."""
    rest = [i for i in active_ids if i != source_id]
    return rest or active_ids if source_id in active_ids else [*active_ids, source_id]


def cards(sources: DataFrame) -> DataFrame:
    """What a source list shows."""
    return sources.select("id", "title", label(F.col("copyright"), "copyright").alias("copyright"), label(F.col("display_mode"), "display_mode").alias("display_mode"), status_badge(F.col("enabled"), F.col("display_mode")).alias("status"))


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gestalt similarity of two names, 0 to 1."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def raw_overlap(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(name, raw_slug, id, entry_slug, title_slug, sort_order, overlap): every raw file against every source.

    Names of files in one folder against a hand-kept registry; both are short lists, and every pair has a score.
    """
    raw = files.select("name", slug(F.regexp_replace("name", r"\.[^.]*$", "")).alias("raw_slug"))
    known = sources.select("id", "title", "sort_order", slug(F.col("id")).alias("entry_slug"), slug(F.coalesce(F.when(F.col("title") != "", F.col("title")), "short_title")).alias("title_slug"), F.concat_ws(" ", "id", "title", "short_title").alias("all_text"))
    tokens = F.array_union(F.array_union(token_set(F.col("entry_slug")), token_set(F.col("title_slug"))), token_set(F.col("all_text")))
    return raw.crossJoin(known).select("name", "raw_slug", "id", "entry_slug", "title_slug", "sort_order", F.size(F.array_intersect(token_set(F.col("raw_slug")), tokens)).alias("overlap"))


def scan_raw(files: DataFrame, sources: DataFrame, threshold: float = 75.0) -> DataFrame:
    """(name, status, suggested_source_id, score): the source that each raw file matches best, ties to the first in the registry."""
    pairs = raw_overlap(files, sources).withColumn("similarity", F.greatest(name_ratio("raw_slug", "entry_slug"), name_ratio("raw_slug", "title_slug")))
    scored = pairs.withColumn("score", F.col("similarity") * 100 + F.col("overlap") * 8)
    best = scored.groupBy("name", "raw_slug").agg(F.max_by(F.struct("id", "entry_slug", "score"), F.struct("score", -F.col("sort_order"), "id")).alias("b"))
    rows = files.select("name", slug(F.regexp_replace("name", r"\.[^.]*$", "")).alias("raw_slug")).join(best.select("name", "b"), "name", "left")
    existing = F.coalesce((F.col("raw_slug") == F.col("b.entry_slug")) | F.contains("b.entry_slug", F.col("raw_slug")) | F.contains(F.col("raw_slug"), F.col("b.entry_slug")) | (F.col("b.score") >= threshold), F.lit(False))
    fresh = F.when(F.col("raw_slug") != "", F.col("raw_slug")).otherwise("new-source")
    return rows.select("name", F.when(existing, "existing").otherwise("new").alias("status"), F.when(existing, F.col("b.id")).otherwise(fresh).alias("suggested_source_id"), F.col("b.score").alias("score"))

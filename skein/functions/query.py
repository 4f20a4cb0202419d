"""The query language: quoted phrases and keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import trimmed, words


def phrases(q: Column) -> Column:
    """Texts between double quotes, trimmed; a blank one counts.  An unbalanced quote is part of a keyword."""
    return F.transform(F.regexp_extract_all(q, F.lit('"([^"]+)"'), F.lit(1)), trimmed)


def keywords(q: Column) -> Column:
    """Words outside the phrases, in their case."""
    return words(F.regexp_replace(q, '"[^"]+"', " "))


def parse(q: Column) -> Column:
    return F.struct(phrases(q).alias("phrases"), keywords(q).alias("keywords"), q.alias("raw"))


def highlight_terms(q: Column) -> Column:
    """What is marked in results: phrases, then keywords, lower-case, each once."""
    return F.array_distinct(F.transform(F.concat(phrases(q), keywords(q)), F.lower))

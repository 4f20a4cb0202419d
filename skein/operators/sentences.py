"""Sentences by abbreviations that a corpus itself tells: words that stand with a full stop far more often than chance would have it.

After Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection" (2006): a log-likelihood ratio of word and full
stop, scaled by the word's length, the full stops within it, and how often it stands without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import bound, trimmed
from skein.sources.shared import stored

#: The least score of an abbreviation, and how likely one is to have its full stop (fixed values of the method).
LEAST_SCORE, WITH_STOP = 0.3, 0.99
#: What ends a sentence, before white space.
BREAK = r"(?<=[.!?])\s+"


def typed(token: Column) -> Column:
    """A token's lower-case word, with its last full stop if it has one, without other marks around it."""
    bare = F.regexp_replace(F.lower(token), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", "")
    return F.regexp_replace(bare, r"\.{2,}$", "")


def abbreviations(texts: DataFrame, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """(word, with_stop, without_stop, score): words that are abbreviations, their last full stop apart.

    Tokens are counted as they stand, per task before a shuffle, and only distinct ones are made words, whose counts are stored; the
    corpus's own two counts are sums of theirs.  Null and empty texts have no words; a corpus without full stops has no abbreviations."""
    tokens = texts.select(F.explode(F.split(F.coalesce(text, F.lit("")), r"\s+")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    words = tokens.select(typed(F.col("token")).alias("t"), "n")
    stop = F.col("t").endswith(".")
    counted = words.groupBy(F.when(stop, F.expr("left(t, length(t) - 1)")).otherwise(F.col("t")).alias("word")).agg(F.sum("n").alias("n"), F.sum(F.when(stop, F.col("n")).otherwise(0)).alias("k"))
    counted = stored(counted, "word_counts")
    whole = counted.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    told = counted.where((F.col("k") > 0) & F.col("word").rlike(r"\p{L}") & F.lit((whole["k"] or 0) < (whole["n"] or 0)))
    n, k, p = F.col("n").cast("double"), F.col("k").cast("double"), F.lit(float(whole["k"] or 0)) / F.lit(float(whole["n"] or 1))
    chance = k * F.log(p) + (n - k) * F.log(1 - p)
    tied = k * F.log(F.lit(WITH_STOP)) + (n - k) * F.log(F.lit(1 - WITH_STOP))
    size = F.length(F.replace("word", F.lit("."), F.lit(""))).cast("double")
    stops = F.length("word") - size + 1
    score = 2 * (tied - chance) * F.exp(-size) * stops * F.pow(size, k - n)
    return told.withColumn("score", score).where(F.col("score") >= least).select("word", F.col("k").alias("with_stop"), (F.col("n") - F.col("k")).alias("without_stop"), "score")


def split(texts: DataFrame, key: list[str], known: DataFrame, text: str = "text") -> DataFrame:
    """(key, sentence_no from 1, sentence) of each text.  A full stop, question or exclamation mark before white space ends a sentence,
    but for a full stop after one of the words ``known``, and one after a number that a small letter follows.

    The words are joined to what stands before each stop, and only the places of stops that end nothing come back to a text, whose
    parts stay within its row.  ``key`` names one row; null and blank texts have no sentences."""
    rows = texts.select(*key, trimmed(F.col(text)).alias("text_")).where("text_ <> ''").withColumn("id_", F.struct(*key))
    cut = lambda: F.split("text_", BREAK)

    def last(part: Column) -> Column:
        for space in " \n\t\r\x0b\f":
            part = F.substring_index(part, space, -1)
        return part

    follows = lambda parts, i: F.coalesce(F.get(parts, i + 1), F.lit("")).rlike(r"^[^\p{L}\p{N}]*\p{Ll}")
    stops = F.inline(bound(cut(), lambda parts: F.transform(parts, lambda p, i: F.struct(i.alias("i"), last(p).alias("last"), follows(parts, i).alias("small")))))
    stops = rows.select("id_", stops).select("id_", "i", "small", bound(typed(F.col("last")), lambda w: F.when(w.endswith("."), F.left(w, F.length(w) - 1))).alias("word")).where("word is not null")
    stops = stops.join(known.select("word", F.lit(True).alias("known_")).distinct(), "word", "left").where(F.col("known_") | (F.col("word").rlike(r"^\p{N}+$") & F.col("small")))
    told = stops.groupBy("id_").agg(F.sort_array(F.collect_list("i")).alias("on")).withColumnRenamed("id_", "of_")

    def joined(parts: Column, on: Column) -> Column:
        """Sentences from the places of parts that go on: stretches of such parts and the one after them, and all others alone."""
        n = F.size(parts)
        whole = bound(F.concat(F.array(F.lit(-1)), on, F.array(n)), lambda x: F.flatten(F.zip_with(x, F.slice(x, 2, n + 1), lambda a, b: F.when(b > a + 1, F.sequence(a + 1, b - 1)).otherwise(F.array().cast("array<int>")))))
        ends = lambda w: F.when(F.element_at(on, -1) == n - 1, F.concat(w, F.array(n - 1))).otherwise(w)
        first = lambda e: F.concat(F.array(F.lit(-1)), F.slice(e, 1, F.size(e) - 1))
        return bound(bound(whole, ends), lambda e: F.zip_with(first(e), e, lambda a, b: F.when(b == a + 1, F.get(parts, b)).otherwise(F.array_join(F.slice(parts, a + 2, b - a), " "))))

    told = rows.join(told, F.col("id_").eqNullSafe(F.col("of_")), "left")
    whole = bound(cut(), lambda parts: F.when(F.col("on").isNull(), parts).otherwise(joined(parts, F.col("on"))))
    return told.select(*key, F.posexplode(whole).alias("no_", "sentence")).select(*key, (F.col("no_") + 1).cast("long").alias("sentence_no"), "sentence")

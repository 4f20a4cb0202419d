"""Batches of queries against passages: phrases, keywords, fuzzy matches and synonyms as one plan.

Query terms are rows; a passage matches a unit (a phrase, or all keywords) if it has every term of it.  Terms are joined to the
postings of an index, whose scan reads these terms alone, so that only hits are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.kwic import citation, kwic
from skein.functions.query import highlight_terms, keywords, phrases
from skein.functions.text import fuzzy_radius, normalize_query, tokenize, trimmed
from skein.operators import index
from skein.operators.index import Index, indexed

PHRASE, KEYWORD, SYNONYM = "phrase", "keyword", "synonym"
#: Terms of a batch that are gathered to filter the postings, at most, values of a list that a scan takes as it is, and ranges
#: that stand for a longer one.
MOST_TERMS, IN_LIST, RANGES = 2000, 10, 32
#: Places of rarest tokens (query, phrase, passage and field) that are broadcast, at most: some 20 MB.
MOST_FOUND = 200_000


def asked(queries: DataFrame) -> DataFrame:
    """Queries that aren't blank, parsed: query_id, q, phrases, keywords, source_filter."""
    chosen = F.col("source_filter") if "source_filter" in queries.columns else F.lit(None).cast("array<string>")
    q = trimmed(F.col("q"))
    return queries.where(q != "").select("query_id", q.alias("q"), phrases(q).alias("phrases"), keywords(q).alias("keywords"), chosen.alias("source_filter"))


def query_terms(parsed: DataFrame, synonyms: DataFrame | None = None, fuzzy: bool = True, synonym_combine: str = "or") -> DataFrame:
    """(query_id, kind, unit, n_terms, term_pos, term, radius), one row for each token of each unit.

    Synonyms apply to queries without phrases; a keyword is looked up whole, in lower case.  Each token of a synonym is a
    unit of its own, or with ``synonym_combine="and"`` each synonym is.
    """
    unit = lambda df, kind, fuzz: df.select("query_id", F.lit(kind).alias("kind"), "unit", F.size("tokens").alias("n_terms"), F.posexplode("tokens").alias("term_pos", "term")).withColumn("radius", fuzzy_radius(F.col("term")) if fuzz else F.lit(0))
    by_phrase = parsed.select("query_id", F.posexplode("phrases").alias("unit", "phrase")).select("query_id", "unit", tokenize(normalize_query(F.col("phrase"))).alias("tokens"))
    by_word = parsed.select("query_id", F.lit(0).alias("unit"), tokenize(normalize_query(F.array_join("keywords", " "))).alias("tokens"))
    out = unit(by_phrase, PHRASE, False).unionByName(unit(by_word, KEYWORD, fuzzy))
    if synonyms is not None:
        found = parsed.where(F.size("phrases") == 0).select("query_id", F.explode(F.transform("keywords", F.lower)).alias("term")).distinct().join(synonyms.select(F.lower("term").alias("term"), "synonyms"), "term")
        said = found.select("query_id", F.explode("synonyms").alias("s")).distinct().select("query_id", tokenize(normalize_query(F.col("s"))).alias("tokens"))
        if synonym_combine == "or":
            said = said.select("query_id", F.explode("tokens").alias("t")).distinct().select("query_id", F.array("t").alias("tokens"))
        said = said.withColumn("unit", F.hash("tokens"))
        out = out.unionByName(unit(said, SYNONYM, False))
    return out


def variants(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``terms`` with each term replaced by the vocabulary within its radius.  Lengths are joined by equality before the
    bounded edit distance is looked at."""
    near = terms.where("radius > 0").withColumn("wanted", F.col("term")).drop("term").withColumn("size", F.explode(F.sequence(F.length("wanted") - F.col("radius"), F.length("wanted") + F.col("radius"))))
    met = near.join(vocabulary.select("term", F.length("term").alias("size")), "size").where("levenshtein(term, wanted, radius) >= 0")
    exact = terms.where("radius = 0").drop("radius")
    return exact.unionByName(met.select(*exact.columns))


def whole_units(hits: DataFrame) -> DataFrame:
    """Relational division: (query_id, kind, unit, id) of passages that have every term of a unit."""
    return hits.groupBy("query_id", "kind", "unit", "id").agg(F.countDistinct("term_pos").alias("had"), F.max("n_terms").alias("n_terms")).where("had = n_terms").drop("had", "n_terms")


def wanted(terms: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query terms as local rows, and the postings of these terms alone: the filter reaches the scan, whose files are sorted
    by term.  A batch of more than MOST_TERMS terms is joined as it is."""
    rows = terms.limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        return terms, postings
    words = sorted({r.term for r in rows})
    near = F.col("term").isin(words)
    if len(words) > IN_LIST:  # a longer list is looked up row by row; what the scan can skip follows from a few ranges of terms
        step = max(IN_LIST, -(-len(words) // RANGES))
        ranges = [F.col("term").between(words[a], words[min(a + step, len(words)) - 1]) for a in range(0, len(words), step)]
        near = near & reduce(Column.__or__, ranges)
    return terms.sparkSession.createDataFrame(rows, terms.schema), postings.where(near)


def strict_runs(terms: DataFrame, postings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, kind, unit, id) of passages that have a phrase's tokens next to each other in one field.

    The phrase's rarest token, by the vocabulary, tells which passages and fields may have it.  Up to MOST_FOUND of those they are
    sent to where the postings are, so that only these are shuffled; beyond, both sides are.  Places meet as sets, each
    less its token's place in the phrase.
    """
    unit, spot = ["query_id", "kind", "unit"], ["id", "field"]
    known = F.coalesce("passages", F.lit(0))
    sized = terms.join(vocabulary.select("term", "passages"), "term", "left")
    rarest = sized.groupBy(*unit).agg(F.min_by("term", known).alias("term"), F.min(known).alias("least")).where("least > 0")
    may = rarest.select(*unit, "term").join(postings.select("term", *spot), "term").select(*unit, *spot).distinct()
    near = F.broadcast(may) if may.limit(MOST_FOUND + 1).count() <= MOST_FOUND else may
    held = terms.join(postings.select("term", *spot, "places"), "term").join(near, [*unit, *spot], "left_semi")
    begins = F.transform("places", lambda p: p - F.col("term_pos"))
    every = held.groupBy(*unit, *spot).agg(F.collect_list(begins).alias("b"), F.max("n_terms").alias("n_terms")).where(F.size("b") == F.col("n_terms"))
    common = F.aggregate(F.slice("b", F.lit(2), F.size("b")), F.element_at("b", 1), F.array_intersect)
    return every.where(F.size(common) > 0).select(*unit, "id").distinct()


def matches(queries: DataFrame, corpus: DataFrame | Index, synonyms: DataFrame | None = None, fuzzy: bool = True, phrase_mode: str = "observed", synonym_combine: str = "or") -> DataFrame:
    """(query_id, id, by_synonym): which passages of an index (or of a table of passages) match which queries.

    Phrases are united, keywords must all match (within their radius), and with both the two sets are intersected; synonyms
    add passages, marked where nothing else found them.  ``phrase_mode``: "observed" needs a phrase's tokens anywhere in the
    passage, "strict" needs them next to each other in one field.
    """
    held = corpus if isinstance(corpus, Index) else index.of(corpus)
    parsed = asked(queries)
    terms, postings = query_terms(parsed, synonyms, fuzzy, synonym_combine), held.postings
    if fuzzy:
        terms = variants(terms, held.vocabulary)
    else:
        terms = terms.drop("radius")
    if held.stored:
        terms, postings = wanted(terms, postings)
    loose = terms.where(F.col("kind") != PHRASE) if phrase_mode == "strict" else terms
    units = whole_units(loose.join(postings.select("term", "id"), "term"))
    if phrase_mode == "strict":
        units = units.unionByName(strict_runs(terms.where(F.col("kind") == PHRASE), postings, held.vocabulary))
    flags = units.groupBy("query_id", "id").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in (PHRASE, KEYWORD, SYNONYM)])
    shape = parsed.select("query_id", (F.size("phrases") > 0).alias("has_phrases"), (F.size("keywords") > 0).alias("has_keywords"))
    direct = (F.col(PHRASE) | ~F.col("has_phrases")) & (F.col(KEYWORD) | ~F.col("has_keywords"))
    return flags.join(shape, "query_id").where(direct | F.col(SYNONYM)).select("query_id", "id", (~direct).alias("by_synonym"))


def results(queries: DataFrame, corpus: DataFrame | Index, sources: DataFrame, synonyms: DataFrame | None = None, guard: bool = True, **how) -> DataFrame:
    """Flat results: query_id, group_pos, pos, source_id, passage_id, sequence, kwic, citation, matched_by_synonym.

    Sources come in the order of the query's filter, each once, or else in registry order; passages in the order of their
    sequence, ties by id.  Passages of disabled sources aren't indexed.  With ``guard`` only full-text sources are cited whole.

    Rows are placed without their texts, which are shuffled once, to be shown and cited.
    """
    held = corpus if isinstance(corpus, Index) else index.of(indexed(corpus, sources))
    passages = index.numbered(held.passages)
    found = matches(queries, held, synonyms, **how)
    parsed = asked(queries).select("query_id", highlight_terms(F.col("q")).alias("terms"), F.array_distinct("source_filter").alias("source_filter"))
    known = sources.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"), "display_mode", "context_words", "sort_order")
    places = indexed(passages.select("row_", "id", "source_id", "sequence"), sources).join(found, "id").join(known, "source_id").join(parsed, "query_id")
    places = places.where(F.col("source_filter").isNull() | F.array_contains("source_filter", F.col("source_id")))
    order = Window.partitionBy("query_id", "source_id").orderBy("sequence", "id")
    placed = places.select(
        "row_", "query_id", F.when(F.col("source_filter").isNull(), F.col("sort_order")).otherwise(F.array_position("source_filter", F.col("source_id")).cast("int") - 1).alias("group_pos"),
        F.row_number().over(order).alias("pos"), "source_id", F.col("id").alias("passage_id"), "sequence", "by_synonym", "terms", "source_title", "display_mode", "context_words",
    )
    rows = passages.select("row_", "text", "chapter_ref", "page_ref").join(placed, "row_")
    shown = kwic(F.col("text"), F.col("terms"), F.col("display_mode"), F.col("context_words"))
    cited = citation(F.col("text"), F.col("source_title"), F.col("chapter_ref"), F.col("page_ref"), F.col("display_mode"), guard)
    return rows.select("query_id", "group_pos", "pos", "source_id", "passage_id", "sequence", shown.alias("kwic"), cited.alias("citation"), F.col("by_synonym").alias("matched_by_synonym"))


def grouped(found: DataFrame) -> DataFrame:
    """Results nested by source: query_id, group_pos, source_id, results in order."""
    row = F.struct("pos", "passage_id", "kwic", "citation", "matched_by_synonym")
    return found.groupBy("query_id", "group_pos", "source_id").agg(F.array_sort(F.collect_list(row)).alias("results"))


def result_counts(found: DataFrame) -> DataFrame:
    """(query_id, result_count), as the usage log records it."""
    return found.groupBy("query_id").agg(F.count("*").alias("result_count"))


def logged_filter(ids, n_enabled):
    """The filter to log: only a strict subset of the enabled sources is told."""
    return F.when(F.size(ids) < n_enabled, ids)


def hints(queries: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(query_id, title, body, link) of the known exceptions that a query touches: a trigger in the query, or the query in a trigger.

    Every query is held against every exception: the exceptions are a short hand-kept list.
    """
    q = queries.select("query_id", F.lower(trimmed(F.col("q"))).alias("q")).where("q <> ''")
    either = F.exists("match", lambda m: F.contains(F.col("q"), F.lower(m)) | F.contains(F.lower(m), F.col("q")))
    return q.join(exceptions, either).select("query_id", "title", "body", "link")


def topic_queries(topics: DataFrame) -> DataFrame:
    """Topics as a batch of keyword queries."""
    return topics.select(F.col("topic").alias("query_id"), F.lower("topic").alias("q"))


def lookup(passages: DataFrame, source_id: str, passage_id: str) -> DataFrame:
    return passages.where((F.col("id") == passage_id) & (F.col("source_id") == source_id))


def adjacent(passages: DataFrame) -> DataFrame:
    """(source_id, id, sequence, previous_id, next_id) within each source."""
    order = Window.partitionBy("source_id").orderBy("sequence", "id")
    return passages.select("source_id", "id", "sequence", F.lag("id").over(order).alias("previous_id"), F.lead("id").over(order).alias("next_id"))


def bm25(queries: DataFrame, passages: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Relevance as an extra: (query_id, id, score) of keyword queries by Okapi BM25 over the text."""
    terms = query_terms(asked(queries), fuzzy=False).where(F.col("kind") == KEYWORD).select("query_id", "term").distinct()
    sized = passages.select("id", tokenize(F.col("text")).alias("tokens")).withColumn("size", F.size("tokens"))
    totals = sized.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    tf = sized.select("id", "size", F.explode("tokens").alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("id", "size", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return tf.join(df, "term").crossJoin(totals).join(terms, "term").groupBy("query_id", "id").agg(F.sum(weight).alias("score"))

"""The index: postings, vocabulary, counts and content version."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import token_lines, tokenize
from skein.operators import ranges
from skein.sources.shared import stored

FIELDS = ("text", "title", "chapter_ref")
#: Ranges that a frequent term's postings are dealt over.
SPLITS = 16
#: Passages, about, and their occurrences, at most, from which the bounds of ranges follow.
SAMPLE, MOST_BOUNDED = 2000, 100_000
#: Bytes of tokens and number of passages in a segment, at most, about, and hits in a batch of its rows.
SEGMENT_BYTES, SEGMENT_ROWS, SENT_HITS = 8 << 20, 20_000, 20_000
SEGMENT = "term string, field string, passages int, hits array<struct<id:string,source_id:string,tf:int,places:array<int>>>"


def indexed(passages: DataFrame, sources: DataFrame) -> DataFrame:
    """Passages of enabled sources."""
    return passages.join(sources.where("enabled").select(F.col("id").alias("source_id")), "source_id", "left_semi")


def passage_tokens(passages: DataFrame) -> DataFrame:
    """(id, source_id, term): each token of any field once per passage.  Narrow: no shuffle."""
    every = F.array_distinct(F.concat(*[tokenize(F.col(f)) for f in FIELDS]))
    return passages.select("id", "source_id", F.explode(every).alias("term"))


def token_places(passages: DataFrame) -> DataFrame:
    """(id, source_id, field, pos, term) for every token."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), tokenize(F.col(f)).alias("tokens")) for f in FIELDS])
    return passages.select("id", "source_id", F.explode(fields).alias("f")).select("id", "source_id", "f.field", F.posexplode("f.tokens").alias("pos", "term"))


class Index(NamedTuple):
    """What a search reads: postings (term, field, id, source_id, tf, places), vocabulary (term, passages) and passages."""

    postings: DataFrame
    vocabulary: DataFrame
    passages: DataFrame
    stored: bool = False


def of(passages: DataFrame) -> Index:
    """The index of passages that aren't stored: computed when it is read."""
    return Index(postings(passages), vocabulary(passages), passages)


def segments(passages: DataFrame) -> DataFrame:
    """Rows of SEGMENT: a row for each term of a field of a segment of passages, with its hits in the order of the passages, sorted by
    term within the segment.

    ``passages`` counts the hits' passages but those that an earlier field's row of the term has, so that its sums over all rows are
    the vocabulary.  Narrow: no shuffle, and a worker holds a segment at a time.
    """
    lines = [token_lines(F.col(f)).alias(f"{f}_tokens") for f in FIELDS]
    return passages.select("id", "source_id", *lines).mapInArrow(segments_of, SEGMENT)


def segments_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each segment: batches are cut and joined to about SEGMENT_BYTES."""
    held, size, rows = [], 0, 0
    for batch in batches:
        step = min(SEGMENT_ROWS, max(1, batch.num_rows * SEGMENT_BYTES // max(1, batch.nbytes)))
        for begin in range(0, batch.num_rows, step):
            part = batch.slice(begin, step)
            if held and (size + part.nbytes > SEGMENT_BYTES or rows + part.num_rows > SEGMENT_ROWS):
                yield from segment(pa.Table.from_batches(held))
                held, size, rows = [], 0, 0
            held, size, rows = [*held, part], size + part.nbytes, rows + part.num_rows
    if held:
        yield from segment(pa.Table.from_batches(held))


def segment(passages: pa.Table) -> Iterator[pa.RecordBatch]:
    """One segment's rows, about SENT_HITS hits a batch.  Tokens are sorted by term, field and passage as one number each."""
    n, words, rows, fields, places = passages.num_rows, [], [], [], []
    for number, name in enumerate(FIELDS):
        text = pa.concat_arrays([pa.array([], pa.string()), *passages.column(f"{name}_tokens").cast(pa.string()).chunks])
        sizes = np.where(pc.binary_length(text).to_numpy() > 0, pc.list_value_length(split := pc.split_pattern(text, "\n")).to_numpy(), 0)
        words.append(split.filter(pa.array(sizes > 0)).flatten())
        rows.append(np.repeat(np.arange(n, dtype=np.int32), sizes))
        fields.append(np.full(len(rows[-1]), number, np.int8))
        places.append(np.arange(len(rows[-1]), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes))
    told = pa.concat_arrays(words).dictionary_encode()
    if not len(told):
        return
    in_order = pc.sort_indices(told.dictionary).to_numpy()  # in the order of bytes, as Spark compares texts
    rank = np.empty(len(in_order), np.int64)
    rank[in_order] = np.arange(len(in_order))
    key = rank[told.indices.to_numpy()]
    key *= len(FIELDS)
    key += np.concatenate(fields)
    key *= n
    key += np.concatenate(rows)
    by_key = np.argsort(key, kind="stable")
    key, place = key[by_key], np.concatenate(places)[by_key]
    del by_key, words, rows, fields, places
    begins = lambda x: np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    hit = begins(key)
    line_of, row = np.divmod(key[hit], n)
    line = begins(line_of)
    term, field = np.divmod(line_of[line], len(FIELDS))
    new = np.zeros(len(hit), np.int64)
    new[np.unique(line_of // len(FIELDS) * n + row, return_index=True)[1]] = 1
    hit_ends, line_ends = np.append(hit, len(key)), np.append(line, len(hit))
    columns = [passages.column(c).cast(pa.string()).combine_chunks().take(pa.array(row)) for c in ("id", "source_id")]
    columns += [pa.array(np.diff(hit_ends).astype(np.int32)), pa.ListArray.from_arrays(pa.array(hit_ends.astype(np.int32)), pa.array(place))]
    hits = pa.ListArray.from_arrays(pa.array(line_ends.astype(np.int32)), pa.StructArray.from_arrays(columns, ["id", "source_id", "tf", "places"]))
    of_term = told.dictionary.take(pa.array(in_order)).take(pa.array(term))
    counts = pa.array(np.add.reduceat(new, line).astype(np.int32))
    out = pa.RecordBatch.from_arrays([of_term, pa.array(FIELDS).take(pa.array(field)), counts, hits], names=["term", "field", "passages", "hits"])
    for a, b in pairwise([0, *np.flatnonzero(np.diff(line_ends[1:] // SENT_HITS)) + 1, len(line)]):
        yield out.slice(a, b - a)


def hits_of(segments: DataFrame) -> DataFrame:
    """(term, field, id, source_id, tf, places) of rows of SEGMENT."""
    return segments.select("term", "field", F.explode("hits").alias("h")).select("term", "field", "h.id", "h.source_id", "h.tf", "h.places")


def vocabulary_of(segments: DataFrame) -> DataFrame:
    """The vocabulary, from rows of SEGMENT."""
    return segments.groupBy("term").agg(F.sum("passages").alias("passages"))


def postings(passages: DataFrame) -> DataFrame:
    """(term, field, id, source_id, tf, places), sorted by term in ascending ranges of terms.

    A passage's places of a term are brought together within its row, so that the one shuffle has a row for each term of a
    passage, not for each token; a frequent term is dealt over several ranges by its passages.  The bounds of the ranges come
    from the terms of some passages, as those of all would take their texts apart twice.
    """
    count = ranges.range_count(passages)
    rows = occurrences(passages)
    dealt = rows.withColumn("part_", part_of(bounds(passages, count))).repartitionById(count, "part_")
    return dealt.drop("split", "part_").sortWithinPartitions("term", "field", "id")


def occurrences(passages: DataFrame) -> DataFrame:
    """(term, field, id, source_id, tf, places, split): each term of a field of a passage once.  Narrow: no shuffle."""
    return hits_of(segments(passages)).withColumn("split", F.pmod(F.xxhash64("id"), F.lit(SPLITS)).cast("int"))


def bounds(passages: DataFrame, count: int) -> list[tuple[str, int]]:
    """Bounds (term, split) of up to ``count`` ranges with about as many occurrences each, ascending.

    They only tell where a row is stored, none is left out by them: some SAMPLE passages, chosen by their ids, give at most
    MOST_BOUNDED occurrences to the driver."""
    few = passages.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, passages.count() // SAMPLE))) == 0)
    seen = occurrences(few).where(F.pmod(F.xxhash64("term", "id", "field"), F.lit(8)) == 0).select("term", "split").limit(MOST_BOUNDED)
    found = sorted((r.term.encode(), r.split, r.term) for r in seen.collect())  # in the order of bytes, as Spark compares texts
    told = {found[len(found) * k // count] for k in range(1, count)} if found else set()
    return [(term, split) for _, split, term in sorted(told)]


def part_of(cuts: list[tuple[str, int]]) -> Column:
    """The number of ``cuts`` that aren't above a row's (term, split), by halves."""
    term, split = F.col("term"), F.col("split")

    def within(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        low = (term < cuts[mid][0]) | ((term == cuts[mid][0]) & (split < cuts[mid][1]))
        return F.when(low, within(a, mid)).otherwise(within(mid + 1, b))

    return within(0, len(cuts))


def term_counts(passages: DataFrame) -> DataFrame:
    """(term, field, passages, times).  Both numbers are summed up per task before the one shuffle."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), tokenize(F.col(f)).alias("tokens")) for f in FIELDS])
    rows = passages.select(F.explode(fields).alias("f")).select("f.field", "f.tokens")
    one = lambda tokens, p, t: F.transform(tokens, lambda x: F.struct(x.alias("term"), F.lit(p).alias("p"), F.lit(t).alias("t")))
    seen = rows.select("field", F.explode(F.concat(one(F.array_distinct("tokens"), 1, 0), one(F.col("tokens"), 0, 1))).alias("x"))
    return seen.groupBy("x.term", "field").agg(F.sum("x.p").alias("passages"), F.sum("x.t").alias("times"))


def numbered(passages: DataFrame) -> DataFrame:
    """``passages`` with ``row_``, a number of its own for each row, ids that come again included: stored, as they must stay the same."""
    return passages if "row_" in passages.columns else stored(passages.withColumn("row_", F.monotonically_increasing_id()), "passages")


def vocabulary(passages: DataFrame) -> DataFrame:
    """(term, passages): in how many passages each term occurs."""
    return passage_tokens(passages).groupBy("term").agg(F.count("*").alias("passages"))


def passage_counts(passages: DataFrame, total: bool = True) -> DataFrame:
    """(source_id, passages), and the total under null."""
    grouped = passages.rollup("source_id") if total else passages.groupBy("source_id")
    return grouped.agg(F.count("*").alias("passages"))


def digest(parts: DataFrame, key: str, content: str) -> Column:
    """Ordered digest column over rows of ``parts``: key, colon, content and line feed of each."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(content).alias("v"))))
    joined = F.aggregate(rows, F.lit(b"").cast("binary"), lambda acc, r: F.concat(acc, F.concat(r["k"].cast("binary"), F.lit(b":"), r["v"].cast("binary"), F.lit(b"\n"))))
    return F.substring(F.sha2(joined, 256), 1, 16)


def version(files: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """One row: the first 16 hex digits of the SHA-256 over the ordered files of a registry.  Few and bounded: one per source."""
    return files.agg(digest(files, key, content).alias("version"))


def tree_version(rows: DataFrame, order: list[str], content: Column, fan: int = 256) -> DataFrame:
    """One row: n_rows and the digest of rows of any number in order: the SHA-256 of each row's ``content``, and of each ``fan`` digests
    in order, and so on until one is left; null for no rows.  Rows equal in ``order`` are in that of their digests.

    No task has more than a range of rows, or ``fan`` digests of a group at a time."""
    leaves = rows.select(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.sha2(F.coalesce(content, F.lit("")), 256).alias("digest"))
    held = ranges.placed(leaves, [*[F.col(f"o{i}") for i in range(len(order))], F.col("digest")])
    sizes = stored(held.groupBy("part_").agg(F.count("*").alias("n")), "sizes")
    n = sizes.agg(F.sum("n")).first()[0] or 0
    bases = ranges.before(sizes, [], "part_", F.col("n")).select("part_", F.coalesce("before_", F.lit(0)).alias("base"))
    level = held.join(bases, "part_").select((F.col("base") + F.col("place_")).alias("i"), "digest")
    left = n
    while left > 1:
        groups = level.groupBy(F.floor(F.col("i") / fan).alias("i")).agg(F.sort_array(F.collect_list(F.struct("i", "digest"))).alias("d"))
        level, left = groups.select("i", F.sha2(F.array_join("d.digest", ""), 256).alias("digest")), -(-left // fan)
    return level.agg(F.lit(n).cast("long").alias("n_rows"), F.max("digest").alias("digest"))


def content_version(passages: DataFrame) -> DataFrame:
    """(source_id, version) over passages of any number: each is digested on its own, and digests are summed in a way that
    doesn't depend on order or partitions."""
    one = F.sha2(F.concat_ws("\u0001", "id", F.coalesce("title", F.lit("")), F.coalesce("chapter_ref", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    number = F.conv(F.substring(one, 1, 12), 16, 10).cast("decimal(38,0)")
    return passages.groupBy("source_id").agg(F.count("*").alias("passages"), F.sum(number).alias("sum")).select("source_id", "passages", F.substring(F.sha2(F.concat_ws(":", F.col("passages").cast("string"), F.col("sum").cast("string")), 256), 1, 16).alias("version"))


def meta(passages: DataFrame, files: DataFrame) -> DataFrame:
    """One row: version and the passage count of each source."""
    counts = passage_counts(passages, total=False).agg(F.array_sort(F.collect_list(F.struct(F.col("source_id").alias("id"), F.col("passages").alias("passage_count")))).alias("sources"))
    return version(files).crossJoin(counts)


def version_changed(latest: Column, current: Column) -> Column:
    return (F.coalesce(latest, F.lit("")) != "") & ~latest.eqNullSafe(current)

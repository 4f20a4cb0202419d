"""Benchmark decontamination with suffix arrays.

Each task packs its documents into shards of about ``shard_words`` words and builds a word-level suffix array
of each shard.  All suffixes of all benchmark items are binary-searched in it at once, one word deeper per step,
which yields for each the longest verbatim match and its places.  Documents never leave their task: the only
thing sent out is the benchmark, in blocks of a checked size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Sent, dropped, pieces, raw, stored, word_table

#: Words of a shard, at most, unless one document alone has more.
SHARD_WORDS = 1 << 19
#: Bytes of benchmark text in one block, about an eighth of what its broadcast takes; a larger benchmark takes several passes.
BLOCK_BYTES = 4 << 20


@dataclass
class Tests:
    """A block of benchmark items as word ids from 1; 0 ends each item."""

    vocabulary: dict[bytes, int]
    words: np.ndarray
    item_of: np.ndarray  # row number of the item that each word belongs to
    offset: np.ndarray  # its place within the item
    left: np.ndarray  # words from here to the item's end
    window: np.ndarray  # window length for windows that start here, 0 where none does
    item_ids: list[int | None]
    first: int = 0  # number of the block's first item


def prepare(items: list[tuple[int | None, str | None]], window: int) -> Tests:
    table, vocabulary = word_table(), {}
    ids, item_of, offset, left, starts = [], [], [], [], []
    for row, (_, text) in enumerate(items):
        words = (text or "").encode().translate(table).split()
        n = len(words)
        ids += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words] + [0]
        item_of += [row] * (n + 1)
        offset += range(n + 1)
        left += range(n, -1, -1)
        size = min(window, n)
        starts += [size] * (n - size + 1 if n else 0) + [0] * (size if n else 1)
    as_array = lambda x: np.array(x, np.int64)
    return Tests(vocabulary, as_array(ids), as_array(item_of), as_array(offset), as_array(left), as_array(starts), [i for i, _ in items])


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of the non-zero ``ids`` in the order of the suffixes that start there, compared over ``depth`` words.

    Prefix doubling that sorts again only groups still tied.  0 marks a word that no benchmark item has, or a
    document's end: no match crosses it, so suffixes need no order beyond it.
    """
    places = np.flatnonzero(ids)
    m = len(places)
    sa = places[np.argsort(ids[places], kind="stable")]
    rank = np.zeros(len(ids) + 2 * depth + 2, np.int64)
    slots, key, h = np.arange(m), ids[sa].astype(np.int64), 1
    first = True
    while len(slots):
        if not first:
            p = sa[slots]
            key = rank[p] * (m + 2) + rank[p + h]
            order = np.argsort(key, kind="stable")
            p, key = p[order], key[order]
            sa[slots] = p
            h *= 2
        new = np.empty(len(slots), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        rank[sa[slots]] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        done = new & np.append(new[1:], True)
        if not first:
            done |= key % (m + 2) == 0
        slots = slots[~done]
        first = False
        if h >= depth:
            break
    return sa


def search(ids: np.ndarray, sa: np.ndarray, tests: Tests) -> tuple[np.ndarray, ...]:
    """Binary search of every test suffix: its longest match, the range of places that have it, and the range of
    places that have the whole window that starts there (empty if none)."""
    n = len(tests.words)
    padded = np.append(ids, np.zeros(2, ids.dtype))
    firsts = ids[sa]
    lo = np.searchsorted(firsts, tests.words, "left")
    hi = np.where(tests.words > 0, np.searchsorted(firsts, tests.words, "right"), lo)
    longest = (hi > lo).astype(np.int64)
    win_lo, win_hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live, depth = np.flatnonzero(longest), 1
    while len(live):
        at = live[tests.window[live] == depth]
        win_lo[at], win_hi[at] = lo[at], hi[at]
        live = live[tests.left[live] > depth]
        want = tests.words[live + depth]

        def bound(upper: bool) -> np.ndarray:
            a, b = lo[live].copy(), hi[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                found = padded[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + depth, len(padded) - 1)]  # noqa: B023
                right = open_ & ((found <= want) if upper else (found < want))  # noqa: B023
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            return a

        a, b = bound(False), bound(True)
        some = b > a
        live = live[some]
        lo[live], hi[live] = a[some], b[some]
        depth += 1
        longest[live] = depth
    return longest, lo, hi, win_lo, win_hi


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each comes from."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[which], which


@dataclass
class Shard:
    """What a search found in one shard of documents."""

    n_words: np.ndarray
    n_hit: np.ndarray
    items: list[set[int]]  # for each document, the rows of items with windows in it
    starts: np.ndarray
    sa: np.ndarray
    found: tuple[np.ndarray, ...]


def scan_shard(texts: list[list[bytes]], tests: Tests, depth: int) -> Shard:
    sizes = np.array([len(w) for w in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    ids = np.zeros(int(sizes.sum()) + len(texts) + 1, np.int32)
    look = tests.vocabulary.get
    for words, at in zip(texts, starts, strict=True):
        if words:
            ids[at : at + len(words)] = np.fromiter(map(look, words, repeat(0)), np.int32, len(words))
    sa = suffix_array(ids, depth)
    found = search(ids, sa, tests)
    win_lo, win_hi = found[3], found[4]
    used = np.flatnonzero(win_hi > win_lo)
    hits, items = np.zeros(len(ids) + 1, np.int64), [set() for _ in texts]
    if len(used):
        keys, inverse = np.unique(np.stack([win_lo[used], win_hi[used], tests.window[used]], axis=1), axis=0, return_inverse=True)
        slots, which = ranges(keys[:, 0], keys[:, 1])
        places = sa[slots]
        np.add.at(hits, places, 1)
        np.subtract.at(hits, places + keys[which, 2], 1)
        docs = np.searchsorted(starts, places, "right") - 1
        both = np.unique(np.stack([which, docs], axis=1), axis=0)
        begin = np.searchsorted(both[:, 0], np.arange(len(keys) + 1))
        told = np.unique(np.stack([inverse.reshape(-1), tests.item_of[used]], axis=1), axis=0)
        for key, item in told.tolist():
            for doc in both[begin[key] : begin[key + 1], 1].tolist():
                items[doc].add(item)
    total = np.concatenate([[0], np.cumsum(np.cumsum(hits) > 0)])
    return Shard(sizes, total[starts + sizes] - total[starts], items, starts, sa, found)


def shards(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches of at most ``limit`` words, with the words of their texts."""
    table = word_table()
    for batch in batches:
        begin, end, texts, n = 0, 0, [], 0
        for part in pieces([batch]):
            for text in raw(part.column(column)):
                words = text.translate(table).split()
                if texts and n + len(words) > limit:
                    yield batch.slice(begin, end - begin), texts
                    begin, texts, n = end, [], 0
                texts.append(words)
                n += len(words)
                end += 1
        if texts:
            yield batch.slice(begin), texts


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The benchmark's items in blocks of at most ``block_bytes`` of text (or one item), streamed to the driver: it holds one
    block and one partition of the benchmark at a time."""
    held, size = [], 0
    for item, text in benchmark.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).distinct().toLocalIterator():
        more = len((text or "").encode())
        if held and size + more > block_bytes:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += more
    yield held


def scanned(docs: DataFrame, sent: Sent, text_col: str, shard_words: int, emit: Callable, schema: str) -> DataFrame:
    def run(batches):
        block = sent.get()
        depth = int(block.left.max(initial=1))
        for rows, texts in shards(batches, text_col, shard_words):
            yield from emit(rows, scan_shard(texts, block, depth), block)

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are lower-cased ASCII letters, digits and non-ASCII characters; a window is ``window`` consecutive item
    words (a shorter item is one window); a document word inside any window's occurrence is hit.  Null and empty
    texts have no words and are clean; repeated documents each get their row; repeated items count once per id;
    an item without id marks words but is not counted; an empty benchmark hits nothing.  A benchmark of one block,
    the usual case, takes one pass without a shuffle; more blocks are joined by the items and places they hit.  Rows without
    id are told like others, texts of any length are searched whole, an empty table gives no rows, and other columns may have
    any names.
    """
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    parts = blocks(benchmark, item_col, item_text_col, block_bytes)
    first = next(parts)
    if (second := next(parts, None)) is not None:
        return merged(narrow, chain([first, second], parts), window, shard_words)

    def emit(rows, shard, block):
        named = [sorted({str(block.item_ids[i]) for i in s if block.item_ids[i] is not None}) for s in shard.items]
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(shard.n_words), pa.array(shard.n_hit), pa.array([len(x) for x in named], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named]), pa.array(shard.n_hit > 0)],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    return scanned(narrow, Sent(docs.sparkSession, prepare(first, window)), "text", shard_words, emit, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


HITS = "doc_id long, copy long, places array<long>, items array<string>"


def merged(narrow: DataFrame, parts: Iterable[list], window: int, shard_words: int) -> DataFrame:
    """The digests over several benchmark blocks: the places and items that each block hits, stored block by block so that one
    broadcast is alive at a time, and then merged per document row."""

    def emit(rows, shard, block):
        win_lo, win_hi = shard.found[3], shard.found[4]
        used = np.flatnonzero(win_hi > win_lo)
        slots, which = ranges(win_lo[used], win_hi[used])
        places, sizes = shard.sa[slots], block.window[used][which]
        docs = np.searchsorted(shard.starts, places, "right") - 1
        spans = [set() for _ in shard.items]
        for doc, at, size in zip(docs.tolist(), (places - shard.starts[docs]).tolist(), sizes.tolist(), strict=True):
            spans[doc].update(range(at, at + size))
        hit = [i for i, s in enumerate(spans) if s]
        named = [sorted({str(block.item_ids[i]) for i in shard.items[k] if block.item_ids[i] is not None}) for k in hit]
        at = pa.array(hit, pa.int64())
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(at), rows.column("copy").take(at), pa.array([sorted(spans[k]) for k in hit], pa.list_(pa.int64())), pa.array(named, pa.list_(pa.string()))], names=["doc_id", "copy", "places", "items"])

    spark = narrow.sparkSession
    marked, every = narrow.withColumn("copy", F.xxhash64("text")), None
    for part in parts:
        sent = Sent(spark, prepare(part, window))
        one = stored(scanned(marked, sent, "text", shard_words, emit, HITS).distinct(), "hits")  # repeated rows hit the same
        sent.held.destroy()
        every = one if every is None else every.unionByName(one)
    told = every.groupBy("doc_id", "copy").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def counted(batches):
        for rows, texts in shards(batches, "text", shard_words):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("copy"), pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "copy", "n_words"])

    rows = marked.mapInArrow(counted, "doc_id long, copy long, n_words long")
    same = rows.doc_id.eqNullSafe(told.doc_id) & (rows.copy == told.copy)
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.size("places"), F.lit(0)).cast("long")
    return rows.join(told, same, "left").select(rows.doc_id, "n_words", F.greatest(n_hit, F.lit(0)).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


MATCHES = "item long, item_id long, item_word long, row long, doc_id long, doc_word long, n_words long"


def longest_matches(docs: DataFrame, benchmark: DataFrame, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Longest verbatim matches with their places: item_id, item_word, doc_id, doc_word, n_words.

    For each benchmark suffix the longest match of at least ``min_words`` words over all shards, at every place that has it; a
    suffix of a longer match one word earlier at the same place is left out.  Repeated documents have their matches once; null and
    empty texts have none, texts of any length are searched whole; an empty table or benchmark gives no rows; other columns may
    have any names.
    """
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("row"))

    def emit(rows, shard, block):
        longest, lo, hi = shard.found[:3]
        used = np.flatnonzero(longest >= min_words)
        slots, which = ranges(lo[used], hi[used])
        places, suffix = shard.sa[slots], used[which]
        where = np.searchsorted(shard.starts, places, "right") - 1
        at = pa.array(where)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.item_of[suffix] + block.first), pa.array([block.item_ids[i] for i in block.item_of[suffix].tolist()], pa.int64()), pa.array(block.offset[suffix]), rows.column("row").take(at), rows.column("doc_id").take(at), pa.array(places - shard.starts[where]), pa.array(longest[suffix])],
            names=["item", "item_id", "item_word", "row", "doc_id", "doc_word", "n_words"],
        )

    found, first = None, 0
    for part in blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = Sent(docs.sparkSession, replace(prepare(part, min_words), first=first))
        one = stored(scanned(narrow, sent, "text", shard_words, emit, MATCHES).distinct(), "matches")
        sent.held.destroy()
        found, first = one if found is None else found.unionByName(one), first + len(part)
    best = found.join(found.groupBy("item", "item_word").agg(F.max("n_words").alias("n_words")), ["item", "item_word", "n_words"])
    best = stored(best, "longest_matches")
    here = lambda c, step: F.col(c) + step
    longer = best.select("item", here("item_word", 1).alias("item_word"), "row", F.coalesce("doc_id", F.lit(0)).alias("doc"), here("doc_word", 1).alias("doc_word"), here("n_words", -1).alias("n_words"))
    kept = best.withColumn("doc", F.coalesce("doc_id", F.lit(0))).join(longer, ["item", "item_word", "row", "doc", "doc_word", "n_words"], "left_anti")
    return kept.select("item_id", "item_word", "doc_id", "doc_word", "n_words")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all their columns, in which no window of the benchmark occurs.  Rows pass straight through, whatever their
    ids, one block of the benchmark after another: what a block leaves is stored before the next one is broadcast.  Null and empty
    texts are kept, whatever the other columns are called; texts of any length are searched whole."""
    out, sent, held = docs, None, None
    for part in blocks(benchmark, item_col, item_text_col, block_bytes):
        if sent is not None:
            out = stored(out, "clean")
            sent.held.destroy()
            if held is not None:
                dropped(held)
            held = out

        def emit(rows, shard, block):
            yield rows.filter(pa.array(shard.n_hit == 0))

        sent = Sent(docs.sparkSession, prepare(part, window))
        out = scanned(out, sent, text_col, shard_words, emit, docs.schema)
    return out

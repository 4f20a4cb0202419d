"""Near copies of whole texts: Jaccard similarity of word shingles, verified exactly.

Candidates come from SimHash (fingerprints that anchors link within 3 bits share a bucket) and, as no radius that anchors
can cover reaches a similarity of 0.8, from MinHash bands beside it: at 0.8, (1 - 0.8^6)^48, or 5 pairs in 10^7, share no band.
Each bucket is compared with one of its members, the pivot, whatever its size; what that leaves apart, with another, and
then within tasks, in blocks.  Only links are sent out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import simhash
from skein.llm.common import dropped, pieces, raw, spread_join, stored
from skein.llm.components import connected, roots
from skein.llm.decontaminate import ranges

#: Words of a shingle, and the similarity from which two texts are near copies.
SHINGLE, SIMILAR = 5, 0.8
#: Bands of a sketch and minima of a band.
BANDS, ROWS = 48, 6
#: Rounds of pivots; nodes outside the main component, and members, of a block of a bucket that a task then compares; and the
#: number of nodes outside from which a bucket is dealt anew first, by its members' rarest shingles.
PIVOTS, OUTER, MEMBERS, MANY = 2, 1024, 4096, 4096
#: For hashes of shingles: the factor between words, and that of the last mixing.
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles in order: A-Z lower-cased, words between ASCII white space; fewer words make one shingle."""
    words = text.lower().split()
    values = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(words))
    n = max(1, len(words) - shingle + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * FACTOR + values[k : k + n]
    out ^= out >> np.uint64(32)
    return out * MIX


def factors() -> np.ndarray:
    """Odd multipliers, one for each minimum of a sketch."""
    return np.random.default_rng(11).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def bands(hashes: np.ndarray, by: np.ndarray) -> list[int]:
    """Keys of the bands, signed: hashes of their minima."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(by), np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(low), 512):
        np.minimum(least, (low[a : a + 512, None] * by[None, :]).min(axis=0), out=least)
    held = least.tobytes()
    return [(h := xxhash.xxh64_intdigest(held[k * ROWS * 4 : (k + 1) * ROWS * 4], k)) - (h >> 63 << 64) for k in range(BANDS)]


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, fp, bands) of distinct texts."""

    def run(batches):
        by = factors()
        for batch in pieces(batches):
            fps, keys = [], []
            for text in raw(batch.column(1)):
                hashes = shingle_hashes(text, shingle)
                fps.append(simhash.majority(hashes))
                keys.append(bands(hashes, by))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["node", "fp", "bands"])

    return texts.mapInArrow(run, "node long, fp long, bands array<long>").dropDuplicates(["node"])


def fingerprint_buckets(sketched: DataFrame) -> DataFrame:
    """(key, node): nodes whose fingerprints are joined by links within 3 bits share a key."""
    distinct = stored(sketched.groupBy("fp").agg(F.count("*").alias("n_")), "fingerprints")
    joined = connected(simhash.links(distinct))
    group = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", F.xxhash64(F.lit("fp"), F.coalesce("component", "fp")).alias("key"))
    return spread_join(sketched.select("node", "fp"), group, "fp", counts=distinct).select("key", "node")


def shared(keyed: DataFrame) -> DataFrame:
    """The rows (key, node) whose key has several nodes, stored."""
    several = keyed.groupBy("key").agg(F.count("*").alias("n_"), F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "n_")
    several = stored(several, "several")
    return stored(spread_join(keyed, several.select("key"), "key", counts=several, total=several.agg(F.coalesce(F.sum("n_"), F.lit(0))).first()[0]), "buckets")


def similarities(pairs: DataFrame, held: DataFrame, shingle: int) -> DataFrame:
    """``pairs`` (u, v) with their Jaccard similarity j, exact, from the texts ``held`` (node, text).  Rows of one u that come
    together share its shingles."""

    def run(batches):
        last, first = None, None
        for batch in pieces(batches, 64):
            found = []
            for u, one, other in zip(batch.column(0).to_pylist(), raw(batch.column(2)), raw(batch.column(3)), strict=True):
                if u != last:
                    last, first = u, np.unique(shingle_hashes(one, shingle))
                second = np.unique(shingle_hashes(other, shingle))
                small, large = (first, second) if len(first) < len(second) else (second, first)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                found.append(both / (len(first) + len(second) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["u", "v", "j"])

    ends = held.select(F.col("node").alias("v"), F.col("text").alias("other"))
    begins = held.select(F.col("node").alias("u"), F.col("text").alias("one"))
    met = spread_join(pairs.join(ends, "v"), begins, "u", counts=pairs.groupBy("u").agg(F.count("*").alias("n_")), total=pairs.count())
    return met.select("u", "v", "one", "other").mapInArrow(run, "u long, v long, j double")


def rare_shingles(nodes: DataFrame, held: DataFrame, shingle: int, similar: float) -> DataFrame:
    """(key, node): of each text the n - ceil(similar * n) + 1 shingles that fewest of these texts have.  Similar texts share
    one of them, whatever boilerplate they share with others."""

    def run(batches):
        for batch in pieces(batches, 64):
            for node, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                grams = np.unique(shingle_hashes(text, shingle)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.full(len(grams), node)), pa.array(np.full(len(grams), len(grams) - ceil(similar * len(grams) - 1e-9) + 1))], names=["key", "node", "take"])

    grams = stored(held.join(nodes, "node", "left_semi").mapInArrow(run, "key long, node long, take long"), "grams")
    seen = stored(grams.groupBy("key").agg(F.count("*").alias("n_")), "gram_counts")
    ranked = spread_join(grams, seen, "key", counts=seen).withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("n_", "key")))
    return ranked.where("rank <= take").select("key", "node")


def states(buckets: DataFrame, joined: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, node, component, size, outside, main, pivot, pivot_component) of the buckets whose nodes aren't all joined
    yet, and the sizes of those buckets.  ``main`` is the bucket's largest component, ``outside`` the number of nodes beyond it;
    the pivot is the smallest node in round 0 and then another in each bucket and round."""
    known = buckets.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    known = stored(known, "known")
    order = F.lit(0).cast("long") if n == 0 else F.xxhash64("node", "key", F.lit(n))
    parts = known.groupBy("key", "component").agg(F.count("*").alias("n"), F.min(F.struct(order.alias("order"), "node", "component")).alias("pivot"))
    stat = parts.groupBy("key").agg(F.sum("n").alias("n_"), F.max(F.struct("n", "component")).alias("main"), F.min("pivot").alias("pivot")).where("n_ > main.n")
    stat = stored(stat.select("key", "n_", (F.col("n_") - F.col("main.n")).alias("outside"), F.col("main.component").alias("main"), F.col("pivot.node").alias("pivot"), F.col("pivot.component").alias("pivot_component")), "bucket_stats")
    rows = spread_join(known, stat.withColumnRenamed("n_", "size"), "key", counts=stat.select("key", "n_"), total=known.count())
    rows = stored(rows, "bucket_rows")
    dropped(known)
    return rows, stat


def settle(batches: Iterator[pa.RecordBatch], shingle: int, similar: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, o, c, member, node, component, text) sorted by the first four: the nodes outside the main component come
    first and are indexed by shingle, then the members stream by.  Emits verified links (u, v) between components."""
    now, outer, index = None, [], None

    def built() -> tuple[np.ndarray, ...]:
        sizes = np.array([len(g) for _, _, g in outer])
        grams, owner = np.concatenate([g for _, _, g in outer]), np.repeat(np.arange(len(outer)), sizes)
        order = np.argsort(grams, kind="stable")
        return grams[order], owner[order], sizes, np.array([n for n, _, _ in outer]), np.array([c for _, c, _ in outer])

    for batch in pieces(batches):
        found = []
        for key, o, c, member, node, component, text in zip(*(batch.column(k).to_pylist() for k in range(6)), raw(batch.column(6)), strict=True):
            if (key, o, c) != now:
                now, outer, index = (key, o, c), [], None
            own = np.unique(shingle_hashes(text, shingle))
            if not member:
                outer.append((node, component, own))
                continue
            if not outer:
                continue
            grams, owner, sizes, nodes, components_ = index = index or built()
            slots, _ = ranges(np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right"))
            both = np.bincount(owner[slots], minlength=len(nodes))
            near = (both >= similar * (sizes + len(own) - both) - 1e-9) & (components_ != component)
            found += [(node, int(v)) for v in nodes[near]]
        star = roots(np.array(found, np.int64).reshape(-1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(star[:, 0]), pa.array(star[:, 1])], names=["u", "v"])


def settled(rows: DataFrame, held: DataFrame, shingle: int, similar: float) -> DataFrame:
    """Links (u, v) of all nodes outside their bucket's main component with all members of the bucket, in blocks of bounded
    size: a task has some of the outer nodes and streams some of the members."""
    blocks = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    rows = rows.withColumns({"os": blocks("outside", OUTER), "cs": blocks("size", MEMBERS)})
    members = rows.select("key", F.explode(upto(F.col("os"))).alias("o"), own(F.col("cs")).alias("c"), F.lit(1).alias("member"), "node", "component")
    outer = rows.where("component <> main").select("key", own(F.col("os")).alias("o"), F.explode(upto(F.col("cs"))).alias("c"), F.lit(0).alias("member"), "node", "component")
    dealt = members.union(outer).join(held, "node").select("key", "o", "c", "member", "node", "component", "text")
    return dealt.repartition("key", "o", "c").sortWithinPartitions("key", "o", "c", "member").mapInArrow(lambda b: settle(b, shingle, similar), "u long, v long")


def links(buckets: DataFrame, held: DataFrame, shingle: int, similar: float) -> DataFrame:
    """(node, component): nodes joined by similarities of ``similar`` or more within stored ``buckets`` (key, node), all
    members of components of several.

    Every pair of a bucket is compared, or joined by others already.  First all members are held against one, and what is
    still apart against another, which joins most of what there is; then the nodes still outside the main component are held
    against all of their bucket, within tasks.  Where many are left, as under common boilerplate, the members are dealt anew
    by their rarest shingles first.
    """
    edges = buckets.select(F.col("node").alias("u"), F.col("node").alias("v")).where("false")
    joined = edges.toDF("node", "component")
    for last in (False, True):
        for n in range(PIVOTS + 1):
            rows, stat = states(buckets, joined, n)
            if stat.isEmpty():
                return joined
            if n < PIVOTS:
                pairs = stored(rows.where("component <> pivot_component").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct(), "pairs")
                found = similarities(pairs, held, shingle).where(F.col("j") >= similar - 1e-9).select("u", "v")
            else:
                found = settled(rows if last else rows.where(F.col("outside") <= MANY), held, shingle, similar)
            edges = stored(edges.union(found), "similar")
            joined = stored(with_least(connected(edges)), "joined")
            buckets = rows.where("node <> pivot").select("key", "node") if n == 0 else rows.select("key", "node")
            dropped(stat)
        rest = rows.where(F.col("outside") > MANY).select("node")
        if last or rest.isEmpty():
            return joined
        buckets = shared(rare_shingles(rest.distinct(), held, shingle, similar))


def with_least(found: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of each component too."""
    return found.union(found.select("component").distinct().select("component", F.col("component").alias("c"))).toDF("node", "component")


def components(texts: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """(node, component) of ``texts(node long, text)``: nodes joined by similarity, all members of components of several.

    Where different texts have one node, that with the least MD5 digest stands for it."""
    sketched = stored(sketches(texts, shingle), "sketches")
    keyed = sketched.select(F.explode("bands").alias("key"), "node").union(fingerprint_buckets(sketched))
    buckets = shared(keyed)
    wanted = texts.join(buckets.select("node").distinct().hint("merge"), "node", "left_semi")
    held = stored(wanted.groupBy("node").agg(F.min_by("text", F.md5("text")).alias("text")), "candidate_texts")
    dropped(sketched)
    return links(buckets, held, shingle, similar)


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """The documents, all their columns, one of each group of near copies: that with the smallest id, one without id last.

    A group is joined by pairs whose sets of ``shingle``-word shingles have a Jaccard similarity of ``similar`` or more,
    verified on whole texts of any length; texts without words are alike, and null texts are empty.  It is decided by row:
    rows with one id and different texts are different documents; of rows that agree in text and id one stays, whatever their
    other columns, which may have any names.  An empty table stays empty.

    Texts are the same if their 64-bit hash and their MD5 digest are: 192 bits.  Should two texts share the first alone, the one with
    the least digest is compared with others and the other one stays.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    order = F.struct(F.col(f"`{id_col}`").isNull().alias("no_id"), F.col(f"`{id_col}`").alias("id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_hash(text).alias("own"), F.unhex(F.md5(text)).alias("digest"), order.alias("at"))
    members = components(docs.select(text_hash(text).alias("node"), text.alias("text")), shingle, similar)
    first = rows.groupBy("own").agg(F.min(F.struct("digest", "at")).alias("least"))
    placed = stored(members.join(first, members.node == first.own).select("node", "component", "least.digest", F.struct("least.at", "node").alias("place")), "placed")
    best = placed.groupBy("component").agg(F.min("place").alias("best"), F.count("*").alias("n_"))
    best = stored(best, "best")
    gone = spread_join(placed, best.select("component", "best"), "component", counts=best.select("component", "n_")).where("place <> best").select(F.col("node").alias("own"), "digest")
    hashed = [F.col(f"doc.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    one = rows.groupBy("own", "digest").agg(F.min_by("doc", F.struct("at", F.xxhash64(*hashed))).alias("doc"))
    return one.join(gone, ["own", "digest"], "left_anti").select(*[F.col(f"doc.`{c}`") for c in docs.columns])

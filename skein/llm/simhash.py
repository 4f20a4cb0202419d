"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint has two halves; fingerprints within 3 bits have a half within 1 bit.  The anchors of a half
are the code words of a perfect binary Golay code on 23 of its bits (covering radius 3) beside its other 9 bits as
they are (radius 0).  A half is replicated to every anchor within covering radius plus threshold, radius counted
for the code part and the plain part together, so that two halves within the threshold always share an anchor.
Fingerprints are compared only within an anchor; a crowded anchor is split again, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import HOT_SHARE, pieces, raw, spread_join, stored
from skein.llm.components import connected, roots

#: Bits of a half under the code, and its generator polynomial (fixed values of the binary Golay code).
CODE_BITS, GENERATOR = 23, 0b101011100011
HALF_BITS = 32
#: Fingerprints of an anchor compared all with all; more are first split by bytes of the other half.
CROWDED = 512
#: The bits of each byte value.
BITS = (np.arange(256)[:, None] >> np.arange(8)[None, :] & 1).astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is 1 if set in over half of them."""
    split, value = hashes.view(np.uint8).reshape(-1, 8), 0
    for byte in range(8):
        ones = np.bincount(split[:, byte], minlength=256) @ BITS
        for bit in np.flatnonzero(2 * ones > len(hashes)).tolist():
            value |= 1 << (8 * byte + bit)
    return value


def fingerprints(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """SimHash of each text: A-Z lower-cased, words between ASCII white space, all ``shingle``-word shingles under
    XXH64 with seed 42; a bit is 1 if set in over half of them.  Fewer words make one shingle, no words give 0."""
    out = np.zeros(len(texts), np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        if len(words) <= shingle:
            out[i] = digest(join(words), 42)
            continue
        grams = map(join, zip(*(words[k:] for k in range(shingle)), strict=False))
        out[i] = majority(np.fromiter((digest(g, 42) for g in grams), np.uint64, len(words) - shingle + 1))
    return out


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(CODE_BITS - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def cosets() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of weight up to 3, and the errors of weight 4 (-1 pads).  Subtracting one from a word
    gives an anchor at distance 3 or less (there is exactly one) and those at distance 4."""
    errors = lambda w: np.array([sum(1 << b for b in c) for c in combinations(range(CODE_BITS), w)], np.int64)
    near = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        e = errors(weight)
        near[syndromes(e)] = e
    four = errors(4)
    at = syndromes(four)
    order = np.argsort(at, kind="stable")
    at, four = at[order], four[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    far = np.full((2048, int(rank.max()) + 1), -1, np.int64)
    far[at, rank] = four
    return near, far


def anchors(half: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of each anchor of 32-bit ``half`` words within the covering radius plus a threshold of 1."""
    code, plain = half & ((1 << CODE_BITS) - 1), half >> CODE_BITS
    s = syndromes(code)
    home = code ^ near[s]
    rows = np.arange(len(half))
    out = [(rows, plain << CODE_BITS | home)]
    for bit in range(HALF_BITS - CODE_BITS):
        out.append((rows, (plain ^ 1 << bit) << CODE_BITS | home))
    for column in far.T:
        error = column[s]
        some = error >= 0
        out.append((rows[some], plain[some] << CODE_BITS | code[some] ^ error[some]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def close_pairs(values: np.ndarray, bits: int) -> np.ndarray:
    """Stars, as index pairs, over all ``values`` within ``bits``: blocks of rows against blocks of rows, each
    reduced at once, so that memory stays the size of a block."""
    links = []
    for a in range(0, len(values), 512):
        for b in range(0, a + 512, 4096):
            near = np.bitwise_count(values[a : a + 512, None] ^ values[None, b : min(b + 4096, a + 512)]) <= bits
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            links.append(roots(np.stack([i, j], axis=1)[i > j]))
    return roots(np.concatenate(links)) if links else np.empty((0, 2), np.int64)


def links_of_anchor(values: np.ndarray, bits: int, other_shift: int) -> np.ndarray:
    """Stars over the fingerprints of one anchor.  A crowded one is split by the bytes of the other half, of which
    at least one is equal in fingerprints within 3 bits."""
    if len(values) <= CROWDED:
        return values[close_pairs(values, bits)]
    found = []
    for byte in range(4):
        part = values >> np.uint64(other_shift + 8 * byte) & np.uint64(255)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:
                found.append(values[group][close_pairs(values[group], bits)])
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.uint64)
    return roots(pairs.astype(np.uint64).view(np.int64)).view(np.uint64)


def compare(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Batches of (key, part, fp) sorted by key and part; emits stars (u, v) over fingerprints that link within both."""

    def out(pairs: list[np.ndarray]) -> pa.RecordBatch:
        star = roots(np.concatenate([p.view(np.int64) for p in pairs]))
        return pa.RecordBatch.from_arrays([pa.array(star[:, 0]), pa.array(star[:, 1])], names=["u", "v"])

    now, held = None, []  # the group that may go on in the next batch
    found: list[np.ndarray] = []

    def groups(keys: np.ndarray, bounds: np.ndarray, fps: np.ndarray) -> None:
        sizes = np.diff(bounds)
        small = sizes <= 32  # all these at once: row i against row i + lag of the same group
        same = np.repeat(np.where(small, np.arange(len(sizes)), -1), sizes)
        lag = 1
        while (pair := (same[lag:] == same[:-lag]) & (same[lag:] >= 0)).any():
            at = np.flatnonzero(pair)
            at = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= bits]
            if len(at):
                found.append(np.stack([fps[at], fps[at + lag]], axis=1))
            lag += 1
        for g in np.flatnonzero(~small).tolist():
            a, b = bounds[g], bounds[g + 1]
            found.append(links_of_anchor(fps[a:b], bits, 32 if keys[a] >> HALF_BITS == 0 else 0))

    def finish() -> None:
        if held:
            fps = np.concatenate(held)
            groups(np.full(len(fps), now[0]), np.array([0, len(fps)]), fps)
            held.clear()

    for batch in batches:
        keys, parts, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
        if not len(keys):
            continue
        bounds = np.concatenate([[0], np.flatnonzero((np.diff(keys) != 0) | (np.diff(parts) != 0)) + 1, [len(keys)]])
        if (keys[0], parts[0]) != now:
            finish()
        first, last = (bounds[1] if held else 0), bounds[-2]
        if held:
            held.append(fps[:first])
            if len(bounds) > 2:
                finish()
        if first < len(keys):
            inner = bounds[(bounds >= first) & (bounds <= last)]
            if len(inner) > 1:
                groups(keys[first:last], inner - first, fps[first:last])
            held.append(fps[last:])
        now = (keys[-1], parts[-1])
        if sum(map(len, found)) > 1 << 18:
            yield out(found)
            found = []
    finish()
    if found:
        yield out(found)


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; a null text is empty."""

    def run(batches):
        for batch in pieces(batches):
            fps = fingerprints(raw(batch.column(1)), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, bits: int = 3) -> DataFrame:
    """Edges (u, v) that join, into the right components, all fingerprints ``fp`` within ``bits`` <= 3 of each other.

    A hot anchor is dealt over many tasks by the bytes of the other half, one of which is equal in fingerprints within 3 bits.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two halves and a threshold of one bit in each cover up to 3 bits")

    def replicate(batches):
        near, far = cosets()
        for batch in batches:
            fps = batch.column(0).to_numpy()
            bare = fps.view(np.uint64)
            for k, half in enumerate((bare & np.uint64(0xFFFFFFFF), bare >> np.uint64(32))):
                rows, keys = anchors(half.astype(np.int64), near, far)
                for a in range(0, len(rows), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 16)] | k << HALF_BITS), pa.array(fps[rows[a : a + (1 << 16)]])], names=["key", "fp"])

    sent = distinct.select("fp").mapInArrow(replicate, "key long, fp long")
    # a fingerprint has at most 32 anchors, so at most 32 * HOT_SHARE anchors are near more than one in HOT_SHARE of the fingerprints
    hot = F.broadcast(sent.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * HOT_SHARE > distinct.count()).select("key", F.lit(True).alias("hot")))
    other = F.when(F.col("key") < 1 << HALF_BITS, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    by_byte = F.array(*[F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(255)) + F.lit(256 * k) for k in range(4)])
    dealt = sent.join(hot, "key", "left").select("key", F.explode(F.when(F.col("hot"), by_byte).otherwise(F.array(F.lit(-1).cast("long")))).alias("part"), "fp")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(lambda batches: compare(batches, bits), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Fingerprints that differ in ``bits`` or fewer bits are linked; exact copies share one fingerprint and are
    compared once.  Null and empty texts have fingerprint zero and link like any other.  Rows with a null doc_id
    take part and carry the component of their fingerprint, which is null only if no document in it has an id.
    Repeated rows each get their row.  Texts of any length are hashed whole; an empty table gives no rows; other columns may
    have any names.
    """
    table = stored(fingerprint_table(docs, id_col, text_col, shingle), "simhash")
    distinct = stored(table.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_")), "fingerprints")
    nodes = connected(links(distinct, bits))
    joined = stored(distinct.join(nodes, distinct.fp == nodes.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "joined_fingerprints")
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = spread_join(joined.select("fp", "component"), smallest, "component").select("fp", "component_id")
    whole = spread_join(table, of_fp, "fp", counts=distinct.select("fp", "n_"))
    return whole.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

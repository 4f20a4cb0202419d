"""Token ids as ORC: integer run lengths, row indexes, and Bloom filters on document ids.

Documents are dealt by ranges of doc_id and sorted, each task encodes its documents and Spark's ORC writer lays
them out in stripes.  A part's rows carry their offset within the part; the offsets of the parts are a running sum
over one row per part, so no task ever sees all documents.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import pieces as slices
from skein.llm.common import scratch

#: Bytes that a worker's encoded pieces may take from batch to batch; bytes of text in a batch and of pieces in a
#: call of the library, about.
CACHE_BYTES, BATCH_BYTES, CALL_BYTES = 12 << 20, 8 << 20, 256 << 10
#: Bytes of text in a part, about, where the session's number of shuffle partitions gives larger ones; parts whose bounds are
#: found by quantiles, and parts of any table, at most.
PART_BYTES, QUANTILES, MOST_PARTS = 128 << 20, 4096, 1 << 20
SCHEMA = "doc_id long, part int, place long, n_tokens long, tokens array<int>"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the others in
    ascending order from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(0x100 + others.index(b)) for b in range(256)}


#: White space as Python and the library see it, for Arrow's patterns, and letters that the pre-token pattern never cuts between.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LETTER = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}]"


class Encoder:
    """Encodes whole texts as ``encode(text, add_special_tokens=False)`` of the tokenizers library does.

    With a byte-level BPE, the pre-tokenizer always cuts before a single space that precedes a non-space, and around a single
    line feed between non-spaces, so a text's ids are those of its pieces between such places, one after another.  Each distinct
    piece of a batch of texts is encoded once, many to a call: those of Latin letters and a last mark, whose pre-tokens are plain,
    by the library's BPE model alone, all others by the library as it is, joined as in a text.  Tokens that begin with a space or
    are a line feed tell where a piece begins.  Any text in which a space or line feed stands beside other white space or at an
    end, and any text that has the string of an added token, is given to the library as a whole.  So is every text if the
    file has any other kind of tokenizer.  ``pattern`` isn't needed, as the library cuts by the file's own.
    """

    def __init__(self, path: str, pattern: str | None = None):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters, vocabulary = byte_letters(), self.tokenizer.get_vocab()
        self.by_pieces = byte_level(path) and vocabulary.keys() >= set(letters.values()) and not any(re.search(r"\s|^$", t) for t in self.added)
        if not self.by_pieces:
            return
        self.model = Tokenizer(self.tokenizer.model)  # of pre-tokens in byte letters, a zero between two
        self.model.pre_tokenizer = pre_tokenizers.Split("\0", "removed")
        self.letters = np.array([0, *(ord(letters[b]) for b in range(1, 256))], "<u4")
        self.begins = np.zeros(1 + max(vocabulary.values()), bool)  # whether a token begins a piece
        self.begins[[i for t, i in vocabulary.items() if t[0] in (letters[0x20], letters[0x0A])]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.known_ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))

    def ids_of(self, text: str) -> list[int]:
        """The ids of a text by a plain call of the library."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        """``ids_of`` as little-endian 32-bit integers."""
        return np.array(self.ids_of(text), "<i4").tobytes()

    def joined(self, pieces: pa.Array) -> bytes:
        """The pieces as in a text: a line feed is before its piece already, before any other comes a space."""
        one_list = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
        return (b" " + pc.binary_join(one_list, " ")[0].as_buffer().to_pybytes()).replace(b" \n", b"\n")

    def called(self, pieces: pa.Array, plain: bool) -> pa.Array:
        """The ids of each of some pieces by one call of the library."""
        text = self.joined(pieces)
        if plain:
            for cut, by in ((b" ", b"\0 "), (b".", b"\0."), (b",", b"\0,"), (b"\n", b"\0\n\0")):
                text = text.replace(cut, by)
            told = self.model.encode_batch_fast([self.letters[np.frombuffer(text, np.uint8)].tobytes().decode("utf-32-le")], add_special_tokens=False)
        else:
            told = self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)
        ids = np.array(told[0].ids, np.int32)
        begins = np.flatnonzero(self.begins[ids])
        if len(begins) != len(pieces):
            raise ValueError(f"{len(pieces)} pieces gave the tokens of {len(begins)}")
        return pa.ListArray.from_arrays(pa.array(np.append(begins, len(ids)).astype(np.int32)), pa.array(ids))

    def encoded(self, pieces: pa.Array) -> pa.Array:
        """The ids of each of some distinct pieces, as a list."""
        odd = pc.match_substring_regex(pieces, rf"^\n?$|^\n{SPACE}")
        plain = pc.match_substring_regex(pieces, rf"^\n?{LETTER}+[.,]?$")
        kinds = pc.if_else(odd, 2, pc.if_else(plain, 0, 1)).to_numpy(zero_copy_only=False)
        order, out = [], [pa.array([], pa.list_(pa.int32()))]
        for kind in (0, 1):
            at = np.flatnonzero(kinds == kind)
            of_kind = pieces.take(pa.array(at))
            calls = np.cumsum(pc.binary_length(of_kind).to_numpy(), dtype=np.int64) // CALL_BYTES
            cuts = [0, *np.flatnonzero(np.diff(calls)) + 1, len(at)] if len(at) else []
            order.append(at)
            out += [self.called(of_kind.slice(a, b - a), kind == 0) for a, b in pairwise(cuts)]
        at = np.flatnonzero(kinds == 2)  # nothing, or a line feed and what begins a text with white space or is nothing
        order.append(at)
        out.append(pa.array([self.ids_of("\n") + self.ids_of(p[1:]) if p else [] for p in pieces.take(pa.array(at)).to_pylist()], pa.list_(pa.int32())))
        return pa.concat_arrays(out).take(pa.array(np.argsort(np.concatenate(order))))

    def looked_up(self, pieces: pa.Array) -> pa.Array:
        """``encoded``, but what earlier batches had is kept, up to CACHE_BYTES; beyond, the last batch's alone."""
        places = pc.index_in(pieces, self.known)
        new = pieces.filter(pc.is_null(places))
        ids = self.encoded(new)
        found = places.fill_null(-1).to_numpy()
        from_new = found < 0
        at = np.where(from_new, len(self.known) + np.cumsum(from_new) - 1, found)
        self.known, self.known_ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.known_ids, ids])
        out = self.known_ids.take(pa.array(at))
        if self.known.nbytes + self.known_ids.nbytes > CACHE_BYTES:
            self.forget()
            if pieces.nbytes + out.nbytes <= CACHE_BYTES:
                self.known, self.known_ids = pieces, out
        return out

    def batch(self, texts: pa.Array, end_id: int) -> pa.Array:
        """The ids of each text and the end id, as a list."""
        texts = texts.cast(pa.string()).fill_null("")
        if not self.by_pieces:
            return pa.array([[*self.ids_of(t), end_id] for t in texts.to_pylist()], pa.list_(pa.int32()))
        odd = pc.match_substring_regex(texts, rf"{SPACE}{SPACE}|^\n|{SPACE}$")
        for t in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, t))
        odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        # A line feed goes before each text, so that first pieces are those of a line; its id gives way to the end id of the text before.
        split = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\n", pc.if_else(odd, "", texts), ""), "\n", " \n"), " ")
        pieces = split.flatten().dictionary_encode()
        ids = self.looked_up(pieces.dictionary)
        sizes = np.diff(ids.offsets.to_numpy())[pieces.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        values = np.append(ids.take(pieces.indices).flatten().to_numpy(), np.int32(end_id))
        values[ends[:-1]] = end_id
        out = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[1:]))
        if len(odd_at):
            wholes = pa.array([[*self.ids_of(t), end_id] for t in texts.take(pa.array(odd_at)).to_pylist()], pa.list_(pa.int32()))
            order = np.arange(len(texts))
            order[odd_at] = len(texts) + np.arange(len(odd_at))
            out = pa.concat_arrays([out, wholes]).take(pa.array(order))
        return out

    def text(self, text: str | None) -> bytes:
        """The ids of one text as little-endian 32-bit integers."""
        return self.batch(pa.array([text], pa.string()), 0).flatten().to_numpy()[:-1].astype("<i4").tobytes()


def byte_level(path: str) -> bool:
    """Whether a tokenizer file has a byte-level BPE whose ids don't depend on what is around a piece."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    cut, model = told["pre_tokenizer"] or {}, told["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    whole = not any(told.get(k) for k in ("normalizer", "truncation", "padding", "post_processor"))
    return plain and whole and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process, whose caches outlive the task."""
    held = sys.__dict__.setdefault("_skein_encoders", {})
    if path not in held:
        held[path] = Encoder(path, pattern)
    return held[path]


def tokenizer_files() -> tuple[str, str]:
    """Path and pre-token pattern of the default vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def part_count(docs: DataFrame) -> int:
    """Parts for all texts: the session's number of shuffle partitions, or more if parts would be larger than PART_BYTES by
    the planner's figure, which for stored documents is the size of their files."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-size // PART_BYTES)))


def dealt_by_range(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` in ``parts`` ascending ranges of doc_id, sorted within.  The bounds come from quantiles of the ids alone, so
    that the texts are read once, or for very many parts from Spark's own sample; equal ids share a part, and null ids are in
    the first."""
    by_quantiles = 1 < parts <= QUANTILES
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(100 * parts)).alias("c")).first().c if by_quantiles else None
    bounds = sorted({float(c) for c in cuts or []})
    if len(bounds) < 2:
        return docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    marked = docs.withColumn("id_", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    marked = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="id_", outputCol="range_", handleInvalid="keep").transform(marked)
    return marked.repartitionById(len(bounds) + 1, F.col("range_").cast("int")).sortWithinPartitions("doc_id", "text").select("doc_id", "text")


def sized(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of BATCH_BYTES, about: small ones are joined, as pieces come again in them, large ones are cut."""
    held, size = [], 0
    for batch in batches:
        for rows in slices([batch], max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))):
            held, size = [*held, rows], size + rows.nbytes
            if size >= BATCH_BYTES // 2:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encoded(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str, end_id: int, parts: int | None) -> DataFrame:
    """Rows of SCHEMA in ascending doc_id order, part after part; equal ids in the order of their texts."""
    ordered = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ordered = dealt_by_range(ordered, parts or part_count(ordered))

    def run(batches):
        tool, part, at = encoder(vocabulary, pattern), TaskContext.get().partitionId(), 0
        for rows in sized(batches):
            tokens = tool.batch(rows.column("text"), end_id)
            offsets = tokens.offsets.to_numpy().astype(np.int64)
            sizes, places = np.diff(offsets), at + offsets[:-1] - offsets[0]
            out = pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.full(len(tokens), part, np.int32)), pa.array(places), pa.array(sizes), tokens], names=["doc_id", "part", "place", "n_tokens", "tokens"])
            yield from slices([out], 512)
            at += int(sizes.sum())

    return ordered.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, end_id: int = 0, parts: int | None = None, stripe_bytes: int = 64 << 20, index_stride: int = 1000) -> None:
    """Encode every whole text and write ORC files, ids ascending over the files in the order of ``part``.

    Strings of special tokens in a text become those tokens, as the library does without further settings.  A null text is
    empty and holds the end id alone; rows with a null doc_id come first, as null sorts; rows with equal ids are all written,
    in the order of their texts; texts of any length are encoded whole; an empty table gives files without rows; other
    columns may have any names.  ORC keeps the ids as run-length encoded integers, an index entry with minima and
    maxima for every ``index_stride`` rows, and a Bloom filter of doc_id beside it.
    """
    default = tokenizer_files() if vocabulary is None or pattern is None else (None, None)
    rows = encoded(docs, id_col, text_col, vocabulary or default[0], pattern or default[1], end_id, parts)
    (
        rows.write.option("compression", "zstd").option("orc.create.index", "true").option("orc.row.index.stride", index_stride)
        .option("orc.stripe.size", stripe_bytes).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows as written; Spark reads stripe by stripe in parallel, and a filter on doc_id prunes by index and Bloom filter."""
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The token ids of some documents, with the filter pushed down to stripes and row groups."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "tokens")


def part_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): ids in all parts before it.  One row per part goes through the window, not one per document."""
    sizes = read(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 of each document."""

    def checks(batches):
        for batch in batches:
            tokens = batch.column("tokens")
            values, offsets = tokens.values.to_numpy().astype("<i4", copy=False), tokens.offsets.to_numpy()
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "place", "n_tokens")), pa.array(crcs, pa.int64())], names=["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    rows = read(spark, path).mapInArrow(checks, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    return rows.join(part_offsets(spark, path), "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to a new path in the shared folder and return what the files hold, one row per document."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write(docs, path, **options)
    return index_of(spark, path)

"""Line deduplication by deletion neighbourhoods over words.

Two lines are near copies if one word edit (replace, insert or drop) turns one into the other; then they share a variant
with one word deleted.  Exact copies are summed up first.  As most lines have no near copy, a lossless filter comes before
the variants: of two halves of a line, one edit leaves one untouched, so a line sends a kind of variant only if another
line, of the length that this kind finds, shares a half with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import dropped, raw, spread_join, stored
from skein.operators.ranges import placed

#: A line must have as many words for one edit to leave it 0.8 similar; shorter lines match exact copies only.
MIN_WORDS = 5
LINES = "key binary, doc_id long, line_no int, n_words int, head long, tail long, head_less long, tail_less long"
TEXTS = "doc_id long, line_no int, same boolean, longer boolean, shorter boolean, line binary"
VARIANTS = "variant binary, less boolean, own boolean, doc_id long, line_no int"
#: Modulus, base and step of the variants' hashes, which are polynomials over the words' hashes.
MODULUS, BASE, STEP = (1 << 127) - 1, 0x5A17C9F3E2B84D6190D3A7B5C1E8F427, 0x3C6EF372FE94F82BA54FF53A5F1D36F1
#: Rows that a worker gathers before it sends them on.
HELD = 50_000


def table_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    """A batch of ``rows`` with the names and types of ``ddl``."""
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def half_keys(words: list[bytes], length: int) -> tuple[int, int]:
    """Hashes of first half and second half that a line of ``length`` words would have if it agreed with ``words`` there:
    its first half from the front of ``words``, its second half from their end."""
    front = length // 2
    hashed = lambda tag, part: signed(xxhash.xxh64_intdigest(b"%s%d " % (tag, length) + b" ".join(part)))
    return hashed(b"H", words[:front]), hashed(b"T", words[len(words) - (length - front) :])


def line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of LINES for each line with words."""
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
            for i, line in enumerate(text.split(b"\n")):
                if words := line.split():
                    rows.append((xxhash.xxh3_128_digest(b" ".join(words)), doc, i, len(words), *half_keys(words, len(words)), *half_keys(words, len(words) - 1)))
                    if len(rows) >= HELD:
                        yield table_of(rows, LINES)
                        rows = []
        if rows:
            yield table_of(rows, LINES)


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of TEXTS for the wanted lines of documents: rows (doc_id, text, wanted (line_no, same, longer, shorter))."""
    for batch in batches:
        rows = []
        for doc, text, wanted in zip(batch.column(0).to_pylist(), raw(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            lines = text.split(b"\n")
            for w in wanted:
                if w["line_no"] < len(lines):
                    rows.append((doc, w["line_no"], w["same"], w["longer"], w["shorter"], b" ".join(lines[w["line_no"]].split())))
        yield table_of(rows, TEXTS)


def deletions(words: list[bytes]) -> tuple[int, Iterator[int]]:
    """Hash of the words, and those of the words without each one of them in turn: linear in the number of words."""
    values = [xxhash.xxh64_intdigest(w) + 1 for w in words]
    after, powers = [0], [1]  # hashes of the ends of the words, shortest first, and powers of the base
    for v in reversed(values):
        after.append((v * powers[-1] + after[-1]) % MODULUS)
        powers.append(powers[-1] * BASE % MODULUS)

    def each() -> Iterator[int]:
        before, n = 0, len(values)
        for p, v in enumerate(values):
            yield (before * powers[n - 1 - p] + after[n - 1 - p]) % MODULUS
            before = (before * BASE + v) % MODULUS

    return after[-1], each()


def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of VARIANTS.  The line less a word, the place hashed in, meets lines with another word there (neither flag); the
    line less a word (``less``) meets the line without it (``own``)."""
    as_bytes = lambda h: h.to_bytes(16, "little")
    for batch in batches:
        rows = []
        for doc, i, same, longer, shorter, line in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            whole, without = deletions(line.split())
            if longer:
                rows.append((as_bytes(whole), False, True, doc, i))
            if same or shorter:
                last = None
                for p, h in enumerate(without):
                    if same:
                        rows.append((as_bytes((h + (p + 1) * STEP) % MODULUS), False, False, doc, i))
                    if shorter and h != last:  # equal neighbours leave the same rest
                        rows.append((as_bytes(h), True, False, doc, i))
                    last = h
                    if len(rows) >= HELD:
                        yield table_of(rows, VARIANTS)
                        rows = []
        yield table_of(rows, VARIANTS)


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the word edit distance is 1 or 0."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (at, earlier) whose lines are within one edit."""
    for batch in batches:
        near = [one_edit(a.split(), b.split()) for a, b in zip(batch.column("line").to_pylist(), batch.column("other_line").to_pylist(), strict=True)]
        yield batch.filter(pa.array(near, pa.bool_())).select(["at", "earlier"])


def likely_lines(distinct: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, line_no, same, longer, shorter): distinct lines that share a half with another line of their length, of one
    word more, or of one word less, where the longer of the two has ``min_words`` or more."""
    halves = lambda names, less: [F.struct(F.col(n).alias("half"), F.lit(less).alias("less")) for n in names]
    own, shorter = halves(("head", "tail"), False), halves(("head_less", "tail_less"), True)
    long_enough = F.col("n_words") >= min_words
    wide = distinct.where(F.col("n_words") >= min_words - 1).select("first.doc_id", "first.line_no", long_enough.alias("long"), F.explode(F.when(long_enough, F.array(*own, *shorter)).otherwise(F.array(*own))).alias("h"))
    wide = wide.select("doc_id", "line_no", "long", "h.half", "h.less")
    met = wide.groupBy("half").agg(F.count_if(~F.col("less")).alias("n_own"), F.count_if("less").alias("n_less"), F.count("*").alias("n_")).where("n_own > 1 or n_own = 1 and n_less > 0")
    met = stored(met, "shared_halves")
    told = spread_join(wide, met.drop("n_"), "half", counts=met.select("half", "n_"), total=4 * distinct.count(), hint="merge").groupBy("doc_id", "line_no").agg(
        F.bool_or(~F.col("less") & F.col("long") & (F.col("n_own") > 1)).alias("same"), F.bool_or(~F.col("less") & (F.col("n_less") > 0)).alias("longer"), F.bool_or("less").alias("shorter"),
    )
    return told.where("same or longer or shorter")


def near_lines(named: DataFrame, distinct: DataFrame, min_words: int) -> DataFrame:
    """(first, earlier): the place of a distinct line and the earliest place of a line within one edit of it, if earlier.

    A variant meets in a grouped minimum, combined before the shuffle, so that the lines of a frequent one are never paired.
    """
    likely = stored(likely_lines(distinct, min_words), "likely_lines")
    wanted = likely.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "same", "longer", "shorter")).alias("wanted"))  # a document's lines, beside its text
    texts = stored(named.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "wanted").mapInArrow(texts_of, TEXTS), "line_texts")
    place = F.struct("doc_id", "line_no")
    sent = stored(texts.mapInArrow(variants, VARIANTS), "variants").select("variant", "less", "own", place.alias("at"))
    best = sent.groupBy("variant").agg(F.min(F.when(~F.col("less"), F.col("at"))).alias("least"), F.min(F.when(F.col("less"), F.col("at"))).alias("least_less"), F.count("*").alias("n_")).where("n_ > 1")
    best = stored(best, "shared_variants")
    met = spread_join(sent, best.drop("n_"), "variant", counts=best.select("variant", "n_"), hint="merge").select("at", F.when(F.col("own"), F.col("least_less")).otherwise(F.col("least")).alias("earlier")).where("earlier < at")
    met = stored(met.groupBy("at").agg(F.min("earlier").alias("earlier")), "met_lines")
    lines = texts.select(place.alias("place"), "line").distinct()
    # one line may be the earlier one of very many
    times = met.groupBy("earlier").agg(F.count("*").alias("n_"))
    both = spread_join(met.join(lines.select(F.col("place").alias("at"), "line"), "at"), lines.select(F.col("place").alias("earlier"), F.col("line").alias("other_line")), "earlier", counts=times, total=met.count(), hint="merge")
    spot = "struct<doc_id:long,line_no:int>"
    near = stored(both.select("at", "earlier", "line", "other_line").mapInArrow(verified, f"at {spot}, earlier {spot}").select(F.col("at").alias("first"), "earlier").distinct(), "near_lines")
    dropped(likely, texts, sent, best, met)
    return near


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Lines to drop, one row each: doc_id, line_no (from 0), n_words, near, earlier_doc_id, earlier_line_no.

    Lines are parts between line feeds, compared by their words between ASCII white space; lines without words are never
    dropped, so null and empty texts have none.  A line goes if an earlier line, by (doc_id, line_no), equals it, or is
    within one word edit where the longer of the two has ``min_words`` or more; the earliest such line is named, whether
    or not it is dropped itself.  Rows without doc_id are left alone, as nothing names their lines; rows that repeat a
    doc_id share its lines' places and their decisions here (``deduplicated`` tells rows apart).  Time and memory are linear in the length of a line, which may be
    the whole of a very long text.  An empty table gives no rows; other columns may have any names.
    """
    named = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    lines = stored(named.mapInArrow(line_rows, LINES), "lines")
    halves = ("head", "tail", "head_less", "tail_less")
    distinct = stored(lines.groupBy("key").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.max("n_words").alias("n_words"), *[F.max(h).alias(h) for h in halves], F.count("*").alias("copies")), "distinct_lines")
    near = near_lines(named, distinct, min_words)
    targets = stored(distinct.join(near, "first", "left").where("copies > 1 or earlier is not null").select("key", "first", "earlier", "copies"), "line_targets")
    dropped(distinct, near)
    gone = spread_join(lines.select("key", "doc_id", "line_no", "n_words"), targets.drop("copies"), "key", counts=targets.select("key", F.col("copies").alias("n_")), hint="merge").withColumn("own", F.struct("doc_id", "line_no")).where("own <> first or earlier is not null")
    target = F.coalesce(F.col("earlier"), F.col("first"))
    return gone.select("doc_id", "line_no", "n_words", F.col("earlier").isNotNull().alias("near"), target["doc_id"].alias("earlier_doc_id"), target["line_no"].alias("earlier_line_no"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, all their columns, with their duplicate lines taken out of the text.

    It is decided by row: rows that repeat a doc_id have lines of their own, the earlier text first, so that no line goes but for
    an equal or near one that is earlier and stays in its place.  Rows without doc_id are left alone; a text whose lines all go
    is empty, a null one stays null."""
    column = lambda c: F.col(f"`{c}`")
    packed = docs.select(F.struct(*[column(c) for c in docs.columns if c != text_col]).alias("doc"), column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    rows = placed(packed.where("doc_id is not null"), [F.col("doc_id"), F.col("text")]).withColumn("row", F.shiftleft("part_", 33) + F.col("place_"))
    gone = duplicates(rows.select("row", "text"), "row", "text", min_words).groupBy(F.col("doc_id").alias("row")).agg(F.collect_set("line_no").alias("lines"))
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(line.alias("line"), i.alias("i"))), lambda x: ~F.array_contains("lines", x["i"]))
    text = F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    told = rows.join(gone, "row", "left").select("doc", text.alias("text")).unionByName(packed.where("doc_id is null").select("doc", "text"))
    return told.select(*[F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns])

"""Byte-level BPE as a monoid: halves of a text are encoded apart and joined, up a tree; decoding concatenates up a tree.

Two facts make a join provable.

*Cuts.*  The pre-token pattern always begins a match where a letter is followed by something else: whatever comes before, no
match goes on over such a place, a match looks at most one character past its end (a contraction at three characters from its
start, none of them past such a place), and matches from there on depend on the text from there on.  So ids left of the last
such cut of the left half, and right of the first one of the right half, are those of the whole; only the window between is
encoded anew.  It grows, character by character, until it finds its two cuts or has taken the whole half.

*Pairs.*  Within one match (a run of letters without a cut may be long) a sequence of tokens is the encoding of its bytes if,
and only if, each two neighbours are the encoding of theirs: the first merge over a border would also be the first one when
these two tokens are encoded alone, since merges are chosen by rank and place and those on either side don't see the others.
So the window takes more tokens on either side until its outer tokens and their neighbours are such pairs.

Spark deals the texts; texts of more than ``segment`` characters are cut into segments that are encoded in tasks of their own,
and only their joins and the ordered digest go through one task, a segment at a time.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a leaf of the tree, of a segment that one task encodes, and of a window that is encoded as a whole.
LEAF, SEGMENT, WINDOW = 4096, 1 << 18, 4096
#: Ids that are decoded at once.
DECODED = 1 << 14
NO_IDS = np.zeros(0, np.int32)


class Vocabulary:
    """Ranks of byte strings and what joins need of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of = [b""] * (1 + max(ranks.values()))
        for text, rank in ranks.items():
            self.bytes_of[rank] = text
        self.size = np.array([len(x) for x in self.bytes_of], np.int64)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known_sound: bool | None = None

    def leaf(self, text: str) -> np.ndarray:
        return np.array(self.plain(text), np.int32)

    def merged(self, data: bytes) -> list[int]:
        """The ids of a short byte string by merges alone: the lowest rank first, of equal ones the leftmost."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            found = [(rank, i) for i in range(len(parts) - 1) if (rank := ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[x] for x in parts]

    def sound(self) -> bool:
        """Whether merges reach every token.  Where they don't, the library's answer for a match that is itself a token isn't
        that of merges, and matches are encoded as a whole."""
        if self.known_sound is None:
            self.known_sound = all(self.merged(x) == [rank] for x, rank in self.ranks.items())
        return self.known_sound

    def fit(self, left: int, right: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        if (left, right) not in self.pairs:
            if len(self.pairs) > 1 << 20:
                self.pairs.clear()
            self.pairs[left, right] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return self.pairs[left, right]

    def tokens_before(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many tokens stand before the last ``n_bytes`` bytes."""
        k = 64
        while True:
            sums = np.cumsum(self.size[ids[-k:]][::-1])
            if k >= len(ids) or sums[-1] >= n_bytes:
                return len(ids) - int(np.searchsorted(sums, n_bytes, "left")) - (n_bytes > 0)
            k *= 4

    def tokens_within(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many tokens the first ``n_bytes`` bytes have."""
        k = 64
        while True:
            sums = np.cumsum(self.size[ids[:k]])
            if k >= len(ids) or sums[-1] >= n_bytes:
                return int(np.searchsorted(sums, n_bytes, "left")) + (n_bytes > 0)
            k *= 4


def byte_count(text: str) -> int:
    return len(text.encode())


def cut_before(text: str, low: int, high: int) -> int:
    """The last cut in ``text[low:high]``, or ``low``."""
    for i in range(high - 1, low, -1):
        if text[i - 1].isalpha() and not text[i].isalpha():
            return i
    return low


def cut_after(text: str, low: int, high: int) -> int:
    """The first cut in ``text[low:high]``, or ``high``."""
    for i in range(low + 1, high):
        if text[i - 1].isalpha() and not text[i].isalpha():
            return i
    return high


def joined_pairs(tool: Vocabulary, left: list[int], right: list[int]) -> list[int] | None:
    """The ids of two neighbouring byte strings together, from those of each; None if the window gets too large."""
    if not left or not right:
        return left or right
    i = j = 1
    while True:
        data = b"".join(tool.bytes_of[x] for x in (*left[-i:], *right[:j]))
        if len(data) > WINDOW:
            return None
        window = tool.merged(data)
        fits_left = i == len(left) or tool.fit(left[-i - 1], window[0])
        fits_right = j == len(right) or tool.fit(window[-1], right[j])
        if fits_left and fits_right:
            return left[:-i] + window + right[j:]
        i, j = i if fits_left else min(2 * i, len(left)), j if fits_right else min(2 * j, len(right))


def over_seam(tool: Vocabulary, text: str, low: int, begin: int, seam: int, end: int, high: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ids of the match ``text[begin:end]`` that lies over the seam, from those of the halves ``text[low:seam]`` and
    ``text[seam:high]``, as far as the last match of the left and the first one of the right half are parts of it."""
    last = low + max((m.start() for m in tool.pattern.finditer(text[low:seam])), default=0)
    first = seam + tool.pattern.match(text[seam:high]).end()
    parts: list[list[int]] = []
    if begin <= last:
        parts += [text[begin:last], left[tool.tokens_before(left, byte_count(text[last:seam])) :].tolist()]
    else:
        parts += [text[begin:seam]]
    if first <= end:
        parts += [right[: tool.tokens_within(right, byte_count(text[seam:first]))].tolist(), text[first:end]]
    else:
        parts += [text[seam:end]]
    if not tool.sound() or any(isinstance(x, str) and len(x) > 64 for x in parts):
        return tool.leaf(text[begin:end])
    out: list[int] | None = []
    for x in parts:
        out = joined_pairs(tool, out, tool.merged(x.encode()) if isinstance(x, str) else x)
        if out is None:
            return tool.leaf(text[begin:end])
    return np.array(out, np.int32)


def joined(tool: Vocabulary, text: str, low: int, seam: int, high: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ids of ``text[low:high]`` from those of its halves."""
    begin, end = cut_before(text, low, seam), cut_after(text, seam, high)
    if end - begin <= WINDOW:
        window = tool.leaf(text[begin:end])
    else:
        spans = ((begin + m.start(), begin + m.end()) for m in tool.pattern.finditer(text[begin:end]))
        window = np.concatenate([over_seam(tool, text, begin, a, seam, b, end, left, right) if a < seam < b and b - a > LEAF else tool.leaf(text[a:b]) for a, b in spans])
    kept_left = left[: tool.tokens_before(left, byte_count(text[begin:seam]))]
    kept_right = right[tool.tokens_within(right, byte_count(text[seam:end])) :]
    return np.concatenate([kept_left, window, kept_right])


def encode(tool: Vocabulary, text: str, low: int = 0, high: int | None = None, leaf: int = LEAF) -> np.ndarray:
    """The ids of ``text[low:high]``: those of its halves, joined."""
    high = len(text) if high is None else high
    if high - low <= leaf:
        return tool.leaf(text[low:high])
    seam = (low + high) // 2
    return joined(tool, text, low, seam, high, encode(tool, text, low, seam, leaf), encode(tool, text, seam, high, leaf))


def decode(tool: Vocabulary, ids: np.ndarray) -> bytes:
    """The bytes of ``ids``: those of the halves, one after the other."""
    if len(ids) <= DECODED:
        return b"".join(map(tool.bytes_of.__getitem__, ids.tolist()))
    middle = len(ids) // 2
    return decode(tool, ids[:middle]) + decode(tool, ids[middle:])


def in_order(tool: Vocabulary, segments: Iterable[tuple[str, np.ndarray]]) -> Iterator[np.ndarray]:
    """The ids of a text, part by part, from its segments with theirs: what lies before the last cut is handed on, so that one
    segment, or what has no cut, stays in memory."""
    text, ids = "", NO_IDS
    for more, found in segments:
        seam = len(text)
        text += more
        ids = joined(tool, text, 0, seam, len(text), ids, found) if seam and more else np.concatenate([ids, found])
        cut = cut_before(text, 0, len(text))
        n = tool.tokens_before(ids, byte_count(text[cut:]))
        if n:
            yield ids[:n]
        text, ids = text[cut:], ids[n:]
    yield ids


def vocabulary_file() -> tuple[str, str]:
    """Path and pattern of the default vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary for each worker process."""
    held = sys.__dict__.setdefault("_skein_vocabularies", {})
    if (path, pattern) not in held:
        with open(path, "rb") as file:
            held[path, pattern] = Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, pattern)
    return held[path, pattern]


ENCODED = "doc_id long, row string, part int, last boolean, tokens array<int>"
Row = tuple[int | None, str | None, int, bool, np.ndarray]


def lists(rows: list[Row]) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(r[4]) for r in rows)]).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[4] for r in rows]), pa.int32()))
    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows])]
    return pa.RecordBatch.from_arrays([*columns, tokens], names=["doc_id", "row", "part", "last", "tokens"])


def digest_of(tool: Vocabulary, rows: Iterable[Row]) -> Iterator[tuple]:
    """(doc_id, row, n_tokens, ids_sha256, decoded_sha256) of rows in order: those of a text follow one another."""
    n, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
    for doc_id, row, _, last, ids in rows:
        n += len(ids)
        ids_hash.update(ids.astype("<u4").tobytes())
        bytes_hash.update(decode(tool, ids))
        if last:
            yield doc_id, row, n, ids_hash.hexdigest(), bytes_hash.hexdigest()
            n, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()


DIGESTS = "doc_id long, row string, n_tokens long, ids_sha256 string, decoded_sha256 string"


def told(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["doc_id", "row", "n_tokens", "ids_sha256", "decoded_sha256"])


def chunked(rows: Iterable, pack: Callable[[list], pa.RecordBatch], size: Callable[[tuple], int], room: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, used = [], 0
    for row in rows:
        held.append(row)
        used += size(row) + 16
        if used >= room:
            yield pack(held)
            held, used = [], 0
    if held:
        yield pack(held)


def each(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of batches; few at a time are Python objects."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 64):
            yield from zip(*(batch.column(c).slice(begin, 64).to_pylist() for c in names), strict=True)


def over_texts(docs: DataFrame, id_col: str, text_col: str, files: tuple[str, str], segment: int, leaf: int, finish: Callable, schema: str) -> DataFrame:
    """What ``finish`` makes, in tasks, of each text's ids; texts within ``segment`` characters need no shuffle."""
    path, pattern = files
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def whole(batches):
        tool = vocabulary(path, pattern)
        yield from finish(tool, ((doc_id, None, 0, True, encode(tool, text, leaf=leaf)) for doc_id, text in each(batches, "doc_id", "text")))

    def cut(batches):
        for doc_id, row, copies, text in each(batches, "doc_id", "row", "copies", "text"):
            for i in range(0, len(text), segment):
                yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "row": row, "copies": copies, "part": i // segment, "text": text[i : i + segment]}], cut_schema)

    def halves(batches):
        tool = vocabulary(path, pattern)
        for doc_id, row, copies, part, text in each(batches, "doc_id", "row", "copies", "part", "text"):
            yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "row": row, "copies": copies, "part": part, "text": text, "tokens": encode(tool, text, leaf=leaf)}], half_schema)

    def put_together(batches):
        tool = vocabulary(path, pattern)
        found = each(batches, "doc_id", "row", "copies", "part", "text", "tokens")

        def ids():
            now = next(found, None)
            while now is not None:
                doc_id, row = now[:2]

                def segments():
                    nonlocal now
                    while now is not None and now[:2] == (doc_id, row):
                        yield now[4], np.array(now[5], np.int32)
                        now = next(found, None)

                for i, part in enumerate(in_order(tool, segments())):
                    yield doc_id, row, i, False, part
                yield doc_id, row, -1, True, NO_IDS

        yield from finish(tool, ids())

    cut_schema = pa.schema([("doc_id", pa.int64()), ("row", pa.string()), ("copies", pa.int64()), ("part", pa.int32()), ("text", pa.string())])
    half_schema = cut_schema.append(pa.field("tokens", pa.list_(pa.int32())))
    short, long = rows.where(F.length("text") <= segment), rows.where(F.length("text") > segment)
    once = long.groupBy("doc_id", F.sha2("text", 256).alias("row")).agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
    parts = once.mapInArrow(cut, "doc_id long, row string, copies long, part int, text string").repartition("row", "part")
    parts = parts.mapInArrow(halves, "doc_id long, row string, copies long, part int, text string, tokens array<int>")
    long_ones = parts.repartition("doc_id", "row").sortWithinPartitions("doc_id", "row", "part").mapInArrow(put_together, schema)
    again = once.where("copies > 1").select("doc_id", "row", F.explode(F.expr("sequence(2, copies)")).alias("copy"))
    repeated = again.withColumnRenamed("doc_id", "id_").join(long_ones, F.col("id_").eqNullSafe(F.col("doc_id")) & (again.row == long_ones.row)).select(long_ones["*"])
    return short.mapInArrow(whole, schema).unionByName(long_ones).unionByName(repeated)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: tuple[str, str] | None = None, segment: int = SEGMENT, leaf: int = LEAF) -> DataFrame:
    """(doc_id, row, part, last, tokens) for every whole text, each match of the pattern encoded by the vocabulary's ranks.

    A text within ``segment`` characters has one row, with ``last`` true; a longer one has the digest of its text as ``row``, and
    its ids in rows by ascending ``part``, then an empty one with ``last``.  A null text is empty and has no ids; ids may be
    null or repeated, repeated rows are all encoded; an empty table gives no rows; other columns may have any names.
    """
    return over_texts(docs, id_col, text_col, files or vocabulary_file(), segment, leaf, lambda tool, rows: chunked(rows, lists, lambda r: 4 * len(r[4])), ENCODED)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: tuple[str, str] | None = None, segment: int = SEGMENT, leaf: int = LEAF) -> DataFrame:
    """Encode every whole text and decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256.  Rows as in ``encoded``."""
    rows = over_texts(docs, id_col, text_col, files or vocabulary_file(), segment, leaf, lambda tool, found: chunked(digest_of(tool, found), told, lambda r: 200), DIGESTS)
    return rows.drop("row")


def decoded(tokens: DataFrame, tokens_col: str = "tokens", files: tuple[str, str] | None = None) -> DataFrame:
    """``tokens`` with a binary column ``bytes``: what the ids of each row stand for.  Null ids have null bytes."""
    path, pattern = files or vocabulary_file()

    @F.pandas_udf("binary")
    def back(column):
        tool = vocabulary(path, pattern)
        return column.map(lambda ids: None if ids is None else decode(tool, np.asarray(ids, np.int64)))

    return tokens.withColumn("bytes", back(F.col(f"`{tokens_col}`")))

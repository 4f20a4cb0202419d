"""WARC archives: a deduplicating writer and a salvage reader.

Records are written through Spark's text writer, whose line separator is the blank lines that end a record: archives
reach any store Spark can write, through its commit protocol.  The reader takes archives whole, plain or compressed
member by member; after a failed check it looks for the next valid record and logs the bytes in between.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import raw, scratch, spread_join, stored

END = b"\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records, and bytes of payload, of one archive, at most (or one record); the reader holds one archive at a time.
RECORDS_PER_FILE, ARCHIVE_BYTES = 4000, 128 << 20
SCHEMA = "file string, kind string, at long, size long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, reason string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record without the two line ends that close it.  A revisit keeps length and digest of the full payload in its head."""
    block = HTTP_HEAD + (payload if refers_to is None else b"")
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}", f"X-Payload-Length: {len(payload)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block


def originals(pages: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(sha1, original, n) of payloads that several rows share: the largest page_id.  Only digests and ids are shuffled, summed up beforehand."""
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    keyed = pages.where(F.octet_length(html) >= min_bytes).select(F.sha1(html.cast("binary")).alias("sha1"), F.col(id_col).cast("long").alias("page"))
    return keyed.groupBy("sha1").agg(F.max("page").alias("original"), F.count("*").alias("n")).where("n > 1").select("sha1", "original", "n")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row.

    A null html is an empty payload.  Of rows with equal payloads of at least ``min_bytes`` bytes, that with the largest
    page_id is the response and the others revisit it (rows that repeat that page_id are responses too; rows without a
    page_id revisit it, and are responses where no equal row has one); shorter payloads are all responses.  A null url
    has no target line.  A record is named by its page_id, so rows that repeat one share their record's name.  Archives have
    at most ``records_per_file`` records and ``archive_bytes`` of payload: pages are written by classes of length, each four
    times that of the one before, and a class has as many records in an archive as its longest pages allow, so that a long
    page has no say in the archives of short ones.  A page beyond ``archive_bytes`` has an archive of its own.  An empty table
    gives no records; other columns may have any names.
    """
    shared = stored(originals(pages, id_col, html_col, min_bytes), "originals")
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    # class k: pages of up to 4^k times the length at which as many as ``records_per_file`` fill an archive
    shortest = max(1, archive_bytes // max(1, records_per_file))
    bounds = [shortest * 4**k for k in range(17)]
    kind = F.coalesce(*[F.when(F.octet_length(html) <= bound, F.lit(k)) for k, bound in enumerate(bounds)], F.lit(len(bounds)))
    kinds = {r.kind: r.n for r in pages.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect()} or {0: 0}
    total = sum(kinds.values())
    sha1 = F.when(F.octet_length(html) >= min_bytes, F.sha1(html.cast("binary")))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{url_col}`").alias("url"), html.alias("html"), sha1.alias("sha1"), kind.alias("kind"))
    rows = spread_join(rows, shared.select("sha1", "original"), "sha1", "left", counts=shared.select("sha1", F.col("n").alias("n_")), total=total).select("kind", "page", "url", "html", F.when(F.col("page").isNull() | (F.col("page") != F.col("original")), F.col("original")).alias("refers_to"))

    def run(batches):
        for batch in batches:
            made = [record(i, u, p, r, date) for i, u, p, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()).cast(pa.string())], names=["value"])

    for k in sorted(kinds):
        records = max(1, min(records_per_file, archive_bytes // bounds[k])) if k < len(bounds) else 1
        some = rows.where(F.col("kind") == k).drop("kind").mapInArrow(run, "value string")
        some.write.mode("append").option("lineSep", END.decode()).option("maxRecordsPerFile", records).text(path)


def parsed(data: bytes, at: int) -> tuple[int, dict[str, str], bytes] | str:
    """The record at ``at`` of uncompressed ``data``: its end, head and block; or why there is none."""
    if not re.compile(rb"WARC/\d+\.\d+\r?\n").match(data, at):
        return "no version line"
    stop = data.find(END, at)
    if stop < 0:
        return "head without end"
    head = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return "bad head line"
        head[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        return "bad content length"
    begin = stop + len(END)
    end = begin + int(head["content-length"])
    if end > len(data):
        return "record is cut off"
    if data[end : end + len(END)] not in (END, b""):
        return "no blank lines after the block"
    block = data[begin:end]
    stated = head.get("warc-block-digest", "").removeprefix("sha1:")
    if stated and stated != digest(block):
        return "block digest differs"
    return min(end + len(END), len(data)), head, block


def member(data: bytes, at: int) -> tuple[int, list[tuple[dict[str, str], bytes] | str], str]:
    """The gzip member at ``at``: its end, its records and why bytes between them are none, and what is wrong with it.

    Of a damaged member, records that inflate before the damage count if they state a digest that holds.
    """
    tool, parts, end, wrong = zlib.decompressobj(31), [], at, ""
    try:
        while not tool.eof and end < len(data):
            step = 1 << 16
            parts.append(tool.decompress(data[end : end + step]))
            end = min(end + step, len(data))
    except zlib.error:
        wrong = "bad gzip member"
        parts += rest_of(data, at, sum(map(len, parts)))
    if not tool.eof and not wrong:
        wrong = "gzip member is cut off"
    plain, found, place, version = b"".join(parts), [], 0, re.compile(rb"WARC/\d+\.\d+\r?\n")
    while place < len(plain):
        one = parsed(plain, place)
        if not isinstance(one, str) and (not wrong or "warc-block-digest" in one[1]):
            found.append(one[1:])
            place = one[0]
            continue
        if not found or not isinstance(found[-1], str):
            found.append(one if isinstance(one, str) else wrong)
        following = version.search(plain, place + 1)
        place = following.start() if following else len(plain)
    return end - len(tool.unused_data), found or ["no version line"], wrong


def rest_of(data: bytes, at: int, done: int) -> list[bytes]:
    """What the damaged member at ``at`` inflates to after ``done`` bytes, fed in small steps up to the damage."""
    tool, parts, place = zlib.decompressobj(31), [], at
    try:
        while not tool.eof and place < len(data):
            parts.append(tool.decompress(data[place : place + 64]))
            place += 64
    except zlib.error:
        pass
    return [b"".join(parts)[done:]]


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    """Records (start, end, head, block, "") of an archive and quarantined gaps (start, end, None, b"", reason).

    All records of a gzip member are read, and have the member's place; of a damaged one, those before the damage have its
    start as start and end, and the member is a gap.  After a failed check the next place that starts a gzip member or a version line, and passes all checks, ends the gap.
    """
    start_mark = re.compile(rb"\x1f\x8b\x08|WARC/\d+\.\d+\r?\n")
    at, gap, why = 0, -1, ""
    while at < len(data):
        if data[at : at + 3] == b"\x1f\x8b\x08":
            end, inside, wrong = member(data, at)
            if any(not isinstance(x, str) for x in inside):
                if gap >= 0:
                    yield gap, at, None, b"", why
                    gap = -1
                for x in inside:
                    if not isinstance(x, str):
                        yield at, at if wrong else end, *x, ""
                    elif not wrong:
                        yield at, end, None, b"", x
                if not wrong:
                    at = end
                    continue
            found = wrong or inside[0]
        else:
            found = parsed(data, at)
        if isinstance(found, str):
            if gap < 0:
                gap, why = at, found
            following = start_mark.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap >= 0:
            yield gap, at, None, b"", why
            gap = -1
        yield at, found[0], found[1], found[2], ""
        at = found[0]
    if gap >= 0:
        yield gap, len(data), None, b"", why


def described(found: tuple, payloads: bool) -> dict:
    """The output row of a record or gap; a response whose payload digest differs becomes a gap."""
    start, end, head, block, why = found
    row = {"kind": "gap", "at": start, "size": end - start, "reason": why}
    if head is None:
        return row
    number = lambda text: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", text or "")) else None
    kind, stated = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:")
    payload = block.partition(END)[2] if head.get("content-type", "").startswith("application/http") else block
    if kind == "response" and stated and stated != digest(payload):
        return row | {"reason": "payload digest differs"}
    length = int(head["x-payload-length"]) if kind == "revisit" and head.get("x-payload-length", "").isdigit() else len(payload)
    return {
        "kind": "record", "at": start, "size": end - start, "page_id": number(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": kind, "payload_bytes": length,
        "payload_digest": stated or digest(payload), "refers_to": number(head.get("warc-refers-to")), "payload": payload if payloads else None,
    }


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records and quarantined gaps (``kind``) of the archives under ``path``, with file, place and size.

    ``payloads`` false leaves the payloads out.  An empty archive gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        names = [f.strip().split()[0] for f in SCHEMA.split(",")]
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in ("at", "size", "page_id", "payload_bytes", "refers_to") else pa.string()) for n in names])
        for batch in batches:
            for i in range(batch.num_rows):
                file, rows, held = batch.column(0)[i].as_py(), [], 0
                for found in salvage(batch.column(1)[i].as_py()):
                    rows.append({"file": file} | described(found, payloads))
                    held += len(found[3]) * payloads + 500
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, SCHEMA)


def sound(found: DataFrame) -> DataFrame:
    """The records of what ``read`` gives; a quarantined gap raises."""
    lost = F.raise_error(F.concat_ws(" ", F.lit("gap in"), "file", F.lit("at"), F.col("at").cast("string"), "reason"))
    return found.withColumn("kind", F.when(F.col("kind") == "record", F.col("kind")).otherwise(lost.cast("string"))).where("kind is not null")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the archives to a new path in the shared folder, read them back, one row per record: page_id, payload_bytes,
    payload_digest, record_type, refers_to.  A gap in an archive just written is an error."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path, **options)
    return sound(read(spark, path, payloads=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

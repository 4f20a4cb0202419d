"""Gzip members of several records, whole and damaged."""

import gzip
import random

from skein.llm import warc


def made(n):
    rng = random.Random(1)
    return [warc.record(i, f"http://x/{i}", rng.randbytes(3000), None, "2024-01-01T00:00:00Z") + warc.END for i in range(n)]


def ids(found):
    return [f[2]["warc-record-id"][12:-1] for f in found if f[2]]


def test_all_records_of_a_member():
    whole, one = gzip.compress(b"".join(made(5))), gzip.compress(made(1)[0])
    found = list(warc.salvage(whole + one))
    assert ids(found) == ["0", "1", "2", "3", "4", "0"]
    assert {(f[0], f[1]) for f in found[:5]} == {(0, len(whole))}
    junk = gzip.compress(made(1)[0] + b"junk" + made(2)[1])
    found = list(warc.salvage(junk))
    assert ids(found) == ["0", "1"]
    assert [f[:2] + f[4:] for f in found if not f[2]] == [(0, len(junk), "no version line")]


def test_records_before_the_damage():
    whole, one = gzip.compress(b"".join(made(5))), gzip.compress(made(1)[0])
    cut = whole[: len(whole) * 7 // 10]
    found = list(warc.salvage(cut))
    assert ids(found) == ["0", "1", "2"]
    assert [f[:2] + f[4:] for f in found if not f[2]] == [(0, len(cut), "gzip member is cut off")]
    assert ids(warc.salvage(cut + one))[:3] == ["0", "1", "2"]


def test_a_long_page_has_no_say_in_the_archives_of_short_ones(spark, tmp_path):
    rows = [(i, "http://x", "short") for i in range(400)] + [(400, "http://x", "y" * 50_000)]
    path = str(tmp_path / "archives")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, records_per_file=150, archive_bytes=50_000)
    sizes = sorted(len(f.read_bytes()) for f in (tmp_path / "archives").glob("part-*") if f.stat().st_size)
    assert len(sizes) == 4
    found = warc.read(spark, path).where("kind = 'record'") if "kind" in warc.SCHEMA else warc.read(spark, path)
    assert {r.page_id for r in found.select("page_id").collect()} == set(range(401))

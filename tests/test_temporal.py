"""Joins and frames in time, changes and ranks against plain loops, with hot keys over many buckets."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators import merge, ranges, temporal

BEGIN = datetime(2024, 1, 1)
AT = "timestamp_ntz"


def at(minutes):
    return None if minutes is None else BEGIN + timedelta(minutes=minutes)


def made(seed, n, span=4000):
    rng = random.Random(seed)
    rows = [(rng.choice((7, 7, 7, 1, 2)), rng.randrange(span), i) for i in range(n)]
    return rows + rows[: n // 10] + [(None, 5, n), (7, None, n + 1), (3, 9, n + 2)]


def frame(spark, rows, names="key long, at {at}, id long"):
    return spark.createDataFrame([(k, at(m), *more) for k, m, *more in rows], names.format(at=AT))


@pytest.mark.parametrize("width", (600, 86400))
def test_as_of_equals_a_loop(spark, width, monkeypatch):
    monkeypatch.setattr(ranges, "FAN", 5)
    left, right = made(1, 120), made(2, 60)
    got = temporal.as_of(frame(spark, left), frame(spark, right), "key", "at", "at", ["id"], width)

    def last(key, m):
        known = [(x, i) for k, x, i in right if None not in (k, x, key, m) and k == key and x <= m]
        return max(known, default=(None, None))

    want = [(k, at(m), i, k if last(k, m)[0] is not None else None, at(last(k, m)[0]), last(k, m)[1]) for k, m, i in left]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_one_shuffle_of_rows(spark):
    """Left rows are dealt once, by key and bucket: no exchange by key alone has them."""
    rows = frame(spark, made(1, 50))
    plan = temporal.as_of(rows, rows, "key", "at", "at", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key_" in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("width", (600, 86400))
def test_spans_equal_a_loop(spark, width, monkeypatch):
    monkeypatch.setattr(ranges, "FAN", 5)
    rows = made(3, 80, 900)
    got = temporal.spans(frame(spark, rows), "key", "at", ["id"], width, "until")
    last = {}
    for k, m, i in rows:
        if k is not None and m is not None:
            last[k, m] = max(i, last.get((k, m), -1))
    want = [(k, at(m), i, at(min((x for q, x in last if q == k and x > m), default=None))) for (k, m), i in last.items()]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("width", (60, 3600))
def test_overlaps_equal_all_pairs(spark, width):
    rng = random.Random(4)

    def spans(n, ids):
        out = []
        for i in range(n):
            begin = rng.randrange(4000)
            end = rng.choice((begin, begin + 1, begin + 90, begin + 5000, begin - 1, None))
            out.append((rng.choice((7, 7, 1, None)), begin, end, ids + i))
        return out

    left, right = spans(60, 0), [*spans(50, 100), (7, None, 5, 999)]
    table = lambda rows: spark.createDataFrame([(k, at(b), at(e), i) for k, b, e, i in rows], f"key long, low {AT}, high {AT}, id long")
    got = temporal.overlaps(table(left), table(right), "key", ("low", "high"), ("low", "high"), width)

    def common(a, b):
        (low, high), (low2, high2) = a, b
        if None in (low, low2) or (high is not None and high < low) or (high2 is not None and high2 < low2):
            return False
        high, high2 = (10**9 if x is None else x for x in (high, high2))
        first, second = (range(low, max(high, low + 1)) if high - low < 10**6 else range(low, 10**6) for low, high in ((low, high), (low2, high2)))
        return max(first[0], second[0]) <= min(first[-1], second[-1])

    want = sorted((l[3], r[3]) for l in left for r in right if l[0] is not None and l[0] == r[0] and common(l[1:3], r[1:3]))  # noqa: E741
    assert sorted((r.id, r.right_id) for r in got.collect()) == want


def test_moving_equals_a_loop(spark):
    rows = made(5, 150, 600)
    got = temporal.moving(frame(spark, rows), "key", "at", 1200, {"n": F.count("*"), "top": F.max("id")}, forth=300)
    want = []
    for k, m, i in rows:
        near = [j for q, x, j in rows if None not in (k, m, q, x) and q == k and m - 20 <= x <= m + 5]
        want.append((k, at(m), i, len(near) or None, max(near, default=None)))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_changes_equal_a_loop(spark):
    rng = random.Random(6)
    base = [(k, f"n{k}", rng.choice(("a", None))) for k in range(12)] + [(None, "lost", "a")]
    changes = [(rng.choice((7, 7, 7, *range(20))), rng.randrange(9), i, rng.choice("IUUDX"), rng.choice(("b", "c", None))) for i in range(90)]
    changes += changes[:9] + [(None, 1, 200, "U", "z"), (3, None, 201, "U", "z"), (3, 1, 202, None, "z")]
    frames = spark.createDataFrame(base, "key long, name string, v string"), spark.createDataFrame(changes, "key long, seq long, id long, op string, v string")
    got = merge.apply_changes(*frames, "key", ["seq", "id"], "op", {"v": "v"})
    state = {k: [n, v, "same"] for k, n, v in base}
    for k, _, _, op, v in sorted({c for c in changes if c[0] is not None and c[1] is not None and c[3] in ("I", "U", "D")}, key=lambda c: c[1:3]):
        known = k in {b[0] for b in base}
        was = state.setdefault(k, [None, None, "insert"])
        if op == "D":
            state[k] = [None, None, "delete"]
        else:
            state[k] = [was[0], v or was[1], "insert" if not known else "replace" if was[2] in ("delete", "replace") else "update"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, ((k, *s) for k, s in state.items())))


@pytest.mark.parametrize("tiles", (3, 7, 500))
def test_ranks_equal_a_loop(spark, tiles, monkeypatch):
    monkeypatch.setattr(ranges, "range_count", lambda rows: 9)
    monkeypatch.setattr(ranges, "FAN", 3)
    rng = random.Random(7)
    values = [rng.choice((5, 5, 5, None, rng.randrange(20))) for _ in range(100)]
    got = ranges.ranked(spark.createDataFrame(list(enumerate(values)), "id long, v long"), ["v"], ["id"], tiles).collect()
    order = sorted(range(100), key=lambda i: (values[i] is not None, values[i] or 0, i))
    size, more = divmod(100, tiles)
    edges = [k * size + min(k, more) for k in range(tiles + 1)]
    for n, i in enumerate(order):
        row = next(r for r in got if r.id == i)
        rank = next(j for j, x in enumerate(order) if values[x] == values[i]) + 1
        tile = next(k + 1 for k in range(tiles) if edges[k] <= n < edges[k + 1])
        assert (row.row_no, row.rank, row.percent_rank, row.tile) == (n + 1, rank, (rank - 1) / 99, tile)


def test_empty_tables(spark):
    none = frame(spark, [])
    some = frame(spark, made(1, 5))
    assert temporal.as_of(none, some, "key", "at", "at", ["id"]).collect() == []
    assert {r.right_id for r in temporal.as_of(some, none, "key", "at", "at", ["id"]).collect()} == {None}
    assert ranges.ranked(none, ["at"], ["id"]).collect() == []
    assert temporal.moving(none, "key", "at", 5, {"n": F.count("*")}).collect() == []

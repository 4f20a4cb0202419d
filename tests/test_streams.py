"""Streams with state: late rows, state that goes, restarts on one checkpoint; sketches and levels."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skein.operators import sketches
from skein.streaming import shop as streams

BEGIN = datetime(2024, 1, 1)
at = lambda hours: None if hours is None else BEGIN + timedelta(hours=hours)


def batches(spark, rows, schema):
    return [spark.createDataFrame(part, schema) for part in rows]


def test_late_rows_and_evicted_windows(spark, tmp_path):
    schema = "ts timestamp_ntz, kind string, value double"
    parts = batches(spark, [[(at(1), "a", 1.0), (at(40), "a", 2.0)], [(at(2), "a", 5.0), (at(20), "a", 0.5), (at(90), None, None), (None, "a", 1.0)]], schema)
    dropped = []
    for part in parts:
        part.write.mode("append").parquet(f"{tmp_path}/in")
        query = streams.finished(streams.appended(streams.windowed(streams.events(spark, f"{tmp_path}/in", part)), f"{tmp_path}/out", f"{tmp_path}/state"))
        dropped.append(sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]))
        left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    got = {(r.start, r.kind, r.n_clicks, r.cents) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(at(0), "a", 1, 100), (at(18), "a", 1, 50), (at(36), "a", 1, 200)}  # hour 2 came after its window was given
    assert dropped == [0, 1] and left == 1  # one window is open


def test_joined_streams_forget(spark, tmp_path):
    clicks = [[(1, 7, at(1)), (2, 7, at(2)), (3, None, at(1))], [(4, 7, at(500)), (5, 8, at(500))], [(6, 7, at(900))]]
    sales = [[(10, 7, at(1.5)), (11, 8, at(1.5))], [(12, 7, at(501)), (13, 8, at(501.2)), (14, 8, at(500))], [(15, 7, at(901))]]
    left = []
    for some, others in zip(batches(spark, clicks, "click_id long, client_id long, ts timestamp_ntz"), batches(spark, sales, "sale_id long, client_id long, sold_at timestamp_ntz"), strict=True):
        some.write.mode("append").parquet(f"{tmp_path}/c")
        others.write.mode("append").parquet(f"{tmp_path}/s")
        met = streams.followed(streams.events(spark, f"{tmp_path}/c", some), streams.events(spark, f"{tmp_path}/s", others))
        query = streams.finished(streams.appended(met, f"{tmp_path}/out", f"{tmp_path}/state"))
        left.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted((r.click_id, r.sale_id) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 10), (4, 12), (5, 14), (6, 15)]
    assert left[2] <= 4  # of the first two starts nothing is held


def test_queues_are_bounded(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = [(i, rng.choice((7, 7, 7, 8, None)), at(rng.randrange(2000))) for i in range(900)]
    rows += rows[:50]
    for part in batches(spark, [rows[:300], rows[300:600], rows[600:]], "click_id long, client_id long, ts timestamp_ntz"):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        query = streams.finished(streams.queued(streams.events(spark, f"{tmp_path}/in", part), f"{tmp_path}/out", f"{tmp_path}/state"))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * streams.SALTS
    got = {r.client_id: r.ids for r in streams.queues(spark, f"{tmp_path}/out").collect()}
    for client in (7, 8):
        newest = sorted({(t, i) for i, c, t in rows if c == client}, reverse=True)[: streams.QUEUE]
        assert got[client] == [i for _, i in newest]
    assert set(got) == {7, 8}


def test_sketches_merge_within_their_bounds(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("client"), (F.col("id") * 7919 % 40_000).alias("v"))
    rows = rows.withColumn("all", F.lit(1))
    days = sketches.states(rows, ["all", "day"], "client", "v", "client")
    told = sketches.audited(rows, sketches.merged(days, ["all"]), ["all"], "client", "v", "client").first()
    assert (told.n_rows, told.exact_distinct) == (60_000, 5000)
    assert told.distinct_error <= sketches.DISTINCT_ERROR and told.rank_error <= sketches.RANK_ERROR and told.count_error <= sketches.COUNT_ERROR
    assert told.top_items[0].item == 7


def test_levels_equal_loops(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice((1, 2, None)), rng.choice((7, 7, 8, None)), rng.randrange(9)) for _ in range(80)]
    sets = [("x", "y"), ("y",), ()]
    got = sketches.levels(spark.createDataFrame(rows, "x string, y int, who long, v long"), ["x", "y"], sets, "who", {"v": F.col("v")}).collect()
    want = set()
    for names in sets:
        level = sum(bit for bit, d in ((2, "x"), (1, "y")) if d not in names)
        keys = {(x if "x" in names else None, y if "y" in names else None) for x, y, _, _ in rows}
        for key in keys:
            mine = [r for r in rows if ("x" not in names or r[0] == key[0]) and ("y" not in names or r[1] == key[1])]
            want.add((level, *key, len({r[2] for r in mine} - {None}), len(mine), sum(r[3] for r in mine)))
    assert {tuple(r) for r in got} == want

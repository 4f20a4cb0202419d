"""Sums before ranges at any size, and places in a global order."""

import pytest
from pyspark.sql import functions as F

from skein.operators import ranges


@pytest.mark.parametrize("fan", (2, 3, 1000))
@pytest.mark.parametrize("fold", ("sum", "min", "max"))
def test_before_equals_a_loop(spark, fan, fold):
    rows = [(k, i, (i * 7 + 3) % 11) for k in ("a", "b", None) for i in range(0, 23, 1 + (k == "b"))]
    got = {(r.k, r.i): r.before_ for r in ranges.before(spark.createDataFrame(rows, "k string, i long, v long"), ["k"], "i", F.col("v"), fold, fan=fan).collect()}
    by_hand = {"sum": sum, "min": min, "max": max}[fold]
    assert got == {(k, i): by_hand([w for x, j, w in rows if x == k and j < i], default=None) if fold != "sum" else sum(w for x, j, w in rows if x == k and j < i) if any(x == k and j < i for x, j, _ in rows) else None for k, i, _ in rows}


def test_places_ascend(spark):
    rows = spark.createDataFrame([((i * 37) % 101, i) for i in range(500)] + [(None, 500)], "v long, i long")
    got = ranges.placed(rows, [F.col("v"), F.col("i")], 7).orderBy("part_", "place_").collect()
    order = [(r.v is not None, r.v or 0, r.i) for r in got]
    assert order == sorted(order) and len(got) == 501
    assert len({r.part_ for r in got}) > 1


def test_ranges_follow_the_size_that_is_read(spark):
    """Neither a join, which the planner takes for a product, nor rows without statistics make very many ranges."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for rows in (docs, docs.join(docs.select("doc_id"), "doc_id"), spark.createDataFrame([(1, "x")], "a int, b string")):
        assert ranges.range_count(rows) == int(spark.conf.get("spark.sql.shuffle.partitions"))

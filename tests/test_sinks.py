"""Files that are written whole, and lists in order, however the rows are dealt."""

import json
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from skein.operators import usage
from skein.plans import adapters as ad
from skein.plans import rules
from skein.sources import files, sinks

SF = "/root/testdata/sf0.001"


def test_passage_files_are_whole_however_partitions_are_joined(spark, tmp_path):
    settings = {"spark.sql.shuffle.partitions": "51", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = ad.passages(spark, SF).where("text <> ''")
        sinks.write_passages(rows, str(tmp_path / "p"))
        read = files.passages(spark, str(tmp_path / "p"), ad.sources(spark, SF).withColumn("enabled", F.lit(True)))
        assert sorted(r.id for r in read.collect()) == sorted(r.id for r in rows.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for file in Path(tmp_path / "p").glob("*.json"):
        told = [(p["sequence"], p["id"]) for p in json.loads(file.read_text())]
        assert told == sorted(told) and told


def test_lists_of_the_dashboard_are_in_order_however_parts_arrive(spark, monkeypatch):
    rows = [(f"{i:012d}", f"2024-01-{1 + i % 9:02d}T00:00:00", f"q{i % 7}", 1.0, [f"src{k}" for k in range(i % 6)]) for i in range(60)]
    log = spark.createDataFrame(rows, "key string, ts string, q string, result_count double, source_filter array<string>")
    right = usage.dashboard(log).first().asDict(recursive=True)
    lists = {n: getattr(usage, n) for n in ("top_queries", "recent_queries", "filter_usage")}
    for name, made in lists.items():
        first = {"recent_queries": "key"}.get(name, "count")
        monkeypatch.setattr(usage, name, lambda log, made=made, first=first: made(log).orderBy(first))  # as parts of another machine may come first
    assert usage.dashboard(log).first().asDict(recursive=True) == right
    assert [x["source_id"] for x in right["source_filter_usage"]] == ["src0", "src1", "src2", "src3", "src4"]
    assert [x["key"] for x in right["recent_queries"]][:2] == ["000000000008", "000000000017"]


def test_cents_are_as_in_sql(spark):
    values = [121830050806266.75, 118730051296852.25, 119980050738354.75, 123300050871646.5, 2.75, 1e10, 0.0, 0.125, 17.0]
    made = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(rules.cents(F.col("v"))).collect()]
    assert made == [duckdb.execute("SELECT CAST(CAST(? AS DOUBLE)::DECIMAL(20, 2) AS VARCHAR)", [v]).fetchone()[0] for v in values]

"""The shop's events as streams with state: windows with a watermark, a join of two streams, and a bounded queue per client.

Each is started on a folder to which files are added, reads what is new, and stops; a checkpoint carries its state from
start to start.  Times without a zone are taken as they are (UTC), whatever the session's zone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.temporal import bucket, micros

#: Records that a client's queue keeps, and parts in which a client's records are held, so that a hot client is no hot task.
QUEUE, SALTS = 100, 8
#: Parts of all clients whose queues are one state each.
SHARDS = 256


def instants(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with time stamps without a zone as instants, as watermarks want them."""
    return rows.withColumns({c: F.timestamp_micros(micros(rows, c)) for c in columns})


def zoneless(column: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(column), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def events(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The files of a folder as a stream."""
    return spark.readStream.schema(like.schema).parquet(path)


def finished(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    return query


def windowed(clicks: DataFrame, length: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(start, kind, n_clicks, cents): clicks by event time and kind.  A window is given once, when the watermark, the latest time
    of earlier starts less ``late``, has passed its end; rows that come later than that for their window are dropped."""
    rows = instants(clicks, "ts").withWatermark("ts", late)
    cents = F.floor(F.col("value") * 100 + 0.5)
    return rows.groupBy(F.window("ts", length), "kind").agg(F.count("*").alias("n_clicks"), F.sum(cents).alias("cents")).select(zoneless(F.col("window.start")).alias("start"), "kind", "n_clicks", "cents")


def appended(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is new to Parquet files, exactly once for a checkpoint."""
    return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def followed(clicks: DataFrame, sales: DataFrame, within: int = 3600, late: str = "4 days") -> DataFrame:
    """(click_id, sale_id, client_id, ts, sold_at): sales of a click's client up to ``within`` seconds after it.

    Both streams have a watermark, so that state holds what may still meet: rows go once the other stream has passed them by
    ``within`` seconds.  Rows meet by client and bucket of time; a click is in two buckets, a sale in one, so a pair is found once
    and a hot client's state lies in many tasks."""
    slot = lambda rows, c: bucket(F.unix_micros(F.col(c)), within)
    c = instants(clicks, "ts").select("click_id", F.col("client_id").alias("clicker"), "ts").withWatermark("ts", late)
    s = instants(sales, "sold_at").select("sale_id", "client_id", "sold_at").withWatermark("sold_at", late)
    c = c.withColumn("c_slot", F.explode(F.array(slot(c, "ts"), slot(c, "ts") + 1)))
    s = s.withColumn("s_slot", slot(s, "sold_at"))
    soon = (F.col("sold_at") >= F.col("ts")) & (F.col("sold_at") <= F.col("ts") + F.expr(f"interval {within} seconds"))
    met = c.join(s, (F.col("clicker") == F.col("client_id")) & (F.col("c_slot") == F.col("s_slot")) & soon)
    return met.select("click_id", "sale_id", "client_id", zoneless(F.col("ts")).alias("ts"), zoneless(F.col("sold_at")).alias("sold_at"))


STATE = "client array<long>, salt array<int>, at array<long>, id array<long>"
KEPT = "client_id long, salt int, at array<long>, id array<long>"


def newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest records of each client of a shard, those of the state among them; the shard's queues and a batch are in memory.
    Queues that got a record are given."""
    names, unit = ["client", "salt", "at", "id"], ["client", "salt"]
    held = pd.DataFrame(dict(zip(names, state.get if state.exists else ([], [], [], []), strict=True)), dtype="int64")
    touched = []
    for batch in batches:
        touched.append(batch[unit].drop_duplicates())
        held = pd.concat([held, batch[names].astype("int64")]).drop_duplicates().sort_values(names).groupby(unit).tail(QUEUE)
    state.update(tuple(held[c].tolist() for c in names))
    told = held.merge(pd.concat(touched).drop_duplicates().astype("int64"), on=unit).sort_values(names)
    cuts = np.flatnonzero((told[unit].to_numpy()[1:] != told[unit].to_numpy()[:-1]).any(axis=1)) + 1
    parts = [np.split(told[c].to_numpy(), cuts) for c in names]
    yield pd.DataFrame({"client_id": [int(c[0]) for c in parts[0]], "salt": [int(c[0]) for c in parts[1]], "at": [c.tolist() for c in parts[2]], "id": [c.tolist() for c in parts[3]]})


def queued(clicks: DataFrame, path: str, checkpoint: str, shards: int = SHARDS) -> StreamingQuery:
    """Keep each client's newest QUEUE clicks, by time and id, as state; what changes in a batch is written to a folder of its number,
    which a batch that is tried again replaces.  A click that comes twice is kept once; clicks without client or time aren't.

    A state has the queues of a shard of clients, so that few clients a call cost little; choose ``shards`` for some thousands
    of clients in each.  A client's clicks lie in SALTS queues of different shards, so that a hot client is no hot task."""
    rows = clicks.select(F.col("client_id").alias("client"), F.pmod(F.xxhash64("click_id"), F.lit(SALTS)).cast("int").alias("salt"), micros(clicks, "ts").alias("at"), F.col("click_id").alias("id"))
    rows = rows.where("client is not null and at is not null and id is not null").withColumn("shard", F.pmod(F.xxhash64("client", "salt"), F.lit(shards)))
    rows = rows.groupBy("shard").applyInPandasWithState(newest, KEPT, STATE, "update", GroupStateTimeout.NoTimeout)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def queues(spark: SparkSession, path: str) -> DataFrame:
    """(client_id, ids): each client's newest clicks, the latest first, from what ``queued`` wrote: at most QUEUE of each of SALTS parts
    meet in a row."""
    told = spark.read.option("basePath", path).schema(f"{KEPT}, batch int").parquet(path)
    parts = told.groupBy("client_id", "salt").agg(F.max_by(F.arrays_zip("at", "id"), "batch").alias("kept"))
    every = parts.groupBy("client_id").agg(F.sort_array(F.flatten(F.collect_list("kept")), asc=False).alias("kept"))
    return every.select("client_id", F.slice(F.col("kept.id"), 1, QUEUE).alias("ids"))

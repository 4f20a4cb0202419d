"""The usage log: sanitising, a bounded queue, and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import unpadded

MAX_QUERY, MAX_ID, MAX_IDS, QUEUE = 500, 50, 10, 100


def asked(rows: DataFrame) -> DataFrame:
    """Records whose query isn't null or white space alone."""
    return rows.where(F.coalesce(unpadded(F.col("q")), F.lit("")) != "")


def sanitize(records: DataFrame, ts: Column) -> DataFrame:
    """(ts, q, result_count, source_filter) of records (q, result_count double, source_filter array<string>) with a query.

    The query is cut to 500 characters, counts below 0 or absent become 0 and others stay as they are, ids are cut to 50
    characters and the first 10 kept, null filters mean all sources; ``ts`` replaces what the client said.
    """
    ids = F.slice(F.transform(F.filter("source_filter", lambda x: x.isNotNull()), lambda x: F.left(x, F.lit(MAX_ID))), 1, MAX_IDS)
    count = F.greatest(F.coalesce(F.col("result_count").cast("double"), F.lit(0.0)), F.lit(0.0))
    return asked(records).select(ts.alias("ts"), F.left("q", F.lit(MAX_QUERY)).alias("q"), count.alias("result_count"), ids.alias("source_filter"))


def client_record(rows: DataFrame, key: Column, ts: Column) -> DataFrame:
    """(key, ts, q, result_count, source_filter) as a client queues it: the query cut, nothing else checked."""
    return rows.select(key.alias("key"), ts.alias("ts"), F.left("q", F.lit(MAX_QUERY)).alias("q"), F.col("result_count").cast("double").alias("result_count"), "source_filter")


def parse_payload(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Records from JSON objects; queries that aren't strings, and elements that aren't objects, are dropped, as are filter ids
    that aren't strings and counts that aren't numbers."""
    v = F.try_parse_json(column)
    kind = lambda c: F.coalesce(F.call_function("schema_of_variant", c), F.lit(""))
    get = lambda f, t="variant": F.try_variant_get("v", f"$.{f}", t)
    rows = payloads.withColumn("v", v).where(kind(F.col("v")).startswith("OBJECT") & (kind(get("q")) == "STRING"))
    count = F.when(kind(get("resultCount")).rlike("^(BIGINT|DECIMAL|DOUBLE)"), get("resultCount", "double"))
    items = get("sourceFilter", "array<variant>")
    ids = F.transform(F.filter(items, lambda x: kind(x) == "STRING"), lambda x: F.variant_get(x, "$", "string"))
    return rows.select(get("q", "string").alias("q"), count.alias("result_count"), F.when(kind(get("sourceFilter")).startswith("ARRAY"), ids).alias("source_filter"))


def log_key(ts: Column, random: Column) -> Column:
    return F.concat(F.translate(ts, ":.", "--"), F.lit("-"), random)


def newest(records: DataFrame, keep: int = QUEUE, *order: str) -> DataFrame:
    """The newest ``keep`` records by key: a top-k, never a sort of all."""
    return records.orderBy(*[F.desc(c) for c in (order or ("key",))]).limit(keep)


def enqueue(queue: DataFrame, record: DataFrame, keep: int = QUEUE) -> DataFrame:
    return newest(queue.unionByName(record), keep)


def delivered(queue: DataFrame, accepted: DataFrame) -> DataFrame:
    """What stays queued after a delivery: records whose keys weren't accepted."""
    return queue.join(accepted.select("key"), "key", "left_anti")


def query_stats(log: DataFrame) -> DataFrame:
    """(norm, q, count, total_results, last_seen) for each query, ignoring case and surrounding blanks; shown as first seen."""
    rows = asked(log).withColumn("q", unpadded(F.col("q"))).withColumn("norm", F.lower("q"))
    return rows.groupBy("norm").agg(F.min_by("q", "key").alias("q"), F.count("*").alias("count"), F.sum(F.coalesce("result_count", F.lit(0.0))).alias("total_results"), F.max_by("ts", "key").alias("last_seen"))


def top_queries(log: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent queries, ties in the order of a dictionary."""
    return query_stats(log).orderBy(F.desc("count"), F.collate("q", "UNICODE"), "norm").limit(top).select("q", "count", "total_results", "last_seen")


def recent_queries(log: DataFrame, top: int = 20) -> DataFrame:
    """The latest queries, those of one time in the order of their keys."""
    rows = asked(log).orderBy(F.desc("ts"), "key").limit(top)
    return rows.select("key", "ts", unpadded(F.col("q")).alias("q"), F.coalesce("result_count", F.lit(0.0)).alias("result_count"), "source_filter")


def filter_usage(log: DataFrame) -> DataFrame:
    """(source_id, count): how often each source was filtered for; a record that names one twice counts twice."""
    ids = asked(log).select(F.explode("source_filter").alias("source_id")).where(unpadded(F.col("source_id")) != "")
    return ids.groupBy("source_id").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "source_id")


def summary(log: DataFrame) -> DataFrame:
    """One row: total_records, oldest_ts, latest_ts; times are null for an empty log."""
    return asked(log).agg(F.count("*").alias("total_records"), F.min("ts").alias("oldest_ts"), F.max("ts").alias("latest_ts"))


def dashboard(log: DataFrame) -> DataFrame:
    """One row with the summary and the three lists, which are short by construction."""

    def packed(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
        """The rows of a short list as one array in ``order``, in whatever order parts of it arrive."""
        at = F.row_number().over(Window.orderBy(*order))
        rows = F.sort_array(F.collect_list(F.struct("at_", F.struct(*df.columns).alias("row_"))))
        return df.withColumn("at_", at).agg(rows.alias(name)).select(F.col(f"{name}.row_").alias(name))

    top = packed(top_queries(log), "top_queries", F.desc("count"), F.collate("q", "UNICODE"), F.lower("q"))
    recent = packed(recent_queries(log), "recent_queries", F.desc("ts"), "key")
    return summary(log).crossJoin(top).crossJoin(recent).crossJoin(packed(filter_usage(log), "source_filter_usage", F.desc("count"), "source_id"))


def trend(log: DataFrame, every: str = "1 day") -> DataFrame:
    """An extra: (start, source_id, records) by time window and source with totals over both."""
    rows = log.select(F.window(F.to_timestamp("ts"), every)["start"].alias("start"), F.explode_outer("source_filter").alias("source_id"))
    return rows.cube("start", "source_id").agg(F.count("*").alias("records"))

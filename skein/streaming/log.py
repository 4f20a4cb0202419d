"""The usage log as a stream: files of posted records in, sanitised records out, exactly once per checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators.usage import sanitize

POSTED = "q string, resultCount double, sourceFilter array<string>"


def posted(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Records as clients post them, JSON lines."""
    rows = spark.readStream.schema(POSTED).option("maxFilesPerTrigger", per_trigger).json(path)
    return rows.select("q", F.col("resultCount").alias("result_count"), F.col("sourceFilter").alias("source_filter"))


def server_time() -> Column:
    """One time stamp for each batch, as ISO text."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def write_log(records: DataFrame, path: str, checkpoint: str, ts: Column | None = None, available_now: bool = True) -> StreamingQuery:
    """Append sanitised records as Parquet.  Stateless: no watermark is needed; the checkpoint makes the sink exactly-once, and a
    batch that fails is tried again."""
    out = sanitize(records, ts if ts is not None else server_time())
    writer = out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def debounced(events: DataFrame, ts: str = "ts", user: str = "user_id", value: str = "q", quiet: str = "150 milliseconds") -> DataFrame:
    """An extra: the last value of each burst of a user's events, by session windows with a watermark."""
    return events.withWatermark(ts, "10 seconds").groupBy(user, F.session_window(ts, quiet)).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts)).drop("session_window")

"""Helpers that several operators share: scratch tables in the shared folder, word splitting, Arrow columns."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from skein.sources.shared import shared_dir


#: Spark's setting that removes shuffle files at the end of an execution.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors.

    The shuffle files of the write are removed when it ends, as nothing reads them again.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more, through the file system that holds them."""
    for df in tables:
        spark = df.sparkSession
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A key with more than one in HOT_SHARE of the rows is hot: fewer than HOT_SHARE keys can be.  A hot key is dealt over SALTS tasks.
HOT_SHARE, SALTS = 1000, 64


def spread_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", counts: DataFrame | None = None, total: int | None = None, hint: str | None = None) -> DataFrame:
    """``left`` joined to ``right`` by the column ``on``, hot keys of ``left`` dealt over many tasks.

    ``right`` has one row, or a few, for each key; its rows for hot keys are repeated.  ``counts`` (on, n_) may bring the rows of
    ``left`` for each key, or a lower number, and ``total`` a number not below their sum.  The hot keys are fewer than HOT_SHARE, as
    each has over that share of all: whole numbers are gathered, so that rows are told apart without a join, others are
    broadcast.  ``hint`` may fix how Spark joins.
    """
    counts = left.groupBy(on).agg(F.count("*").alias("n_")) if counts is None else counts
    total = left.count() if total is None else total
    hot = counts.where(F.col("n_") * HOT_SHARE > total)
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(SALTS)).cast("int")
    salts = lambda is_hot: F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    if isinstance(left.schema[on].dataType, IntegralType):
        is_hot = F.col(f"`{on}`").isin([r[0] for r in hot.select(on).collect()])
        dealt, repeated = left.withColumn("salt_", F.when(is_hot, spread).otherwise(0)), right.withColumn("salt_", salts(is_hot))
    else:
        told = F.broadcast(hot.select(on, F.lit(True).alias("hot_")))
        dealt = left.join(told, on, "left").withColumn("salt_", F.when(F.col("hot_"), spread).otherwise(0)).drop("hot_")
        repeated = right.join(told, on, "left").withColumn("salt_", salts(F.col("hot_"))).drop("hot_")
    return dealt.join(repeated.hint(hint) if hint else repeated, [on, "salt_"], how).drop("salt_")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_table() -> bytes:
    """Byte map for ``bytes.translate``: lower-cases A-Z, keeps digits, a-z and all bytes of non-ASCII
    characters, and turns every other ASCII character into a space."""
    kept = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
    return bytes(b if b in kept else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that Python copies of texts stay small."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


class Sent:
    """A broadcast object, pickled by value: workers need not have this package."""

    def __init__(self, spark: SparkSession, value):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        return pickle.loads(self.held.value)

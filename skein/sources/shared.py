"""The folder that driver and executors share, and tables stored in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none, as in local tests, a temporary folder is made and set;
    a cluster without the setting is an error, as its executors could not see such a folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
    return sc.getCheckpointDir().rstrip("/")


#: Spark's setting that removes shuffle files at the end of an execution.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each write within are removed when it ends, as nothing reads them again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to a new place in the shared folder and read again: their lineage ends there, and lost executors do no harm."""
    spark, path = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)

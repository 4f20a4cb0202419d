"""All queries of the engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.plans import oracle, rules, shop, storage
from skein.plans import queries as main


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*main.ALL, *storage.ALL, *rules.ALL, *shop.ALL)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql() | storage.oracle_sql() | rules.oracle_sql() | shop.oracle_sql()

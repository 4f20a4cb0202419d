"""A table of changes applied to the table that it is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_changes(base: DataFrame, changes: DataFrame, key: str, order: list[str], op: str, columns: dict[str, str]) -> DataFrame:
    """``base`` after ``changes``, with ``action``: same, update, insert, replace (deleted, then made anew) or delete.

    Changes count in order of ``order``, whenever they arrived: D forgets the row, I and U set those of ``columns`` (of the base:
    of the changes) that they hold; a null leaves what was there.  A row deleted last is given once more, with its key
    alone.  Changes without key or order or with another op don't count, repeated ones count once; base rows without key stay.

    Changes shrink to a row per key in one aggregate that is combined before its shuffle, so that a hot key is no hot task; that
    row meets the base in a full outer join.
    """
    at = F.struct(*[F.col(f"`{c}`") for c in order])
    sets = F.col(f"`{op}`").isin("I", "U")
    fine = changes.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{op}`").isin("I", "U", "D"))
    for c in order:
        fine = fine.where(F.col(f"`{c}`").isNotNull())
    value = lambda c: F.max(F.when(sets & F.col(f"`{c}`").isNotNull(), F.struct(at.alias("at"), F.col(f"`{c}`").alias("v"))))
    last = fine.groupBy(F.col(f"`{key}`").alias("key_")).agg(F.max(at).alias("last_"), F.max(F.when(~sets, at)).alias("gone_"), *[value(c).alias(f"set_{i}") for i, c in enumerate(columns.values())])

    rows = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row_"), F.col(f"`{key}`").alias("own_"))
    met = rows.join(last, rows.own_ == last.key_, "full_outer")
    gone, known = F.col("gone_").isNotNull(), F.col("row_").isNotNull()
    deleted = gone & (F.col("gone_") == F.col("last_"))

    def now(name: str) -> Column:
        old = F.when(~gone, F.col(f"row_.`{name}`"))
        if name == key:
            return F.coalesce("own_", "key_")
        if name not in columns:
            return old
        told = F.col(f"set_{list(columns).index(name)}")
        fresh = told.isNotNull() & (~gone | (told["at"] > F.col("gone_")))
        return F.when(deleted, F.lit(None)).when(fresh, told["v"]).otherwise(old)

    action = F.when(F.col("last_").isNull(), "same").when(deleted, "delete").when(~known, "insert").when(gone, "replace").otherwise("update")
    return met.select(*[now(c).alias(c) for c in base.columns], action.alias("action"))

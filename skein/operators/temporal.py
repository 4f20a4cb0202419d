"""Joins and frames in time: as-of, spans, overlapping intervals, and moving ranges.

A key's rows are dealt by buckets of time as well as by key, so that no key lies in one task however hot it is; what crosses a
bucket's border is carried by one row per key and bucket, or copied as a halo.  Rows without key or time belong to no bucket;
each function says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.ranges import before

HOUR, DAY = 3600, 86400
#: A time beyond those of any table, in microseconds: how many levels of sums buckets need follows from it.
FAR = 8_000_000_000_000_000


def micros(rows: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a column of time stamps, with or without a zone."""
    kind = rows.schema[column].dataType.simpleString()
    if kind == "timestamp":
        return F.unix_micros(F.col(f"`{column}`"))
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)")


def bucket(at: Column, seconds: int) -> Column:
    return F.floor(at / F.lit(seconds * 1_000_000)).cast("long")


def packed(rows: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in rows.columns])


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, ties: list[str], width: int = DAY, prefix: str = "right_") -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of its key at its time or before; of several of one time the last by
    ``ties``.  The columns of ``right`` get ``prefix`` and are null where there is none, as for rows without key or time.

    Both sides are merged in order of time within buckets of ``width`` seconds, in one shuffle; the last row of earlier
    buckets is carried, one row per key and bucket, and joins where the buckets already are.
    """
    order = F.struct(F.col("at_"), *[F.col(f"`{c}`") for c in ties])
    told = right.withColumn("at_", micros(right, right_at)).where(F.col(f"`{key}`").isNotNull() & F.col("at_").isNotNull())
    told = told.select(F.col(f"`{key}`").alias("key_"), "at_", F.struct(order.alias("order_"), packed(right).alias("row_")).alias("told_"))
    asked = left.select(packed(left).alias("row_"), F.col(f"`{key}`").alias("key_"), micros(left, left_at).alias("at_"))
    alone = asked.where("key_ is null or at_ is null").select("row_", F.lit(None).cast(told.schema["told_"].dataType).alias("told_"))
    asked = asked.where("key_ is not null and at_ is not null")

    slot = bucket(F.col("at_"), width).alias("slot_")
    closing = told.groupBy("key_", slot).agg(F.max("told_").alias("told_"))
    nothing = F.lit(None).cast(told.schema["told_"].dataType)
    slots = closing.unionByName(asked.select("key_", slot, nothing.alias("told_")).distinct()).groupBy("key_", "slot_").agg(F.max("told_").alias("told_"))
    value = F.when(F.col("told_").isNotNull(), F.struct("slot_", "told_"))
    carried = before(slots, ["key_"], "slot_", value, "max", FAR // (width * 1_000_000)).select("key_", "slot_", F.col("before_.told_").alias("carried_"))

    both = told.select("key_", "at_", slot, F.lit(0).alias("side_"), nothing_of(left).alias("row_"), "told_").unionByName(asked.select("key_", "at_", slot, F.lit(1).alias("side_"), "row_", nothing.alias("told_")))
    up_to_now = Window.partitionBy("key_", "slot_").orderBy("at_", "side_", "told_").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("told_", F.last("told_", ignorenulls=True).over(up_to_now)).where("side_ = 1")
    met = met.join(carried, ["key_", "slot_"], "left").select("row_", F.coalesce("told_", "carried_").alias("told_")).unionByName(alone)
    return met.select(*[F.col(f"row_.`{c}`") for c in left.columns], *[F.col(f"told_.row_.`{c}`").alias(prefix + c) for c in right.columns])


def nothing_of(rows: DataFrame) -> Column:
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema)
    return F.lit(None).cast(f"struct<{fields}>")


def spans(changes: DataFrame, key: str, at: str, ties: list[str], width: int = DAY, end: str = "valid_to") -> DataFrame:
    """The rows of ``changes`` with the time of their key's next one as ``end``, null for the last: each holds from its time on, until
    then.  Of several at one time the last by ``ties`` stays; rows without key or time are dropped, repeated ones count once."""
    rows = changes.withColumn("at_", micros(changes, at)).withColumn("key_", F.col(f"`{key}`")).where("key_ is not null and at_ is not null")
    last = rows.groupBy("key_", "at_").agg(F.max(F.struct(*[F.col(f"`{c}`") for c in ties], packed(changes).alias("row_"))).alias("last_"))
    last = last.select("key_", "at_", "last_.row_", bucket(F.col("at_"), width).alias("slot_"))
    begin = last.groupBy("key_", "slot_").agg(F.min(F.struct("at_", F.col(f"row_.`{at}`").alias("time_"))).alias("begin_")).withColumn("back_", -F.col("slot_"))
    following = before(begin, ["key_"], "back_", F.struct("slot_", "begin_"), "min", FAR // (width * 1_000_000)).select("key_", "slot_", F.col("before_.begin_.time_").alias("later_"))
    inside = F.lead(F.col(f"row_.`{at}`")).over(Window.partitionBy("key_", "slot_").orderBy("at_"))
    out = last.withColumn("inside_", inside).join(following, ["key_", "slot_"])
    return out.select(*[F.col(f"row_.`{c}`") for c in changes.columns], F.coalesce("inside_", "later_").alias(end))


def overlaps(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], width: int = DAY, prefix: str = "right_") -> DataFrame:
    """Pairs of rows of one key whose intervals [begin, end) have an instant in common; an interval that ends where it begins
    is that instant, one whose end is null never ends, and rows without key or begin, or that end before they begin, have no pairs.

    Rows of ``left`` go to all buckets of ``width`` seconds that they touch, up to the last begin on the right; those of ``right``
    only to the buckets in which their key has rows on the left, however long they are.  A pair is found once, in the bucket
    where the later one begins.  ``right`` is read twice, so store what is costly.  ``left`` should be the side of shorter intervals; a key's buckets, one list a key, are as
    many as the time that the table covers has.
    """

    def timed(rows: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
        out = rows.select(packed(rows).alias(f"{side}_row"), F.col(f"`{key}`").alias("key_"), micros(rows, span[0]).alias(f"{side}_low"), F.coalesce(micros(rows, span[1]), F.lit(FAR)).alias(f"{side}_high"))
        return out.where(f"key_ is not null and {side}_low is not null and {side}_high >= {side}_low")

    ones, others = timed(left, left_span, "l"), timed(right, right_span, "r")
    last = others.agg(F.max("r_low")).first()[0]
    slot = lambda at: bucket(at, width)
    up_to = F.least(F.col("l_high"), F.greatest(F.col("l_low"), F.lit(last if last is not None else 0)))
    ones = ones.withColumn("slot_", F.explode(F.sequence(slot(F.col("l_low")), slot(up_to))))
    slots = ones.groupBy("key_").agg(F.collect_set("slot_").alias("slots_"))
    inside = F.filter("slots_", lambda x: x.between(slot(F.col("r_low")), slot(F.col("r_high"))))
    others = others.join(slots, "key_").withColumn("slot_", F.explode(inside)).drop("slots_")
    met = ones.join(others, ["key_", "slot_"])
    same = F.col("l_low") == F.col("r_low")
    common = (same | (F.col("l_low") < F.col("r_high"))) & (same | (F.col("r_low") < F.col("l_high")))
    met = met.where((F.col("slot_") == slot(F.greatest("l_low", "r_low"))) & common)
    return met.select(*[F.col(f"l_row.`{c}`") for c in left.columns], *[F.col(f"r_row.`{c}`").alias(prefix + c) for c in right.columns])


def moving(rows: DataFrame, key: str, at: str, back: int, measures: dict[str, Column], forth: int = 0, width: int | None = None) -> DataFrame:
    """``rows`` with measures over the rows of their key from ``back`` seconds before to ``forth`` seconds after their time, both
    included; ``measures`` are aggregates of the rows' columns.  Rows of one time see each other; rows without key or time
    have null measures.

    A row goes to its bucket, and as a halo to the neighbours whose frames reach it; buckets are at least as wide as frames,
    so that those are the ones next to it.
    """
    width = max(width or HOUR, back, forth, 1)
    numbered = rows.withColumn("at_", micros(rows, at)).withColumn("key_", F.col(f"`{key}`"))
    there = numbered.where("key_ is not null and at_ is not null")
    slots = F.array_distinct(F.transform(F.array(F.lit(0), F.lit(back), F.lit(-forth)), lambda s: bucket(F.col("at_") + s * 1_000_000, width)))
    dealt = there.withColumn("own_", bucket(F.col("at_"), width)).withColumn("slot_", F.explode(slots))
    frame = Window.partitionBy("key_", "slot_").orderBy("at_").rangeBetween(-back * 1_000_000, forth * 1_000_000)
    out = dealt.select(*rows.columns, "own_", "slot_", *[m.over(frame).alias(n) for n, m in measures.items()]).where("own_ = slot_").drop("own_", "slot_")
    alone = numbered.where("key_ is null or at_ is null").drop("at_", "key_")
    return out.unionByName(alone, allowMissingColumns=True)

"""Ordered work over ranges of any number of rows: places in a global order, and sums of what goes before each range.

Rows are dealt by ranges of their order and sorted within; only one row per range then has to know of the others, and those
are summed up in groups of at most FAN, level over level, so that no task gets more than FAN of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.shared import stored

#: Rows of a group in which running sums are made.
FAN = 1000
#: Bytes of a range, about, where the session's number of shuffle partitions would give larger ones.
RANGE_BYTES, MOST_RANGES = 64 << 20, 1 << 20


#: From here on a size is the planner's word for "unknown".
UNKNOWN_BYTES = 1 << 60


def range_count(rows: DataFrame) -> int:
    """Ranges for ``rows``: the session's number of shuffle partitions, or more by their size.

    That is the planner's figure, or what it reads from if that is less, as it takes a join for the product of its sides; rows
    of which it knows nothing are counted."""
    plan = rows._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    size = min(int(plan.stats().sizeInBytes()), sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())))
    if size >= UNKNOWN_BYTES:
        size = rows.count() * rows._jdf.schema().defaultSize()
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, -(-size // RANGE_BYTES)))


def placed(rows: DataFrame, order: list[Column], count: int | None = None) -> DataFrame:
    """``rows`` with ``part_`` and ``place_``, which ascend in the global order: one shuffle, no task with more than a range.

    The result is stored, as the bounds of ranges come from samples.  Rows of equal order share a range."""
    count = count or range_count(rows)
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(count, *order).sortWithinPartitions(*order)
    return stored(dealt.withColumn("at_", at).withColumn("part_", F.shiftright("at_", 33)).withColumn("place_", F.col("at_").bitwiseAND((1 << 33) - 1)).drop("at_"), "placed")


#: What is folded, and the fold of two results.
FOLDS = {"sum": (F.sum, lambda a, b: a + b), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def before(parts: DataFrame, keys: list[str], at: str, value: Column, fold: str = "sum", most: int | None = None, fan: int | None = None) -> DataFrame:
    """``parts`` with ``before_``: the sum, minimum or maximum of ``value`` over the rows of the same keys with a smaller ``at``, a
    whole number from 0 that is there once for each of the keys; null where there is none.  ``most`` is a bound of ``at``, if
    known.  Nulls among the keys are values like others."""
    fan, (all_of, of_two) = fan or FAN, FOLDS[fold]
    if most is None:
        most = parts.agg(F.max(at)).first()[0] or 0
    rows = parts.withColumn("value_", value)
    earlier = lambda *by: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    if most < fan:
        return rows.withColumn("before_", all_of("value_").over(earlier(*keys))).drop("value_")
    up = f"{at}_up"
    rows = rows.withColumn(up, F.floor(F.col(at) / fan))
    groups = before(rows.groupBy(*keys, up).agg(all_of("value_").alias("all_")), keys, up, F.col("all_"), fold, most // fan, fan)
    groups = groups.select(*[F.col(k).alias(f"{k}_key") for k in keys], F.col(up).alias("group_key"), F.col("before_").alias("groups_"))
    same = F.col(up) == F.col("group_key")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_key"))
    inside = rows.withColumn("inside_", all_of("value_").over(earlier(*keys, up))).join(groups, same, "left")
    either = F.coalesce("groups_", "inside_")
    both = F.when(F.col("groups_").isNull() | F.col("inside_").isNull(), either).otherwise(of_two(F.col("groups_"), F.col("inside_")))
    return inside.select(*parts.columns, both.alias("before_"))


def ranked(rows: DataFrame, by: list[str], ties: list[str], tiles: int = 100) -> DataFrame:
    """``rows`` with their exact place among all: row_no from 1, rank (equal ``by`` share one), percent_rank, and tile, one of
    ``tiles`` groups of nearly equal size.  Nulls come first; rows equal in ``by`` are in order of ``ties``.

    Rows are dealt by ranges of both, so that a frequent value lies over many ranges; a value that goes on from the range
    before takes its rank from the range where it began, which one row per range tells.
    """
    named = [F.col(f"`{c}`") for c in by]
    held = placed(rows, [*named, *[F.col(f"`{c}`") for c in ties]])
    counts = stored(held.groupBy("part_").agg(F.count("*").alias("rows_")), "counts")
    told = counts.agg(F.max("part_").alias("most"), F.sum("rows_").alias("n")).first()
    n = told["n"] or 0
    bases = before(counts, [], "part_", F.col("rows_"), most=told["most"] or 0).select("part_", F.coalesce("before_", F.lit(0)).alias("base_"))
    value = F.struct(*[c.alias(f"v{i}") for i, c in enumerate(named)])
    numbered = held.join(bases, "part_").withColumn("row_no", F.col("base_") + F.col("place_") + 1).withColumn("by_", value)
    numbered = stored(numbered.withColumn("first_", F.min("row_no").over(Window.partitionBy("part_", *[f"by_.v{i}" for i in range(len(by))]))), "numbered")
    edges = stored(numbered.groupBy("part_").agg(F.min_by("by_", "place_").alias("head_"), F.max_by(F.struct("by_", "first_"), "place_").alias("last_")), "edges")
    begun = edges.select(F.col("last_.by_").alias("value_"), F.col("last_.first_").alias("first_")).groupBy("value_").agg(F.min("first_").alias("begun_"))
    heads = edges.join(begun, edges.head_.eqNullSafe(begun.value_)).select("part_", "head_", "begun_")
    out = numbered.join(heads, "part_", "left")
    rank = F.when(F.col("by_").eqNullSafe(F.col("head_")), F.least("first_", F.col("begun_"))).otherwise(F.col("first_"))
    size, more = divmod(n, tiles)
    at = F.col("row_no") - 1
    tile = F.when(F.col("row_no") <= more * (size + 1), F.floor(at / (size + 1)) + 1).otherwise(more + F.floor((at - more * (size + 1)) / max(size, 1)) + 1)
    out = out.withColumn("rank", rank)
    share = (F.col("rank") - 1).cast("double") / F.lit(float(max(n - 1, 1)))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], "row_no", "rank", share.alias("percent_rank"), tile.cast("long").alias("tile"))

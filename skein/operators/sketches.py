"""Mergeable sketches by day, and levels of totals with distinct counts from one pre-aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the sketches: 2^LG_K registers, KLL's k, and items that are followed.
LG_K, KLL_K, ITEMS = 14, 800, 4096
#: Errors that they keep at these sizes: of a distinct count (five standard errors), of a quantile's rank, and of an item's count as a
#: share of all rows (the sketch's own bound is 3.5 / ITEMS).
DISTINCT_ERROR, RANK_ERROR, COUNT_ERROR = 0.041, 0.006, 0.001


def states(rows: DataFrame, by: list[str], distinct: str, value: str, item: str) -> DataFrame:
    """A row of sketches for each of ``by``, to be stored and merged: of the distinct values of ``distinct``, of the quantiles of
    ``value`` (whole numbers), and of the frequent values of ``item`` (whole numbers or texts).  Nulls don't count.

    Tasks make partial sketches of fixed size, so a day with most of the rows costs no more in the shuffle than another."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.hll_sketch_agg(F.col(distinct), F.lit(LG_K)).alias("distinct_state"), F.kll_sketch_agg_bigint(F.col(value), F.lit(KLL_K)).alias("quantile_state"),
        F.call_function("approx_top_k_accumulate", F.col(item), F.lit(ITEMS)).alias("item_state"),
    )


def merged(parts: DataFrame, by: list[str], ranks: tuple[float, ...] = (0.5, 0.9, 0.99), top: int = 100) -> DataFrame:
    """What the merged states tell for each of ``by``: n_rows, n_distinct, quantiles (of ``ranks``, in order), and top_items (item,
    count)."""
    whole = parts.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"), F.hll_union_agg("distinct_state").alias("d"), F.kll_merge_agg_bigint("quantile_state").alias("q"), F.call_function("approx_top_k_combine", F.col("item_state"), F.lit(ITEMS)).alias("i"),
    )
    quantiles = F.when(F.kll_sketch_get_n_bigint("q") > 0, F.kll_sketch_get_quantile_bigint("q", F.array(*[F.lit(float(r)) for r in ranks])))
    return whole.select(*by, "n_rows", F.hll_sketch_estimate("d").alias("n_distinct"), quantiles.alias("quantiles"), F.call_function("approx_top_k_estimate", F.col("i"), F.lit(top)).alias("top_items"))


def audited(rows: DataFrame, told: DataFrame, by: list[str], distinct: str, value: str, item: str, ranks: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """``told``, one row for each of ``by``, beside exact figures: exact_distinct, distinct_error (relative), rank_error (the largest of
    the quantiles), and count_error (the largest among items with over a hundredth of the rows, as a share of them).

    The exact figures are whole aggregates, combined before their shuffles."""
    keys = [F.col(c) for c in by]
    exact = rows.groupBy(*keys, F.col(distinct)).agg(F.lit(1)).groupBy(*keys).agg(F.count(distinct).alias("exact_distinct"))
    values = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v_")).agg(F.count("*").alias("c_"))
    asked = told.select(*keys, F.posexplode("quantiles").alias("r_", "q_"))
    ranked = values.join(asked, by).groupBy(*keys, "r_", "q_").agg(F.sum("c_").alias("n_"), F.sum(F.when(F.col("v_") < F.col("q_"), F.col("c_")).otherwise(0)).alias("below_"), F.sum(F.when(F.col("v_") <= F.col("q_"), F.col("c_")).otherwise(0)).alias("upto_"))
    rank = F.element_at(F.array(*[F.lit(float(r)) for r in ranks]), F.col("r_") + 1)
    off = F.greatest(F.col("below_") / F.col("n_") - rank, rank - F.col("upto_") / F.col("n_"), F.lit(0.0))
    ranked = ranked.groupBy(*keys).agg(F.max(off).alias("rank_error"))
    items = rows.where(F.col(item).isNotNull()).groupBy(*keys, F.col(item).alias("item_")).agg(F.count("*").alias("c_")).join(told.select(*keys, "n_rows"), by).where("c_ * 100 > n_rows")
    listed = told.select(*keys, F.explode("top_items").alias("t_")).select(*keys, F.col("t_.item").alias("item_"), F.col("t_.count").alias("told_"))
    items = items.join(listed, [*by, "item_"], "left").groupBy(*keys).agg(F.max(F.abs(F.col("c_") - F.coalesce("told_", F.lit(0))) / F.col("n_rows")).alias("count_error"))
    out = told.join(exact, by, "left").join(ranked, by, "left").join(items, by, "left")
    return out.withColumn("distinct_error", F.abs(F.col("n_distinct") - F.col("exact_distinct")) / F.greatest("exact_distinct", F.lit(1)))


def levels(rows: DataFrame, dims: list[str], sets: list[tuple[str, ...]], distinct: str, measures: dict[str, Column]) -> DataFrame:
    """Totals on several levels: for each set of ``dims`` a row for each of its values, with level (a bit for each dimension that is
    summed over, the first the highest), the other dimensions null, n_rows, n_distinct (of ``distinct``, nulls apart), and
    ``measures``, columns that are summed.

    All rows shrink once, to a row for each of all dimensions and ``distinct``; only those are repeated for the levels.
    """
    counts = [F.count("*").alias("n_rows"), *[F.sum(m).alias(n) for n, m in measures.items()]]
    fine = rows.groupBy(*dims, F.col(distinct).alias("distinct_")).agg(*counts)
    level = lambda s: sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in s)
    kinds = {d: rows.schema[d].dataType.simpleString() for d in dims}
    places = [F.struct(F.lit(level(s)).alias("level"), *[(F.col(d) if d in s else F.lit(None)).cast(kinds[d]).alias(d) for d in dims]) for s in sets]
    names = ["n_rows", *measures]
    dealt = fine.select(F.explode(F.array(*places)).alias("place_"), "distinct_", *names).select("place_.*", "distinct_", *names)
    sums = [F.sum(n).alias(n) for n in names]
    per_value = dealt.groupBy("level", *dims, "distinct_").agg(*sums)
    return per_value.groupBy("level", *dims).agg(F.count("distinct_").alias("n_distinct"), *sums)

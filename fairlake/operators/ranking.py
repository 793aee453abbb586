"""Ranks and running totals that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 32


def with_slices(df: DataFrame, order: str, slices: int = SLICES) -> DataFrame:
    """Adds ``_slice``, the index of the slice of ``order`` that a row falls in; NULL values fall in the first.

    The limits are approximate quantiles of the column, a scalar subquery of the same plan: no
    job runs before the query's own.
    """
    value = F.col(order).cast("double")
    shares = [i / slices for i in range(1, slices)]
    if not shares:
        return df.withColumn("_slice", F.lit(0))
    limits = df.select(value.alias("v")).agg(F.percentile_approx("v", shares, 10_000).alias("limits")).scalar()
    known = df.withColumn("_limits", F.coalesce(limits, F.array().cast("array<double>")))
    return known.withColumn("_slice", F.size(F.filter("_limits", lambda limit: limit < value))).drop("_limits")


def running_total(df: DataFrame, keys: list[str], order: str, value: str, out: str, slices: int = SLICES, cut: Column | None = None) -> DataFrame:
    """Adds ``out``: sum of ``value`` over rows of the same key up to and including this order.

    ``order`` must be numeric and unique within a key; NULL comes first. Rows are cut into slices
    of the order, so a hot key is spread over ``slices`` tasks; slice totals are at most
    ``slices`` rows per key and combine before their shuffle. ``cut`` gives the slice where the caller knows
    one that grows with the order.
    """
    sliced = with_slices(df, order, slices) if cut is None else df.withColumn("_slice", cut)
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = sliced.withColumn("_inside", F.sum(value).over(inside))
    same = [summed[k].eqNullSafe(offsets[k]) for k in [*keys, "_slice"]]
    return summed.join(offsets, same).select(
        *[summed[c] for c in df.columns], (F.col("_before") + F.col("_inside")).alias(out))


def rank_within(df: DataFrame, keys: list[str], order: str, out: str, slices: int = SLICES) -> DataFrame:
    """Adds ``out``: 1-based position of a row within its key; ``order`` must be unique there."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_total(ones, keys, order, "_one", out, slices).drop("_one")

"""Shared pieces of the chart-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspark.operators.ordering import join_groups, quantiles, running, split_points

SIMPLE = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose numeric columns are neither null nor NaN."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def aggregated(df: DataFrame, by: Sequence[str], y: str | None = None, agg: str = "count", out: str = "value") -> DataFrame:
    """`agg` of `y` per group: count, sum, mean, min, max, std or median."""
    if agg == "count":
        return df.groupBy(*by).agg(F.count(F.lit(1) if y is None else F.col(y)).alias(out))
    if agg == "median":
        return quantiles(df, y, by, {out: 0.5})
    if agg not in SIMPLE:
        raise ValueError(f"unknown aggregation {agg}")
    return df.groupBy(*by).agg(SIMPLE[agg](y).alias(out))


def with_share(df: DataFrame, by: Sequence[str], value: str = "value", out: str = "share") -> DataFrame:
    """Share of `value` in the total of its group, or of the table when `by` is empty."""
    if not by:
        total = df.agg(F.sum(value).alias("_total")).scalar()
        return df.withColumn(out, F.try_divide(F.col(value).cast("double"), total))
    totals = df.groupBy(*by).agg(F.sum(value).alias("_total"))
    joined = join_groups(df, totals, by)
    return joined.withColumn(out, F.try_divide(F.col(value).cast("double"), F.col("_total"))).drop("_total")


def limits(df: DataFrame, *columns: str) -> Column:
    """struct(min_<c>, max_<c>…) of the whole table as one value of the plan; NaN is no limit."""
    pieces = []
    for c in columns:
        value = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        pieces += [F.min(value).alias(f"min_{c}"), F.max(value).alias(f"max_{c}")]
    return df.agg(F.struct(*pieces).alias("_limits")).scalar()


def bin_index(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the last bin is closed on the right, a constant column is bin 0."""
    width = (high - low) / F.lit(bins)
    return F.when(width > 0, F.least(F.floor((x - low) / width), F.lit(bins - 1).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def axis_values(df: DataFrame, column: str) -> Column:
    """Sorted distinct values of a chart axis as one array."""
    return df.select(column).distinct().agg(F.array_sort(F.collect_list(column)).alias("_axis")).scalar()


def with_place(df: DataFrame, column: str, out: str = "_place") -> DataFrame:
    """Add a number that rises with `column`, so that its order can be cut into buckets.

    Numbers stand for themselves; of any other value the first six bytes of its text do, and
    equal places are told apart by the column itself.
    """
    if isinstance(df.schema[column].dataType, T.NumericType):
        return df.withColumn(out, F.col(column).cast("double"))
    head = F.hex(F.substring(F.col(column).cast("string").cast("binary"), 1, 6))
    return df.withColumn(out, F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double"))


def running_by_category(df: DataFrame, by: Sequence[str], column: str, value: str, out: str) -> DataFrame:
    """Inclusive running sum of `value` in the order of a category, without one task for the whole axis."""
    placed = with_place(df, column)
    return running(placed, by, ["_place", column], {out: F.col(value)}, split_points(placed, "_place")).drop("_place")

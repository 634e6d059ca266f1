"""Distributions: histogram, density, ECDF, quantiles, box statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark.operators.charts.common import bin_index, finite, limits
from chartspark.operators.ordering import (
    join_groups, join_spread, quantiles, quantiles_long, ranked_values, top_by_draw, value_counts,
)
from chartspark.operators.sampling import DRAW_RANGE, draw, uniform


def histogram(df: DataFrame, x: str, bins: int, hue: str | None = None) -> DataFrame:
    """Counts in equal bins between the smallest and largest value; empty bins are kept."""
    rows = finite(df, x)
    ends = limits(rows, x)
    low, high = ends[f"min_{x}"], ends[f"max_{x}"]
    keys = ["bin"] if hue is None else [hue, "bin"]
    counts = rows.withColumn("bin", bin_index(F.col(x).cast("double"), low, high, bins)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count")
    )
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin")
    groups = counts.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 0) if hue is None else counts.select(hue).distinct()
    spine = groups.select(*[k for k in keys if k != "bin"], every)
    width = (high - low) / F.lit(bins)
    return join_groups(spine, counts, keys, "left").select(
        *keys, (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


#: Bandwidths within which a kernel counts: exp(-9² / 2) is a hundredth of the spacing of doubles at 1.
REACH = 9.0


def density(df: DataFrame, x: str, grid: int = 64, by: str | None = None) -> DataFrame:
    """Gaussian kernel density on `grid` points per group; bandwidth sd·n^(-1/5).

    Equal values are counted once. A value meets only the grid points within REACH bandwidths of it, beyond which the kernel
    is lost in double precision: with a narrow bandwidth a value makes a few rows, however fine the grid is. They are made inside its
    own task and the sums are combined there, so the shuffle carries one row per task and grid point.
    """
    rows = finite(df, x).withColumn("_g", F.lit(0) if by is None else F.col(by))
    stats = rows.groupBy("_g").agg(
        F.count(F.lit(1)).alias("_count"), F.stddev_samp(F.col(x).cast("double")).alias("_sd"),
        F.min(F.col(x).cast("double")).alias("_low"), F.max(F.col(x).cast("double")).alias("_high"),
    ).withColumn("_h", F.col("_sd") * F.pow(F.col("_count"), F.lit(-0.2))).where(F.col("_h") > 0)
    step = (F.col("_high") - F.col("_low")) / F.lit(grid - 1)
    weighted = join_spread(value_counts(rows, ["_g"], x), stats, ["_g"])
    first = F.greatest(F.lit(0), F.ceil((F.col("_x") - REACH * F.col("_h") - F.col("_low")) / step)).cast("int")
    last = F.least(F.lit(grid - 1), F.floor((F.col("_x") + REACH * F.col("_h") - F.col("_low")) / step)).cast("int")
    near = weighted.withColumns({"_first": first, "_last": last}).where(F.col("_first") <= F.col("_last"))
    near = near.withColumn("point", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    # A point that no value is near to has density 0.
    spine = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point")).withColumns({"_x": F.col("_low"), "_n": F.lit(0).cast("long")})
    spread = near.unionByName(spine, allowMissingColumns=True)
    at = F.col("_low") + F.col("point") * (F.col("_high") - F.col("_low")) / F.lit(grid - 1)
    u = (at - F.col("_x")) / F.col("_h")
    sums = spread.groupBy("_g", "point").agg(
        F.max(at).alias("x"),
        (F.sum(F.col("_n") * F.exp(-u * u / 2)) / (F.max("_count") * F.max("_h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"),
    )
    named = [] if by is None else [F.col("_g").alias(by)]
    return sums.select(*named, "point", "x", "density")


def ecdf(df: DataFrame, x: str, by: str | None = None) -> DataFrame:
    """Share of values up to each distinct value."""
    keys = [] if by is None else [by]
    ranked = ranked_values(df, keys, x)
    return ranked.select(*keys, F.col("_x").alias("x"), (F.col("_c") / F.col("_c_total")).alias("share"))


def qq(df: DataFrame, x: str, by: str, a: object, b: object, n: int = 50) -> DataFrame:
    """Matching quantiles of two groups at n evenly spaced probabilities."""
    points = [(i + 0.5) / n for i in range(n)]
    long = quantiles_long(df.where(F.col(by).isin(a, b)), x, [by], points)
    return long.groupBy("p").agg(
        F.max(F.when(F.col(by) == a, F.col("q"))).alias("q_a"), F.max(F.when(F.col(by) == b, F.col("q"))).alias("q_b")
    )


def box_stats(df: DataFrame, y: str, by: str, whis: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at `whis` interquartile ranges clipped to the data, and outliers.

    Whiskers and outliers are read off the distinct values that the quartiles came from.
    """
    quartiles = quantiles(df, y, [by], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    spread = F.lit(whis) * (F.col("q3") - F.col("q1"))
    fenced = quartiles.withColumns({"_low": F.col("q1") - spread, "_high": F.col("q3") + spread})
    values = join_spread(value_counts(df, [by], y), fenced, [by])
    inside = F.col("_x").between(F.col("_low"), F.col("_high"))
    return values.groupBy(by).agg(
        F.sum("_n").alias("n"),
        *[F.max(q).alias(q) for q in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("_n"))).alias("outliers"),
    )


def error_bar(df: DataFrame, y: str, by: str) -> DataFrame:
    """Mean, deviation, standard error and the 95% interval per group."""
    stats = df.groupBy(by).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"))
    with_sem = stats.withColumn("sem", F.col("sd") / F.sqrt("n"))
    return with_sem.withColumns({"low": F.col("mean") - 1.96 * F.col("sem"), "high": F.col("mean") + 1.96 * F.col("sem")})


def sample_points(df: DataFrame, key: str, columns: Sequence[str], n: int, by: str | None = None, seed: int = 42) -> DataFrame:
    """At most n rows per group, drawn by hash of `key`, with a repeatable jitter in [-0.5, 0.5)."""
    keys = [] if by is None else [by]
    slim = df.select(*dict.fromkeys([key, *columns, *keys])).withColumn("_draw", draw(seed, F.col(key)))
    kept = top_by_draw(slim, keys, "_draw", DRAW_RANGE, n)
    return kept.drop("_draw").withColumn("jitter", uniform(f"{seed}-jitter", F.col(key)) - 0.5)


def raincloud(df: DataFrame, key: str, y: str, by: str, n: int = 100, grid: int = 64) -> DataFrame:
    """Density, box statistics and sampled points of each group in one long table."""
    name = F.col(by).cast("string").alias("group")
    cloud = density(df, y, grid, by).select(
        name, F.lit("density").alias("part"), F.concat(F.lit("p"), F.col("point").cast("string")).alias("item"),
        F.col("x").alias("x"), F.col("density").alias("y"),
    )
    boxes = box_stats(df, y, by)
    lines = ("q1", "median", "q3", "whisker_low", "whisker_high")
    box = boxes.select(name, F.lit("box").alias("part"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("item"), F.col(c).alias("x"), F.lit(None).cast("double").alias("y")) for c in lines
    ])))
    rain = sample_points(df, key, [y], n, by).select(
        name, F.lit("rain").alias("part"), F.col(key).cast("string").alias("item"), F.col(y).cast("double").alias("x"), F.col("jitter").alias("y")
    )
    return cloud.unionByName(box).unionByName(rain)


def drop_outliers(df: DataFrame, x: str, method: str = "iqr", limit: float | None = None) -> DataFrame:
    """Rows within `limit` interquartile ranges (1.5) of the quartiles, or deviations (3) of the mean."""
    if method == "iqr":
        reach = F.lit(1.5 if limit is None else limit)
        q = quantiles(df, x, [], {"q1": 0.25, "q3": 0.75}).select(F.struct("q1", "q3").alias("s")).scalar()
        spread = reach * (q["q3"] - q["q1"])
        return df.where(F.col(x).between(q["q1"] - spread, q["q3"] + spread))
    if method == "zscore":
        m = df.agg(F.struct(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")).alias("s")).scalar()
        return df.where(F.abs(F.col(x) - m["mean"]) <= F.lit(3.0 if limit is None else limit) * m["sd"])
    raise ValueError(f"unknown method {method}")

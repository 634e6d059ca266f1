"""Relations between numeric columns, panels and transformations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.operators.charts.axes import leading_axes
from chartspark.operators.charts.bars import top_or_other
from chartspark.operators.charts.common import finite, limits
from chartspark.operators.ordering import join_groups, join_measured, ranked_desc

#: Widest vectors whose scatter matrix (8 MB) is gathered in one pass.
GRAM_DIMENSIONS = 1024


def bubble(df: DataFrame, entity: str, x: str, y: str, size: str) -> DataFrame:
    """One bubble per entity: mean position and summed size."""
    return df.groupBy(entity).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.sum(size).alias("size"))


def regression(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """Least-squares line per group: slope, intercept, r² and the number of points."""
    fits = [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n")]
    return df.agg(*fits) if by is None else df.groupBy(by).agg(*fits)


def residuals(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """Each row with its fitted value and residual."""
    fitted = regression(df, x, y, by)
    if by is None:
        line = fitted.select(F.struct("slope", "intercept").alias("s")).scalar()
        out = df.withColumn("fitted", line["intercept"] + line["slope"] * F.col(x))
    else:
        out = join_measured(df, fitted.select(by, "slope", "intercept"), [by])
        out = out.withColumn("fitted", F.col("intercept") + F.col("slope") * F.col(x)).drop("slope", "intercept")
    return out.withColumn("residual", F.col(y) - F.col("fitted"))


def parallel_coordinates(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Columns scaled to [0, 1] over the whole table; a constant column is 0."""
    ends = limits(df, *columns)

    def scaled(c: str) -> Column:
        low, high = ends[f"min_{c}"], ends[f"max_{c}"]
        return F.when(high > low, (F.col(c) - low) / (high - low)).when(F.col(c).isNotNull(), F.lit(0.0))

    return df.select(key, *[scaled(c).alias(c) for c in columns])


def radar(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Mean of each column per group, and that mean relative to the largest one of the column."""
    means = df.groupBy(by).agg(*[F.avg(c).alias(c) for c in columns])
    top = means.agg(F.struct(*[F.max(c).alias(c) for c in columns]).alias("s")).scalar()
    axes = [F.struct(F.lit(c).alias("axis"), F.col(c).alias("value"), F.try_divide(F.col(c), top[c]).alias("scaled")) for c in columns]
    return means.select(by, F.inline(F.array(*axes)))


def projection(df: DataFrame, key: str, vector: str, k: int, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """First k principal components of an array column: (scores per row, loadings).

    Vectors are centred first. The sign of a component makes its largest loading positive. Up to `GRAM_DIMENSIONS` dimensions one
    pass gathers the whole scatter matrix, 8 MB at most. Wider vectors, or any with a `block` width, go through `leading_axes`,
    which reads the rows once a round and never holds that matrix; give it a stored table, not a costly plan.
    """
    rows = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    scaler = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(rows)
    centred, dimension = scaler.transform(rows), scaler.mean.size
    if block is None and dimension <= GRAM_DIMENSIONS:
        model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
        axes = model.pc.toArray()
        placed = model.transform(centred).select(key, vector_to_array("_p").alias("_p"))
    else:
        centred = centred.select(key, vector_to_array("_c").alias("_c"))
        axes = leading_axes(centred, "_c", dimension, k, block)
        placed = centred.select(key, _products(axes)("_c").alias("_p"))
    signs = [1.0 if axes[abs(axes[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    scores = placed.select(key, *[(F.col("_p")[j] * signs[j]).alias(f"pc{j + 1}") for j in range(k)])
    spark = df.sparkSession
    loadings = spark.createDataFrame(
        [(i, *[float(axes[i, j]) * signs[j] for j in range(k)]) for i in range(axes.shape[0])],
        "dimension int, " + ", ".join(f"pc{j + 1} double" for j in range(k)),
    )
    return scores, loadings


def _products(axes: np.ndarray) -> Callable[[str], Column]:
    """Function of an array column: its products with every axis."""

    @F.pandas_udf("array<double>")
    def products(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(vectors) @ axes)) if len(vectors) else pd.Series([], dtype=object)

    return products


def facet(df: DataFrame, by: str, x: str, y: str, max_panels: int = 25) -> DataFrame:
    """Rows with their panel in a grid of at most `max_panels`, and shared axis limits.

    With more groups than panels the smallest ones share the last panel, "Other".
    """
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    groups = counts.agg(F.count(F.lit(1)).alias("n")).scalar()
    labelled = top_or_other(counts, by, "_n", max_panels - 1, "_top")
    whole = top_or_other(counts, by, "_n", max_panels, "_all").select(by, "_all")
    panels = join_groups(labelled, whole, [by]).select(by, F.when(groups <= max_panels, F.col("_all")).otherwise(F.col("_top")).alias("panel"))
    ends = limits(finite(df, x, y), x, y)
    return join_groups(df, panels, [by]).select(
        "panel", by, x, y, ends[f"min_{x}"].alias("x_low"), ends[f"max_{x}"].alias("x_high"),
        ends[f"min_{y}"].alias("y_low"), ends[f"max_{y}"].alias("y_high"),
    )


def transform(df: DataFrame, x: str, kind: str, out: str | None = None, value: str | None = None) -> DataFrame:
    """Add a derived column: log, log1p, zscore, month, weekday, or `order` (place of a category by mean `value`)."""
    out = out or f"{x}_{kind}"
    column = F.col(x)
    if kind == "log":
        return df.withColumn(out, F.when(column > 0, F.log(column)))
    if kind == "log1p":
        return df.withColumn(out, F.when(column > -1, F.log1p(column)))
    if kind == "zscore":
        m = df.agg(F.struct(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")).alias("s")).scalar()
        return df.withColumn(out, F.try_divide(column - m["mean"], m["sd"]))
    if kind == "month":
        return df.withColumn(out, F.month(column))
    if kind == "weekday":
        return df.withColumn(out, F.weekday(column))
    if kind == "order":
        means = df.groupBy(x).agg(F.avg(value).alias("_mean"))
        return join_groups(df, ranked_desc(means, [], "_mean", out).drop("_mean"), [x])
    raise ValueError(f"unknown transformation {kind}")

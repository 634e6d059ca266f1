"""Two-dimensional grids and matrices."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.operators.charts.common import aggregated, axis_values, bin_index, finite, limits, with_share
from chartspark.operators.ordering import join_groups


def _cells(df: DataFrame, x: str, y: str, bins_x: int, bins_y: int) -> DataFrame:
    rows = finite(df, x, y)
    ends = limits(rows, x, y)
    return rows.withColumns({
        "bin_x": bin_index(F.col(x).cast("double"), ends[f"min_{x}"], ends[f"max_{x}"], bins_x),
        "bin_y": bin_index(F.col(y).cast("double"), ends[f"min_{y}"], ends[f"max_{y}"], bins_y),
    })


def hist2d(df: DataFrame, x: str, y: str, bins_x: int, bins_y: int, z: str | None = None) -> DataFrame:
    """Count per grid cell, and the mean of `z`; cells without rows are left out."""
    measures = [F.count(F.lit(1)).alias("count")] + ([F.avg(z).alias("mean_z")] if z else [])
    return _cells(df, x, y, bins_x, bins_y).groupBy("bin_x", "bin_y").agg(*measures)


def quiver(df: DataFrame, x: str, y: str, dx: str, dy: str, bins: int) -> DataFrame:
    """Mean arrow per grid cell."""
    return _cells(df, x, y, bins, bins).groupBy("bin_x", "bin_y").agg(
        F.avg(dx).alias("dx"), F.avg(dy).alias("dy"), F.count(F.lit(1)).alias("count")
    )


def hexbin(df: DataFrame, x: str, y: str, gridsize: int) -> DataFrame:
    """Count per hexagon: two offset lattices, each point goes to the nearer centre."""
    rows = finite(df, x, y)
    ends = limits(rows, x, y)
    nx, ny = gridsize, max(int(gridsize / math.sqrt(3)), 1)
    low_x, low_y = ends[f"min_{x}"], ends[f"min_{y}"]
    step_x = F.nullif((ends[f"max_{x}"] - low_x) / F.lit(nx), F.lit(0.0))
    step_y = F.nullif((ends[f"max_{y}"] - low_y) / F.lit(ny), F.lit(0.0))
    placed = rows.select(
        F.coalesce((F.col(x) - low_x) / step_x, F.lit(0.0)).alias("_ix"),
        F.coalesce((F.col(y) - low_y) / step_y, F.lit(0.0)).alias("_iy"),
        F.coalesce(step_x, F.lit(0.0)).alias("_sx"), F.coalesce(step_y, F.lit(0.0)).alias("_sy"),
    )

    def distance(cx: Column, cy: Column) -> Column:
        return F.pow(F.col("_ix") - cx, 2) + 3 * F.pow(F.col("_iy") - cy, 2)

    ax, ay = F.floor(F.col("_ix") + 0.5).cast("double"), F.floor(F.col("_iy") + 0.5).cast("double")
    bx, by = F.floor("_ix") + 0.5, F.floor("_iy") + 0.5
    nearer = distance(ax, ay) < distance(bx, by)
    cells = placed.select(F.when(nearer, ax).otherwise(bx).alias("hex_x"), F.when(nearer, ay).otherwise(by).alias("hex_y"), "_sx", "_sy")
    return cells.groupBy("hex_x", "hex_y").agg(
        F.count(F.lit(1)).alias("count"),
        F.max(low_x + F.col("hex_x") * F.col("_sx")).alias("x"), F.max(low_y + F.col("hex_y") * F.col("_sy")).alias("y"),
    )


def heatmap(df: DataFrame, row: str, col: str, y: str | None = None, agg: str = "count", fill: bool = True) -> DataFrame:
    """`agg` over two categories in long form; with `fill`, cells without rows are 0."""
    cells = aggregated(df, [row, col], y, agg)
    if not fill:
        return cells
    grid = cells.select(row).distinct().select(row, F.explode(axis_values(cells, col)).alias(col))
    return join_groups(grid, cells, [row, col], "left").select(row, col, F.coalesce("value", F.lit(0)).alias("value"))


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one pass over the table."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for a, b in pairs:
        r = F.col(f"`{a}|{b}`")
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), r.alias("r")))
    return wide.select(F.inline(F.array(*cells)))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Count per (actual, predicted) and its share of the actual class."""
    return with_share(aggregated(df, [actual, predicted], out="count"), [actual], "count", "row_share")


def scatter_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Points of every pair of columns in long form; the pairs are fixed by the arguments."""
    panels = [
        F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for i, a in enumerate(columns) for b in columns[i + 1:]
    ]
    return df.select(F.inline(F.array(*panels)))


def sequence_logo(df: DataFrame, text: str) -> DataFrame:
    """Frequency of each symbol per position, and the information content of the position in bits."""
    letters = df.select(F.posexplode(F.split(text, "")).alias("pos", "symbol")).where(F.col("symbol") != "")
    counts = letters.groupBy("pos", "symbol").agg(F.count(F.lit(1)).alias("count"))
    shares = with_share(counts, ["pos"], "count", "frequency")
    alphabet = counts.agg(F.count_distinct("symbol").alias("n")).scalar()
    entropy = shares.groupBy("pos").agg(F.sum(-F.col("frequency") * F.log2("frequency")).alias("_entropy"))
    joined = join_groups(shares, entropy, ["pos"])
    bits = F.log2(alphabet.cast("double")) - F.col("_entropy")
    return joined.select("pos", "symbol", "count", "frequency", bits.alias("information"), (F.col("frequency") * bits).alias("height"))

"""Table profile and the chart families that a table can fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspark.operators.ordering import join_groups, quantiles
from chartspark.sources.changes import refresh_folder

TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def columns_of(df: DataFrame) -> dict[str, list[str]]:
    """Column names by kind: numeric, time, category."""
    kinds: dict[str, list[str]] = {"numeric": [], "time": [], "category": []}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.NumericType):
            kinds["numeric"].append(field.name)
        elif isinstance(field.dataType, TEMPORAL):
            kinds["time"].append(field.name)
        elif isinstance(field.dataType, (T.StringType, T.BooleanType)):
            kinds["category"].append(field.name)
    return kinds


def _long(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells)))


def numeric_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Rows, missing, extremes, moments and quartiles of every numeric column.

    Counts and moments come from one aggregation of the table as it is; only the quartiles
    need one row per column and value. NaN counts as a row, and enters neither extremes,
    moments nor quartiles.
    """
    numeric = columns_of(df)["numeric"]
    measures = []
    for c in numeric:
        given = F.col(f"`{c}`").cast("double")
        value = F.nanvl(given, F.lit(None).cast("double"))
        measures.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(given.isNull()).alias("missing"),
            F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        ))
    moments = df.agg(F.array(*measures).alias("_m")).select(F.inline("_m"))
    quartiles = quantiles(_long(df, numeric, "double"), "value", ["column"], {"q1": 0.25, "median": 0.5, "q3": 0.75}, exact)
    return join_groups(moments, quartiles, ["column"], "left")


#: Size of a stored quantile sketch: ranks are right within about 0.4 % of the rows.
KLL = 800


def profile_states(df: DataFrame, by: str = "file") -> DataFrame:
    """One row per value of `by` and column, which `merged_profile` and `merged_categories` add up.

    Counts, extremes, mean and sum of squared distances to it are exact; quantiles and distinct
    values are bounded sketches, so a state has the same size whatever it describes. NaN counts
    as a row only, as in `numeric_profile`.
    """
    kinds = columns_of(df.drop(by))
    cells = []
    for c in kinds["numeric"]:
        given = F.col(f"`{c}`").cast("double")
        value = F.nanvl(given, F.lit(None).cast("double"))
        n = F.count(value)
        cells.append(F.struct(
            F.lit(c).alias("column"), F.lit("numeric").alias("kind"), F.count(F.lit(1)).alias("rows"), F.count_if(given.isNull()).alias("missing"),
            n.alias("values"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), (F.var_pop(value) * n).alias("squares"),
            F.when(n > 0, F.kll_sketch_agg_double(value, F.lit(KLL))).alias("quantiles"), F.lit(None).cast("binary").alias("distinct")))
    for c in kinds["category"]:
        given = F.col(f"`{c}`").cast("string")
        nothing = [F.lit(None).cast("double").alias(name) for name in ("min", "max", "mean", "squares")]
        cells.append(F.struct(
            F.lit(c).alias("column"), F.lit("category").alias("kind"), F.count(F.lit(1)).alias("rows"), F.count_if(given.isNull()).alias("missing"),
            F.count(given).alias("values"), *nothing, F.lit(None).cast("binary").alias("quantiles"), F.hll_sketch_agg(given).alias("distinct")))
    if not cells:
        raise ValueError("no numeric or categorical column")
    return df.groupBy(by).agg(F.array(*cells).alias("_cells")).select(by, F.inline("_cells"))


def merged_profile(states: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """`numeric_profile` of all that the states describe, without reading it again.

    Squared distances are moved to the common mean, not differenced from a sum of squares. The
    quartiles come from the merged sketches; give the table as `rows` to have them exact.
    """
    numeric = states.where("kind = 'numeric'")
    whole = numeric.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.sum("values").alias("_n"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.try_divide(F.sum(F.col("values") * F.col("mean")), F.sum("values")).alias("mean"), F.kll_merge_agg_double("quantiles").alias("_sketch"))
    apart = join_groups(numeric.select("column", "values", "squares", F.col("mean").alias("_own")), whole.select("column", F.col("mean").alias("_all")), ["column"])
    spread = apart.groupBy("column").agg(F.sum(F.col("squares") + F.col("values") * F.pow(F.col("_own") - F.col("_all"), 2)).alias("_squares"))
    sd = F.when(F.col("_n") > 1, F.sqrt(F.col("_squares") / (F.col("_n") - 1))).alias("sd")
    merged = join_groups(whole, spread, ["column"])
    measured = ["column", "rows", "missing", "min", "max", "mean", sd]
    named = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    if rows is None:
        sketched = [F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(p))).alias(name) for name, p in named.items()]
        return merged.select(*measured, *sketched)
    return join_groups(merged.select(*measured), quantiles(_long(rows, columns_of(rows)["numeric"], "double"), "value", ["column"], named), ["column"], "left")


def merged_categories(states: DataFrame) -> DataFrame:
    """Rows, missing and about how many distinct values every categorical column has in all that the states describe."""
    return states.where("kind = 'category'").groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("about_distinct"))


def refresh_profile(spark: SparkSession, folder: str, before: str | None, after: str, read: Callable[[list[str]], DataFrame]) -> list[str]:
    """Write the profile states of every file of `folder` to `after`/counts, reading only what changed since `before`.

    `read(paths)` returns the rows of these files with `file`, as in `_metadata.file_path`. States
    of other files are carried over, those of gone files dropped. Returns the paths read.
    """
    return refresh_folder(spark, folder, before, after, lambda paths: profile_states(read(paths)))


def _value_counts(df: DataFrame) -> DataFrame:
    return _long(df, columns_of(df)["category"], "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))


def categorical_profile(df: DataFrame) -> DataFrame:
    """Rows, missing and exact number of distinct values of every categorical column."""
    return _value_counts(df).groupBy("column").agg(
        F.sum("rows").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("rows"))), F.lit(0)).alias("missing"),
        F.count("value").alias("distinct_values"),
    )


def top_categories(df: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values of every categorical column; each task keeps its own k before the shuffle."""
    order = Window.partitionBy("column").orderBy(F.desc("rows"), "value")
    counted = _value_counts(df).where(F.col("value").isNotNull())
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


# Fixed values of this library: most categories that a family can show.
FEW, MANY = 10, 50


def suggest(df: DataFrame) -> DataFrame:
    """Chart families that the table can fill, with the columns for x, y and hue, joined by commas.

    One pass: a bounded sketch counts the values of each categorical column, and the extremes
    tell whether a numeric one varies. The rules read the single row that is left.
    """
    kinds = columns_of(df)
    numeric, time, category = kinds["numeric"], kinds["time"], kinds["category"]
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.hll_sketch_estimate(F.hll_sketch_agg(F.col(f"`{c}`").cast("string"))).alias(c) for c in category],
        *[F.when(F.max(f"`{c}`") > F.min(f"`{c}`"), 2).otherwise(1).alias(c) for c in numeric],
    )

    def named(columns: list[str], test=lambda n: n >= 1) -> Column:
        kept = [F.when(test(F.col(f"`{c}`")), F.lit(c)) for c in columns]
        return F.array_compact(F.array(*kept)) if kept else F.array().cast("array<string>")

    varied = named(numeric, lambda n: n >= 2)
    few = named(category, lambda n: n.between(2, FEW))
    many = named(category, lambda n: n.between(2, MANY))
    times = F.array(*[F.lit(c) for c in time]) if time else F.array().cast("array<string>")
    nothing = F.array().cast("array<string>")

    def row(family: str, ok: Column, x: Column, y: Column, hue: Column) -> Column:
        return F.struct(
            F.lit(family).alias("family"), ok.alias("_ok"), F.array_join(x, ",").alias("x"),
            F.array_join(y, ",").alias("y"), F.array_join(hue, ",").alias("hue"),
        )

    def some(columns: Column, n: int = 1) -> Column:
        return F.size(columns) >= n

    rules = [
        row("Histogram", some(varied), varied, nothing, few),
        row("Density Plot", some(varied), varied, nothing, few),
        row("Distribution Summary", some(varied), varied, nothing, few),
        row("Box / Violin", some(varied) & some(many), many, varied, few),
        row("Error Bar", some(varied) & some(many), many, varied, nothing),
        row("Bar Chart", some(many), many, varied, few),
        row("Pie / Donut", some(few), few, nothing, nothing),
        row("Set / Composition", some(few, 2), few, nothing, few),
        row("Heatmap", some(varied, 2) | some(many, 2), F.when(some(many, 2), many).otherwise(varied), F.when(some(many, 2), many).otherwise(varied), nothing),
        row("Scatter Plot", some(varied, 2), varied, varied, few),
        row("Hexbin", some(varied, 2), varied, varied, nothing),
        row("Bubble Chart", some(varied, 3), varied, varied, few),
        row("Scatter Matrix", some(varied, 3), varied, varied, few),
        row("Parallel Coordinates", some(varied, 3), varied, nothing, few),
        row("Projection Plot", some(varied, 3), varied, nothing, few),
        row("Radar Chart", some(varied, 3) & some(few), varied, nothing, few),
        row("Line / Area", some(times) & some(varied), times, varied, few),
        row("Faceted Plot", some(varied, 2) & some(many), varied, varied, many),
    ]
    return counted.select(F.inline(F.array(*rules))).where("_ok").drop("_ok")

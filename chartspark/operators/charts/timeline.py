"""Charts over time or over an ordered axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspark.operators.charts.common import aggregated, running_by_category
from chartspark.operators.ordering import join_groups, ranked_desc, running, split_points

STEP = {"year": "interval 1 year", "quarter": "interval 3 month", "month": "interval 1 month", "week": "interval 7 day",
        "day": "interval 1 day", "hour": "interval 1 hour", "minute": "interval 1 minute"}


def line(df: DataFrame, t: str, y: str | None, agg: str, unit: str, hue: str | None = None, fill: bool = False) -> DataFrame:
    """`agg` of `y` per time bucket (and hue); with `fill`, empty buckets of the range appear with null."""
    keys = ["bucket"] if hue is None else ["bucket", hue]
    bucket = F.date_trunc(unit, F.col(t)).cast(df.schema[t].dataType)
    points = aggregated(df.withColumn("bucket", bucket).where(F.col("bucket").isNotNull()), keys, y, agg)
    if not fill:
        return points
    span = points.agg(F.struct(F.min("bucket").alias("low"), F.max("bucket").alias("high")).alias("s"))
    buckets = F.explode(F.sequence(F.col("s.low"), F.col("s.high"), F.expr(STEP[unit])))
    if hue is None:
        spine = span.select(buckets.alias("bucket"))
    else:
        whole = span.scalar()
        ends = F.sequence(whole["low"], whole["high"], F.expr(STEP[unit]))
        spine = points.select(hue).distinct().select(hue, F.explode(ends).alias("bucket"))
    return join_groups(spine, points, keys, "left").select(*keys, "value")


def streamgraph(df: DataFrame, t: str, hue: str, y: str | None, unit: str) -> DataFrame:
    """Layers per time bucket: `y0` and `y1` stacked in order of hue."""
    points = line(df, t, y, "count" if y is None else "sum", unit, hue)
    top = running_by_category(points, ["bucket"], hue, "value", "y1")
    return top.select("bucket", hue, "value", (F.col("y1") - F.col("value")).alias("y0"), "y1")


def bump(df: DataFrame, period: str, entity: str, y: str | None = None, agg: str | None = None) -> DataFrame:
    """Value and rank of each entity per period, largest first; equal values share a rank."""
    scored = aggregated(df, [period, entity], y, agg or ("count" if y is None else "sum"))
    return ranked_desc(scored, [period], "value")


def _number(df: DataFrame, column: str) -> Column | None:
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        return F.col(column).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        since = F.col(column).cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
        return since.cast("interval second").cast("decimal(24,6)").cast("double")
    return None


def waterfall(df: DataFrame, step: str, y: str) -> DataFrame:
    """Change per step with the level before (`start`) and after (`end`)."""
    deltas = df.groupBy(step).agg(F.sum(y).alias("delta"))
    place = _number(deltas, step)
    if place is None:
        levels = running_by_category(deltas, [], step, "delta", "end")
    else:
        placed = deltas.withColumn("_place", place)
        levels = running(placed, [], ["_place"], {"end": F.col("delta")}, split_points(placed, "_place")).drop("_place")
    return levels.select(step, "delta", (F.col("end") - F.col("delta")).alias("start"), "end")

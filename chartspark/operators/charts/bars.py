"""Bars, shares and hierarchies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartspark.operators.charts.common import aggregated, running_by_category, with_share
from chartspark.operators.ordering import join_groups, join_spread

OTHER = "Other"


def bar(df: DataFrame, x: str, y: str | None = None, agg: str = "count") -> DataFrame:
    """One bar per category, tallest first."""
    return aggregated(df, [x], y, agg).orderBy(F.desc("value"), x)


def stacked_bar(df: DataFrame, x: str, hue: str, y: str | None = None, agg: str = "count") -> DataFrame:
    """Value per category and hue, and its share within the category."""
    return with_share(aggregated(df, [x, hue], y, agg), [x])


def top_or_other(counted: DataFrame, x: str, value: str, top: int, out: str) -> DataFrame:
    """Label the `top` largest categories by name and all others as "Other"."""
    first = counted.orderBy(F.desc(value), x).limit(top).select(x, F.col(x).cast("string").alias(out))
    return join_groups(counted, first, [x], "left").withColumn(out, F.coalesce(out, F.lit(OTHER)))


def pie(df: DataFrame, x: str, y: str | None = None, top: int | None = None) -> DataFrame:
    """Slices with their share; beyond the `top` largest all are merged to "Other"."""
    counted = aggregated(df, [x], y, "count" if y is None else "sum")
    if top is None:
        sliced = counted.select(F.col(x).cast("string").alias("slice"), "value")
    else:
        labelled = top_or_other(counted, x, "value", top, "slice")
        sliced = labelled.groupBy("slice").agg(F.sum("value").alias("value"))
    return with_share(sliced, [])


def hierarchy(df: DataFrame, levels: Sequence[str], y: str | None = None) -> DataFrame:
    """Value of every node of a hierarchy; `depth` 0 is the root.

    The finest level is summed first; the rollup then expands that short table only.
    """
    leaves = aggregated(df, levels, y, "count" if y is None else "sum")
    rolled = leaves.rollup(*levels).agg(F.sum("value").alias("value"), F.grouping_id().alias("_gid"))
    depth = F.lit(len(levels)) - F.bit_count("_gid")
    return rolled.select(*levels, depth.cast("int").alias("depth"), "value")


def mosaic(df: DataFrame, x: str, hue: str, y: str | None = None) -> DataFrame:
    """Tiles: width is the share of `x`, height the share of `hue` within it, with offsets."""
    tiles = aggregated(df, [x, hue], y, "count" if y is None else "sum")
    cells = with_share(tiles, [x], out="height")
    columns = with_share(cells.groupBy(x).agg(F.sum("value").alias("_sum")), [], "_sum", "width").drop("_sum")
    placed = running_by_category(columns, [], x, "width", "_to").withColumn("x0", F.col("_to") - F.col("width"))
    stacked = running_by_category(cells, [x], hue, "height", "_up").withColumn("y0", F.col("_up") - F.col("height"))
    return join_groups(stacked, placed, [x]).select(x, hue, "value", "x0", "width", "y0", "height")


def waffle(df: DataFrame, x: str, cells: int = 100) -> DataFrame:
    """Cells per category by largest remainder; they sum to `cells`."""
    counted = aggregated(df, [x])
    total = counted.agg(F.sum("value").alias("n")).scalar()
    scaled = F.col("value") * cells
    based = counted.withColumns({"_base": F.floor(scaled / total), "_left": scaled % total})
    spare = based.agg((F.lit(cells) - F.sum("_base")).alias("spare")).scalar()
    # Fewer cells are spare than a waffle has, so the ranked rows are at most `cells`.
    ranked = based.orderBy(F.desc("_left"), x).limit(cells).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_left"), x))
    )
    lucky = ranked.where(F.col("_rank") <= spare).select(x, F.lit(1).alias("_extra"))
    return join_groups(based, lucky, [x], "left").select(
        x, "value", (F.col("_base") + F.coalesce("_extra", F.lit(0))).cast("bigint").alias("cells")
    )


def funnel(df: DataFrame, user: str, event: str, ts: str, stages: Sequence[str]) -> DataFrame:
    """Users that reach each stage after the stage before, with step and total conversion.

    Per stage one join on the user: the earliest event of the stage later than the moment
    the user reached the previous one.
    """
    reached = None
    counts = []
    for i, stage in enumerate(stages):
        here = df.where(F.col(event) == stage).select(F.col(user).alias("_user"), F.col(ts).alias("_ts"))
        if reached is not None:
            here = join_spread(here, reached.withColumnRenamed("_at", "_before"), ["_user"]).where(F.col("_ts") > F.col("_before"))
        reached = here.groupBy("_user").agg(F.min("_ts").alias("_at"))
        counts.append(reached.agg(F.count(F.lit(1)).alias("users")).select(F.lit(i).alias("step"), F.lit(stage).alias("stage"), "users"))
    steps = counts[0]
    for more in counts[1:]:
        steps = steps.unionByName(more)
    # One row per stage is left.
    order = Window.partitionBy(F.lit(0)).orderBy("step")
    return steps.withColumns({
        "step_rate": F.try_divide("users", F.lag("users").over(order)).cast("double"),
        "total_rate": F.try_divide("users", F.first("users").over(order)).cast("double"),
    })


def gantt(df: DataFrame, task: str, ts: str) -> DataFrame:
    """Start, end and duration in seconds per task."""
    spans = df.groupBy(task).agg(F.min(ts).alias("start"), F.max(ts).alias("end"))
    lasted = (F.col("end") - F.col("start")).cast("interval day to second").cast("interval second")
    return spans.withColumn("seconds", lasted.cast("decimal(24,6)").cast("double"))


def upset(df: DataFrame, entity: str, member: str) -> DataFrame:
    """Number of entities for each exact combination of members.

    A combination is told by its number of members and two sums of their hashes, which do not depend on the order and are combined inside the
    tasks, so an entity with very many members is never one row. Members are listed once for each combination, from its smallest
    entity. Null members do not count; a null entity is one.
    """
    pairs = df.select(F.col(entity).alias("e"), F.col(member).alias("m")).distinct()
    hashed = lambda salt: F.coalesce(F.bit_xor(F.when(F.col("m").isNotNull(), F.xxhash64("m", F.lit(salt)))), F.lit(0).cast("long"))
    prints = pairs.groupBy("e").agg(F.count("m").alias("degree"), hashed(1).alias("p"), hashed(2).alias("q"))
    combined = prints.groupBy("degree", "p", "q").agg(F.count(F.lit(1)).alias("entities"), F.min("e").alias("first"))
    listed = combined.join(pairs, F.col("first").eqNullSafe(F.col("e"))).groupBy("degree", "p", "q", "entities").agg(F.array_sort(F.collect_list("m")).alias("members"))
    return listed.select("members", "entities", F.col("degree").cast("int").alias("degree"))


def flow(df: DataFrame, source: str, target: str, y: str | None = None) -> DataFrame:
    """Weight of every edge."""
    return aggregated(df, [source, target], y, "count" if y is None else "sum", "weight")


def degrees(edges: DataFrame, source: str, target: str, weight: str = "weight") -> DataFrame:
    """Edges and weight that leave and enter each node."""
    out = edges.select(F.col(source).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col(weight).alias("ow"), F.lit(0).alias("iw"))
    into = edges.select(F.col(target).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).alias("ow"), F.col(weight).alias("iw"))
    return out.union(into).groupBy("node").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("ow").alias("out_weight"), F.sum("iw").alias("in_weight")
    )

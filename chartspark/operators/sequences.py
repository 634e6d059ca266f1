"""Refinement rounds of a chart, prompt prefixes, shards and ordered groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.functions.images import iteration
from chartspark.functions.text import strip
from chartspark.operators.ordering import positions, previous_row, running, split_points


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of every key in input order, kept before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return kept.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def iterations(images: DataFrame, block: int | None = None) -> DataFrame:
    """Images of a chart once per path, in order of iteration: `step`, label `it<step>`, `is_last`."""
    named = images.where(F.coalesce(F.col("path"), F.lit("")) != "")
    once = first_per_key(named, ["chart_id", "path"], "pos").withColumn("iteration", iteration(F.col("path")))
    placed = positions(once, ["chart_id"], ["iteration", "pos"], "step", block=block, total="_steps")
    return placed.withColumns({
        "label": F.concat(F.lit("it"), F.col("step").cast("string")), "is_last": F.col("step") == F.col("_steps") - 1,
    }).drop("_steps")


def refinement(images: DataFrame) -> DataFrame:
    """Rounds per chart, first round without feedback, and whether the last one has none."""
    clean = strip(F.coalesce("feedback", F.lit(""))) == ""
    return images.groupBy("chart_id").agg(
        F.count(F.lit(1)).alias("rounds"),
        F.min(F.when(clean, F.col("pos"))).alias("first_clean"),
        F.max_by(clean, F.col("pos")).alias("cleared"),
        F.count_if(~clean).alias("open_rounds"),
    )


def feedback_changes(images: DataFrame, block: int | None = None) -> DataFrame:
    """Per round: did feedback appear, clear or change against the round before."""
    clean = strip(F.coalesce("feedback", F.lit(""))) == ""
    rounds = images.select("chart_id", "pos", clean.alias("clean"), F.length("feedback").alias("chars"))
    seen = previous_row(rounds, ["chart_id"], ["pos"], ["clean", "chars"], block)
    return seen.select(
        "chart_id", "pos", "clean",
        (F.col("has_prev") & ~F.col("prev_clean") & F.col("clean")).alias("cleared_now"),
        (F.col("chars") - F.col("prev_chars")).cast("bigint").alias("chars_change"),
    )


def prefix_flags(rows: DataFrame, row: str = "row_id", keys: Sequence[str] = ("dataset_id", "image"), block: int | None = None,
                 splits: Sequence[float] | None = None) -> DataFrame:
    """`new_prefix`: the prompt prefix differs from the row before; true for the first row."""
    seen = previous_row(rows, [], [row], keys, block, splits)
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"prev_{key}"))
    return seen.select(*rows.columns, (~(F.col("has_prev") & same)).alias("new_prefix"))


def prefix_blocks(rows: DataFrame, row: str = "row_id", keys: Sequence[str] = ("dataset_id", "image"), block: int | None = None) -> DataFrame:
    """Number the runs of equal prefixes; the first row of a run warms the cache, the rest follow.

    The row index is measured once for all three steps.
    """
    splits = split_points(rows, row) if block is None else None
    flagged = prefix_flags(rows, row, keys, block, splits)
    numbered = running(flagged, [], [row], {"prefix_block": F.col("new_prefix").cast("int")}, splits, block)
    placed = positions(numbered, ["prefix_block"], [row], "place", splits, block)
    return placed.withColumn("warms_cache", F.col("place") == 0)


def group_lists(df: DataFrame, by: Sequence[str], order: str, item: Column, size: int = 1000, block: int | None = None) -> DataFrame:
    """Items of each group in input order, as lists of at most `size`, numbered by `part`.

    A group may hold a third of all rows, so its list never has to fit into one value: read
    the parts in turn.
    """
    placed = positions(df.withColumn("_item", item), by, [order], "_place", block=block)
    parts = placed.withColumn("part", F.floor(F.col("_place") / size))
    listed = parts.groupBy(*by, "part").agg(F.array_sort(F.collect_list(F.struct("_place", "_item"))).alias("_items"))
    return listed.select(*by, "part", F.transform("_items", lambda x: x["_item"]).alias("items"))


def union_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """All rows of all shards, in the order given; columns that a shard lacks are null."""
    whole = shards[0].withColumn("shard", F.lit(0))
    for number, shard in enumerate(shards[1:], 1):
        whole = whole.unionByName(shard.withColumn("shard", F.lit(number)), allowMissingColumns=True)
    return whole


def union_once(shards: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """`union_shards` with one row per key: the first by (shard, order)."""
    whole = union_shards(shards)
    rest = [c for c in whole.columns if c not in (key, "shard")]
    kept = whole.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("shard", order)).alias("_row"))
    return kept.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def feature_differences(expected: Column, columns: Column, used: Column, plotted: Column) -> Column:
    """struct(missing, extra): expected features the table lacks, plotted ones not declared as used."""
    return F.struct(F.array_except(expected, columns).alias("missing"), F.array_except(plotted, used).alias("extra"))

"""Column-level operators on whole tables, and the flat evaluation table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark.functions.images import last_image


def rename_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename by position; when the lengths differ the old names stay."""
    return df.toDF(*names) if len(names) == len(df.columns) else df


def add_renamed_copies(df: DataFrame, copies: Mapping[str, str]) -> DataFrame:
    """Add `new: raw` copies where `new` is absent and `raw` exists."""
    wanted = {new: F.col(raw) for new, raw in copies.items() if new not in df.columns and raw in df.columns}
    return df.withColumns(wanted) if wanted else df


def feature_schema(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row per column in table order: name, data type, target flag, non-null count."""
    counted = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    rows = [
        F.struct(F.lit(i).alias("pos"), F.lit(name).alias("name"), F.lit(kind).alias("data_type"),
                 F.lit(name == target).alias("is_target"), F.col(f"`{name}`").alias("n_values"))
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return counted.select(F.inline(F.array(*rows)))


def evaluation_rows(records: DataFrame) -> DataFrame:
    """One row per question with the context of its chart."""
    return records.select(
        F.col("id").alias("graph_id"),
        F.col("dataset.id").alias("dataset_id"),
        F.col("graph.type").alias("graph_type"),
        last_image(F.col("images"))["path"].alias("image"),
        F.col("dataset.description").alias("dataset_description"),
        F.posexplode("graph.questions").alias("pos", "question"),
    )

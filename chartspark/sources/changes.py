"""Recompute only what changed: file fingerprints and refreshed per-chart counts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.sources.readers import read_listing

FINGERPRINT = ("name", "length", "modified")


def changed_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose name, size or time is not in the stored fingerprint."""
    return current.join(stored.select(*FINGERPRINT), list(FINGERPRINT), "left_anti")


def gone_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored files that are no longer there in the same state."""
    return stored.join(current.select(*FINGERPRINT), list(FINGERPRINT), "left_anti")


def refresh_counts(stored: DataFrame, recounted: DataFrame, current: DataFrame, changed: DataFrame) -> DataFrame:
    """Per-file counts after a change: kept where the file is as before, else the new ones.

    `stored` and `recounted` have the same columns, among them the file's `name`.
    """
    same = current.join(changed.select("name"), "name", "left_anti").select("name")
    kept = stored.join(same, "name", "left_semi")
    return kept.unionByName(recounted.join(changed.select("name"), "name", "left_semi"))


def totals(per_file: DataFrame) -> DataFrame:
    return per_file.groupBy("chart_id").agg(F.sum("correct").alias("correct"), F.sum("incorrect").alias("incorrect"))


def refresh_folder(spark: SparkSession, folder: str, before: str | None, after: str, count: Callable[[list[str]], DataFrame]) -> list[str]:
    """Write the state of a result folder to `after`: `files` (fingerprints) and `counts` per file.

    `before` is the last state, None at first. Only files that are new or changed since are read, by
    `count(paths)`, which returns `file` (as in `_metadata.file_path`) and any columns besides. Counts of
    other files are carried over, those of gone files dropped. Returns the paths read; like every
    scan, it lists them on the driver, names only.
    """
    read_listing(spark, folder).withColumn("name", F.col("file")).where(F.col("length") > 0).write.parquet(f"{after}/files")
    current = spark.read.parquet(f"{after}/files")
    changed = current if before is None else changed_files(current, spark.read.parquet(f"{before}/files"))
    # Names may hold characters that a path pattern would read as wildcards.
    paths = [re.sub(r"([\\*?\[\]{}])", r"\\\1", r.path) for r in changed.select("path").collect()]
    recounted = count(paths).withColumnRenamed("file", "name") if paths else None
    if before is None:
        if recounted is None:
            raise LookupError(f"no file below {folder}")
        counts = recounted
    else:
        stored = spark.read.parquet(f"{before}/counts")
        counts = refresh_counts(stored, stored.limit(0) if recounted is None else recounted, current, changed)
    counts.write.parquet(f"{after}/counts")
    return paths

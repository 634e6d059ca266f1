"""Writers: JSON lines, partitioned bundle, manifest, safe rewrite, clustered look-up table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str) -> None:
    """Add rows to a folder of JSON lines; running it twice adds them twice."""
    df.write.mode("append").json(path)


def overwrite_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def overwrite_objects(df: DataFrame, path: str) -> None:
    """`record` (map<string,variant>) as JSON lines; nulls are written as well."""
    df.select(F.to_json("record", {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_jsonl_gz(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, compression="gzip")


def write_document(df: DataFrame, path: str) -> None:
    """A one-row table as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_by_dataset(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """One folder per dataset, rows sorted by `order` (chart first) inside each file.

    Range partitioning on (dataset, order) gives a dataset with a third of all rows a third
    of the tasks; a column that tells rows of one chart apart in `order` splits a hot chart.
    """
    spread = df.repartitionByRange("dataset_id", *order).sortWithinPartitions("dataset_id", *order)
    spread.write.mode("overwrite").partitionBy("dataset_id").json(path, compression="gzip")


def write_summary(summary: DataFrame, path: str) -> None:
    """Accuracy summary, one folder per model."""
    summary.write.mode("overwrite").partitionBy("model").json(path)


def write_results_index(results: DataFrame, path: str, key: str, order: Sequence[str]) -> None:
    """Results clustered by chart, so that a look-up reads a few row groups only.

    `order` names columns that spread the rows of one hot chart over several tasks.
    """
    clustered = results.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    clustered.write.mode("overwrite").parquet(path)


def lookup(spark: SparkSession, path: str, chart_id, key: str = "chart_id") -> DataFrame:
    """Results of one chart over all models; the key is compared inside the Parquet scan."""
    return spark.read.parquet(path).where(F.col(key) == chart_id)


def _slot(key: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(slots)).cast("int")


def write_key_index(results: DataFrame, path: str, key: str, order: Sequence[str], slots: int = 256, keys: int = 1_000_000) -> None:
    """Results in `slots` folders by a hash of the key, sorted by key in each, with Bloom filters of the key in every row group.

    A look-up opens the folders of its keys only, and of their row groups those whose filter may hold one. `order` names columns that spread
    the rows of one hot key over several tasks. `keys` is about how many keys a file holds, for the size of its filters.
    """
    placed = results.withColumn("slot", _slot(F.col(key), slots))
    sorted_rows = placed.repartitionByRange("slot", key, *order).sortWithinPartitions("slot", key, *order)
    sorted_rows.write.partitionBy("slot").option(f"parquet.bloom.filter.enabled#{key}", "true").option(
        f"parquet.bloom.filter.expected.ndv#{key}", max(1, keys)).option("parquet.bloom.filter.adaptive.enabled", "true").mode("overwrite").parquet(path)


def lookup_key(spark: SparkSession, path: str, value, key: str = "chart_id", slots: int = 256) -> DataFrame:
    """Results of one chart from `write_key_index`: one folder, and row groups whose filter may hold the key."""
    rows = spark.read.parquet(path)
    typed = F.lit(value).cast(rows.schema[key].dataType)
    return rows.where((F.col("slot") == _slot(typed, slots)) & (F.col(key) == typed)).drop("slot")


def lookup_keys(spark: SparkSession, path: str, keys: DataFrame, key: str = "chart_id", slots: int = 256) -> DataFrame:
    """Results of all charts listed in the first column of `keys`, over all models, each once however often it is listed.

    The keys' slots, at most `slots` numbers, are found first: other folders are not opened. Up to ten keys are compared in the scan as well,
    where the filters skip row groups; more are joined. A null key finds nothing.
    """
    rows = spark.read.parquet(path)
    wanted = keys.select(F.col(f"`{keys.columns[0]}`").cast(rows.schema[key].dataType).alias(key)).where(F.col(key).isNotNull()).distinct()
    wanted = wanted.withColumn("slot", _slot(F.col(key), slots))
    opened = rows.where(F.col("slot").isin([r.slot for r in wanted.select("slot").distinct().collect()]))
    few = wanted.limit(11).collect()
    if len(few) <= 10:
        return opened.where(F.col(key).isin([r[key] for r in few])).drop("slot")
    return opened.join(wanted, ["slot", key], "left_semi").drop("slot")


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], read: Callable[[str], DataFrame], write: Callable[[DataFrame, str], None]) -> None:
    """Replace a folder by a changed copy: written beside it, then swapped in.

    The old data is moved away before the new data takes its name, and is removed last; a
    failure in between leaves one complete copy.
    """
    beside, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    write(change(read(path)), beside)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.rename(hadoop(path), hadoop(old)):
        raise OSError(f"cannot move {path}")
    if not files.rename(hadoop(beside), hadoop(path)):
        raise OSError(f"cannot move {beside}; the old data is at {old}")
    files.delete(hadoop(old), True)

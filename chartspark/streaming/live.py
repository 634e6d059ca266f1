"""Running reports over growing folders of result files and shards.

State is one row per (model, type) or (model, phase), so no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from chartspark.operators.columns import evaluation_rows
from chartspark.operators.evaluation import accuracy_by_type, usage_totals


def stream_jsonl(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of JSON lines from files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def live_accuracy(results: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """The accuracy summary, kept up to date; write in complete mode."""
    return accuracy_by_type(results, by)


def live_usage(usage: DataFrame, by: Sequence[str] = ("model", "phase"), columns: Sequence[str] = ("input_tokens", "cost")) -> DataFrame:
    """Token and cost totals, kept up to date; write in update or complete mode."""
    return usage_totals(usage, by, columns)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def published(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions of a report that are complete, in order."""
    files, marks = _files(spark, f"{path}/_published")
    return sorted(int(f.getPath().getName()) for f in files.listStatus(marks)) if files.exists(marks) else []


def _commit(spark: SparkSession, path: str, version: int) -> None:
    files, mark = _files(spark, f"{path}/_published/{version}")
    files.create(mark, True).close()


def publish(report: DataFrame, path: str, version: int, keep: int = 3) -> None:
    """Write a version of a report beside the earlier ones; an empty file, created when all its rows are there, makes it the current one.

    A version that is published already is left alone, so a batch may be replayed; what a killed batch left without its mark is
    written anew. The last `keep` versions stay, for readers that have opened one of them.
    """
    spark = report.sparkSession
    done = published(spark, path)
    if version in done:
        return
    report.write.mode("overwrite").parquet(f"{path}/version-{version}")
    _commit(spark, path, version)
    for old in [n for n in sorted([*done, version]) if n < version][: -(keep - 1) or None]:
        for gone in (f"{path}/_published/{old}", f"{path}/version-{old}"):
            files, where = _files(spark, gone)
            files.delete(where, True)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The report of the last published version, whole."""
    done = published(spark, path)
    if not done:
        raise LookupError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/version-{done[-1]}")


def write_latest(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Publish the full current report after every batch, as the version of the batch; `read_latest` gives it back."""

    def save(batch: DataFrame, number: int) -> None:
        publish(batch, path, number)

    return (
        df.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def ingest(records: DataFrame, path: str, checkpoint: str, flatten: Callable[[DataFrame], DataFrame] = evaluation_rows,
           trigger: dict | None = None) -> StreamingQuery:
    """Append the question table of new shards to Parquet, each file once.

    The file sink commits every batch in its log; a repeated batch does not add rows again.
    """
    return (
        flatten(records).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )

"""A store of model replies, so that no prompt is asked twice: neither by a job that starts again nor within one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.operators.runs import flat, numbered, with_values
from chartspark.session import scratch_dir

REPLY = "text string, error string, input_tokens bigint, output_tokens bigint, cached_tokens bigint, cost double"
SCHEMA = f"key string, reply struct<{', '.join(f.replace(' ', ': ', 1) for f in REPLY.split(', '))}>"


def request_key(prompt: Column, model: str) -> Column:
    """What a reply is stored under: a digest of model and prompt. A null prompt has a key of its own."""
    return F.sha2(F.concat_ws("\x00", F.lit(model), F.when(prompt.isNull(), "n").otherwise("p"), prompt), 256)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """`(key, reply)`: one reply for each key that has one without error. A folder that is not there yet is an empty store."""
    spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(path)
    kept = spark.read.schema(SCHEMA).parquet(path).where(F.col("reply.error").isNull())
    # A task whose commit was lost may have run twice; either reply will do.
    return kept.groupBy("key").agg(F.any_value("reply").alias("reply"))


def append(rows: DataFrame, path: str) -> None:
    """Add `rows(key, reply)`. Every task's file appears when that task ends, so a job that dies later has lost none of them."""
    rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)


def compact(spark: SparkSession, path: str, target: str, files: int) -> None:
    """The replies of a store as a new one of `files` files, without errors and repeats."""
    read_store(spark, path).repartition(files, "key").write.parquet(target)


def ask_once(df: DataFrame, prompt: Column, model: str, path: str, ask: Callable[[DataFrame], DataFrame], out: str, per_task: int = 1000) -> DataFrame:
    """Add `out`, the reply to `prompt`, from the store at `path`, after asking for those that it lacks.

    `ask` turns `(key, prompt)` into `(key, reply)`. Equal prompts are asked once, and in tasks of about `per_task`, each of which is stored when
    it is done. Replies with an error are stored apart and not taken for an answer by a later run; this run shows them. The rows are
    stored once and not shuffled.
    """
    rows = numbered(df, "asked")
    found = replies_of_rows(rows, prompt, model, path, ask, per_task)
    return flat(with_values(rows, found.select("row", F.col("reply").alias(out)), "_found")).drop("_row")


def replies_of_rows(rows: DataFrame, prompt: Column, model: str, path: str, ask: Callable[[DataFrame], DataFrame], per_task: int = 1000,
                    prefix: Column | None = None, order: Sequence[str] = ()) -> DataFrame:
    """`(row, wave, reply)` for `numbered` rows, by `ask_once`; with `prefix`, in two waves as by `in_waves`, else all in wave 0.

    Keys (as bytes), prefixes and replies travel. Of the prompts those that are asked are shuffled, once, and neighbours, who often share
    their data, to the same task.
    """
    spark = rows.sparkSession
    keyed = flat(rows).select(F.col("_row").alias("row"), F.unhex(request_key(prompt, model)).alias("key"), *_prefix_columns(prefix, order))
    if prefix is not None:
        marked = _kept(keyed, "prefixes")
        keyed = marked.join(marked.groupBy("_prefix").agg(F.min("_order").alias("_first")), "_prefix").select("row", "key", _wave(F.col("_order")))
    else:
        keyed = keyed.withColumn("wave", F.lit(0))
    keyed = _kept(keyed, "request-keys")
    for wave in (0, 1) if prefix is not None else (0,):
        once = keyed.where(F.col("wave") == wave).groupBy("key").agg(F.min("row").alias("row"))
        lacking = _kept(once.join(read_store(spark, path).select(F.unhex("key").alias("key")), "key", "left_anti"), "lacking")
        tasks = max(1, -(-lacking.count() // per_task))
        chosen = with_values(rows, lacking.select("row", F.lower(F.hex("key")).alias("_key")), "_lacking", "inner").where(F.col("_lacking").isNotNull())
        prompts = flat(chosen).select(F.col("_key").alias("key"), prompt.alias("prompt"), F.floor(F.col("_row") / max(1, per_task // 16)).alias("_near"))
        # By key, so that a job that runs again puts the same prompts into a batch.
        append(ask(prompts.repartition(tasks, "_near").select("key", "prompt").sortWithinPartitions("key")), path)
    good = spark.read.schema(SCHEMA).parquet(path).select(F.unhex("key").alias("key"), "reply").groupBy("key").agg(F.coalesce(
        F.any_value(F.when(F.col("reply.error").isNull(), F.col("reply")), True), F.any_value("reply")).alias("reply"))
    return _kept(keyed.join(good, "key", "left").select("row", "wave", "reply"), "replies-of-rows")


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _prefix_columns(prefix: Column | None, order: Sequence[str]) -> list[Column]:
    """A null prefix is a prefix."""
    return [] if prefix is None else [F.coalesce(prefix.cast("string"), F.lit("\x00")).alias("_prefix"), F.struct(*order).alias("_order")]


def _wave(order: Column) -> Column:
    return F.when(order.eqNullSafe(F.col("_first")), 0).otherwise(1).alias("wave")


def in_waves(rows: DataFrame, prefix: Column, order: Sequence[str], ask: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Ask for the first row of every prompt prefix and store the replies; only then ask for the others. Adds `wave`, 0 and 1.

    A server that keeps prompt prefixes then meets each of them cold once, however many tasks ask. `order` tells the rows of one prefix apart;
    the first row is found by an aggregate, so a prefix with very many rows is no task of its own. Rows that `order` does not tell
    apart are in the same wave. A null prefix is a prefix.
    """
    marked = store(rows.withColumn("_prefix", _prefix_columns(prefix, order)[0]), "waves")
    first = marked.groupBy("_prefix").agg(F.min(F.struct(*order)).alias("_first"))
    placed = marked.join(first, "_prefix").withColumn("wave", _wave(F.struct(*order)))
    split = store(placed.drop("_first", "_prefix"), "waves")
    warmed = store(ask(split.where("wave = 0")), "warmed")
    return warmed.unionByName(ask(split.where("wave = 1")))

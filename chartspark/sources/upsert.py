"""A union of shards that is kept up to date: rows in buckets by a hash of their key, of which a new shard rewrites those it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.streaming.live import publish, published, read_latest

#: Columns of the stored table beside those of the shards.
OWN = ("_shard", "_order", "_bucket")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _folders(spark: SparkSession, path: str) -> dict[int, str]:
    """Where each bucket's rows lie now: at most as many entries as there are buckets."""
    if not published(spark, f"{path}/manifest"):
        return {}
    return {r.bucket: r.folder for r in read_latest(spark, f"{path}/manifest").collect()}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The union so far, one row for each key, with the columns of the last shard that changed something."""
    return _stored(spark, path, None).drop(*OWN)


def _stored(spark: SparkSession, path: str, buckets: list[int] | None) -> DataFrame:
    found = _folders(spark, path)
    wanted = sorted(folder for b, folder in found.items() if buckets is None or b in buckets)
    if not found:
        raise LookupError(f"no shard was added at {path}")
    rows = spark.read.option("mergeSchema", "true").parquet(*(wanted or found.values()))
    return rows if wanted else rows.limit(0)


def upsert(shard: DataFrame, path: str, key: str, order: str, number: int, buckets: int = 64) -> list[int]:
    """Add a shard to the union at `path`; of rows with one key the first by (shard number, `order`) stays, whenever it came. Returns the rewritten buckets.

    Columns that only some shards have are null for the others. Buckets in which the shard changes nothing keep their files. The
    changed ones are written beside the old, and a manifest that is published at the end makes them current: a job that dies before leaves
    the union as it was, and one that is run again adds nothing. `order` must be a column of every shard, `buckets` the same for all of them.
    """
    spark = shard.sparkSession
    rest = [c for c in shard.columns if c != key]
    # Which buckets change is found from keys and orders alone.
    slim = shard.groupBy(key).agg(F.min(order).alias("_order")).withColumns({"_shard": F.lit(number), "_bucket": _bucket(F.col(key), buckets)})
    new = shard.select(key, *rest, F.lit(number).alias("_shard"), F.col(order).alias("_order"), _bucket(F.col(key), buckets).alias("_bucket"), F.lit(True).alias("_new"))
    before = _folders(spark, path)
    version = (published(spark, f"{path}/manifest") or [-1])[-1] + 1
    folder = f"{path}/data/{version}"
    if before:
        met = [r._bucket for r in slim.select("_bucket").distinct().collect()]
        old = _stored(spark, path, met)
        known = old.select(F.col(key).alias("_key"), F.struct("_shard", "_order").alias("_place"))
        news = slim.join(known, F.col(key).eqNullSafe(F.col("_key")), "left").where(F.col("_place").isNull() | (F.struct("_shard", "_order") < F.col("_place")))
        touched = [r._bucket for r in news.select("_bucket").distinct().collect()]
        there = F.col("_bucket").isin(touched)
        whole = old.where(there).withColumn("_new", F.lit(False)).unionByName(new.where(there), allowMissingColumns=True)
    else:
        whole, touched = new, [r._bucket for r in slim.select("_bucket").distinct().collect()]
    # Rows are shuffled once, by bucket, and written from there: both aggregates find their keys together.
    dealt = whole.withColumn("b", F.col("_bucket")).repartition("b")
    kept = [c for c in whole.columns if c not in (key, "_shard", "_new")]
    once = dealt.groupBy("b", key, "_new", "_shard").agg(F.min_by(F.struct(*kept), F.col("_order")).alias("_row"))
    place = F.struct(F.col("_shard"), F.col("_row._order"), F.col("_new"))
    first = once.groupBy("b", key).agg(F.min_by(F.struct("_shard", "_row"), place).alias("_first"))
    merged = first.select(key, *[F.col(f"_first._row.{c}").alias(c) for c in kept if c != "_bucket"], F.col("_first._shard").alias("_shard"), F.col("b").alias("_bucket"), "b")
    if not touched and before:
        return []
    merged.write.mode("overwrite").partitionBy("b").parquet(folder)
    now = before | {b: f"{folder}/b={b}" for b in touched}
    if not now:
        # An empty first shard: its columns are kept in one empty bucket.
        merged.drop("b").write.mode("overwrite").parquet(f"{folder}/b=0")
        now = {0: f"{folder}/b=0"}
    publish(spark.createDataFrame(sorted(now.items()), "bucket int, folder string"), f"{path}/manifest", version)
    return sorted(touched)

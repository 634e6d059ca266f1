"""What one task reads and holds: joins with few groups, rows without a key, batches of long texts, texts that are shuffled once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chartspark.operators import bundle as bu
from chartspark.operators import gallery_index as gi
from chartspark.operators import scoring as sc
from chartspark.operators.charts import relations as re
from chartspark.operators.ordering import quantiles_long
from chartspark.session import BATCH_BYTES
from chartspark.sources import upsert as up


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_rows_of_few_groups_are_not_shuffled_for_their_quantiles(spark):
    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), F.col("id").cast("double").alias("x")).union(
        spark.createDataFrame([(None, 1.0), (None, 4.0)], "g string, x double"))
    found = quantiles_long(rows, "x", ["g"], [0.5])
    assert "SortMergeJoin" not in planned(found) and "BroadcastHashJoin" in planned(found)
    assert {(r.g, r.q) for r in found.collect()} == {("0", 499.5), ("1", 499.0), ("2", 500.0), (None, 2.5)}


def test_rows_of_few_groups_are_not_shuffled_for_their_residuals(spark):
    rows = spark.range(1_000_000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"), (2.0 * F.col("id") + 1).alias("y"))
    found = re.residuals(rows, "x", "y", "g")
    assert "SortMergeJoin" not in planned(found) and "BroadcastHashJoin" in planned(found)
    assert found.agg(F.count("residual"), F.max(F.abs("residual")) < 1e-3).first() == (1_000_000, True)


@pytest.fixture
def plain_joins(spark):
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in held}
    for k, value in held.items():
        spark.conf.set(k, value)
    yield
    for k, value in before.items():
        spark.conf.set(k, value)


def test_images_without_a_path_are_dealt_out(spark, plain_joins):
    images = spark.range(400).select("id", F.when(F.col("id") % 4 > 0, F.concat(F.lit("old/"), (F.col("id") % 100).cast("string"))).alias("path")).union(
        spark.createDataFrame([(-1, ""), (-2, "images/")], "id long, path string"))
    listing = spark.createDataFrame([(f"images/{i}", i) for i in range(0, 100, 2)] + [("old/1", 7), ("images/", 3), ("", 5), (None, 9)], "path string, length long")
    rows = bu.resolve_images(images, listing).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows if r.path is None}) > 4
    want = {None: (None, None), "": ("", 5), "images/": ("images/", 3), "old/1": ("old/1", 7)}
    for r in rows:
        n = int(r.path[4:]) if r.path and r.path.startswith("old/") else 0
        assert (r.source, r.length) == want.get(r.path, (f"images/{n}", n) if n % 2 == 0 else (None, None))
    assert len(rows) == 402


def test_postings_hold_a_bounded_run_of_texts(monkeypatch):
    monkeypatch.setattr(gi, "HELD", 50)
    texts = [f"text {i} äö" * (1 + i % 9) for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array([(i % 2 << gi.BLOCK_BITS) + i for i in range(40)], type=pa.int64()), "blob": texts})
    parts = list(gi._postings([batch, batch.slice(0, 0)]))
    assert len(parts) > 10
    got = {(r["gram"], r["block"], p) for part in parts for r in part.to_pylist() for p in r["places"]}
    assert got == {((t + 2 * gi.END)[k : k + 3], i % 2, i) for i, t in enumerate(texts) for k in range(len(t))}


def test_prompts_come_in_batches_of_bounded_size(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1g")
    try:
        out = sc.score(spark.range(3), F.lit("x"), lambda: lambda prompts: prompts)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == BATCH_BYTES and out.count() == 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_texts_of_a_shard_are_read_once_for_an_upsert(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(text):
        read.add(1)
        return text

    def shard(ids, mark):
        own = F.udf(counted).asNondeterministic()
        return spark.createDataFrame([(i, 0, f"{mark}{i}") for i in ids], "id long, pos long, t string").select("id", "pos", own("t").alias("text"))

    path = str(tmp_path / "union")
    up.upsert(shard(range(40), "a"), path, "id", "pos", 1, buckets=4)
    read.value = 0
    up.upsert(shard(range(20, 60), "b"), path, "id", "pos", 0, buckets=4)
    assert read.value == 40
    assert {r.id: r.text for r in up.read(spark, path).collect()} == {i: f"{'a' if i < 20 else 'b'}{i}" for i in range(60)}

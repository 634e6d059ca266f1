import pytest
from pyspark.sql import functions as F

from chartspark.sources import writers as wr

SLOTS = 16


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("keys") / "index")
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, 6).otherwise(F.col("id") * 2 % 20_000).alias("chart_id"), F.col("id").alias("row_id"), (F.col("id") % 7).cast("string").alias("model"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    wr.write_key_index(rows, path, "chart_id", ["row_id"], slots=SLOTS, keys=5000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return path, rows


def metrics(df):
    """What the scan of the results read: files and rows."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size()) if leaves.apply(i).nodeName().startswith("Scan parquet")]
    one = max(scans, key=lambda s: s.output().size())
    return {k: one.metrics().apply(k).value() for k in ("numFiles", "numOutputRows")}


@pytest.fixture
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_many_keys_against_a_scan(spark, index):
    path, rows = index
    keys = spark.createDataFrame([(str(k),) for k in [2, 4, 6, 6, 7, 19_998, -5]] + [(None,)], "`a key` string")
    got = wr.lookup_keys(spark, path, keys, slots=SLOTS)
    want = rows.where(F.col("chart_id").isin(2, 4, 6, 19_998))
    assert got.columns == rows.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert wr.lookup_keys(spark, path, keys.limit(0), slots=SLOTS).count() == 0
    many = spark.range(500).select(F.col("id") * 5)
    want = rows.where("chart_id % 5 = 0 and chart_id < 2500")
    assert sorted(map(tuple, wr.lookup_keys(spark, path, many.union(many), slots=SLOTS).collect())) == sorted(map(tuple, want.collect()))


def test_folders_without_a_key_are_not_opened(spark, index, plain_plans):
    path, _ = index
    files = len(spark.read.parquet(path).inputFiles())
    keys = spark.createDataFrame([(2,), (4,)], "k long")
    assert 0 < metrics(wr.lookup_keys(spark, path, keys, slots=SLOTS))["numFiles"] < files / 2
    assert 0 < metrics(wr.lookup_key(spark, path, 2, slots=SLOTS))["numFiles"] < files / 2


def test_bloom_filters_skip_keys_within_the_range(spark, index, plain_plans):
    """Odd keys lie between the least and the greatest key of their files, but no file holds one."""
    path, _ = index
    assert [metrics(wr.lookup_key(spark, path, k, slots=SLOTS))["numOutputRows"] for k in (9, 77, 1001, 12_345)].count(0) >= 3
    assert metrics(wr.lookup_key(spark, path, 8, slots=SLOTS))["numOutputRows"] > 0


def test_a_hot_key_is_spread_over_files(spark, index):
    path, _ = index
    assert wr.lookup_key(spark, path, 6, slots=SLOTS).select(F.input_file_name()).distinct().count() > 1

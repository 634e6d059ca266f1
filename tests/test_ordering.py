"""Ordered work over buckets against plain Python, with a hot group, null groups and ties."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartspark.operators import ordering as o


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [("hot" if i % 3 else rng.choice(["a", "b", None]), i, rng.randint(0, 40) / 4) for i in range(1500)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "g string, i long, x double").repartition(5)


def by_group(rows):
    groups = {}
    for g, i, x in rows:
        groups.setdefault(g, []).append((i, x))
    return groups


def test_running_sums(table, rows):
    out = o.running(table, ["g"], ["i"], {"s": F.col("x"), "n": F.lit(1)}, block=100, totals=True)
    got = {r.i: (round(r.s, 6), r.n, r.n_total) for r in out.collect()}
    for g, members in by_group(rows).items():
        total = 0.0
        for n, (i, x) in enumerate(sorted(members), 1):
            total += x
            assert got[i] == (round(total, 6), n, len(members))


def test_positions_without_group(table, rows):
    got = {r.i: r.position for r in o.positions(table, [], ["i"], block=37).collect()}
    assert got == {i: i for i in range(len(rows))}


def test_positions_by_value_keep_input_order_on_ties(table, rows):
    for ascending in (True, False):
        got = {r.i: r.position for r in o.positions_by_value(table, "x", "i", ascending, block=50).collect()}
        order = sorted(rows, key=lambda r: r[2], reverse=not ascending)
        assert got == {i: n for n, (_, i, _) in enumerate(order)}


def test_previous_row_crosses_blocks(table, rows):
    got = {r.i: (r.prev_x if r.has_prev else None) for r in o.previous_row(table, ["g"], ["i"], ["x"], 10).collect()}
    for members in by_group(rows).values():
        before = None
        for i, x in sorted(members):
            assert got[i] == before
            before = x


def test_previous_row_of_empty_blocks(spark):
    df = spark.createDataFrame([(1, "a"), (50, "b"), (900, "b")], "i long, v string")
    got = {r.i: r.prev_v for r in o.previous_row(df, [], ["i"], ["v"], 10).collect()}
    assert got == {1: None, 50: "a", 900: "b"}


def test_quantiles_match_numpy(table, rows):
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.p): r.q for r in o.quantiles_long(table, "x", ["g"], points).collect()}
    for g, members in by_group(rows).items():
        for p in points:
            assert got[g, p] == pytest.approx(np.quantile([x for _, x in members], p))
    assert len(got) == 4 * len(points)


def test_quantiles_ignore_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (4.0,)], "x double")
    assert o.quantiles_long(df, "x", [], [0.5]).collect()[0].q == 2.5
    empty = o.quantiles_long(df.where("x > 9 and not isnan(x)"), "x", [], [0.5])
    assert empty.collect() == []


def test_ranked_desc(table, rows):
    got = {r.i: r.place for r in o.ranked_desc(table, ["g"], "x").collect()}
    for members in by_group(rows).values():
        for i, x in members:
            assert got[i] == 1 + sum(y > x for _, y in members)


def test_top_by_draw_is_the_n_smallest(table, rows):
    drawn = table.withColumn("d", (F.col("i") * 7919 % 65536))
    got = {}
    for r in o.top_by_draw(drawn, ["g"], "d", 65536, 9, slices=256).collect():
        got.setdefault(r.g, set()).add(r.i)
    for g, members in by_group(rows).items():
        assert got[g] == {i for i, _ in sorted(members, key=lambda m: m[0] * 7919 % 65536)[:9]}


def test_split_points_balance(table):
    splits = o.split_points(table, "x", rows_per_bucket=100)
    assert splits == sorted(set(splits)) and 5 < len(splits) < 41
    assert o.split_points(table.where("false"), "x") == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", None]), st.floats(-1e6, 1e6, width=32)), min_size=1, max_size=40))
def test_quantiles_of_any_list(spark, values):
    df = spark.createDataFrame(values, "g string, x double")
    got = {(r.g, r.p): r.q for r in o.quantiles_long(df, "x", ["g"], [0.25, 0.5]).collect()}
    for g in {v[0] for v in values}:
        for p in (0.25, 0.5):
            assert got[g, p] == pytest.approx(np.quantile([x for h, x in values if h == g], p), rel=1e-9, abs=1e-9)


def test_join_spread_keeps_every_row_of_a_hot_group(table, rows):
    means = table.groupBy("g").agg(F.avg("x").alias("m"))
    joined = o.join_spread(table, means, ["g"], per_slice=50)
    got = {r.i: r.m for r in joined.collect()}
    assert len(got) == joined.count() == len(rows)
    for members in by_group(rows).values():
        mean = sum(x for _, x in members) / len(members)
        assert all(got[i] == pytest.approx(mean) for i, _ in members)


@pytest.mark.parametrize("n", [49_999, 50_000, 300_000])
def test_quantiles_with_narrow_brackets(spark, n):
    """A hot group with many ties and single values, and a small one, on both sides of the bracket rule."""
    df = spark.range(0, n + 10, 1, 7).select(
        F.when(F.col("id") < n, "hot").otherwise("small").alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise((F.xxhash64("id") % 100_003).cast("double")).alias("x"))
    points = [0.0, 0.001, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r.g, r.p): r.q for r in o.quantiles_long(df, "x", ["g"], points).collect()}
    for g, values in df.toPandas().groupby("g")["x"]:
        for p in points:
            assert got[g, p] == pytest.approx(np.quantile(values, p))
    assert len(got) == 2 * len(points)

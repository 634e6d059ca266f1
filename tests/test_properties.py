"""Properties of chart tables and of browsing that hold for any data."""

import pytest
from pyspark.sql import functions as F

from chartspark.operators import bundle
from chartspark.operators import gallery as ga
from chartspark.operators import sampling as sa
from chartspark.operators.charts import bars, common, distributions as di, grids, relations as re, timeline
from chartspark.plans import views as v
from chartspark.plans.gallery import collection_v, counted

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lineitem(spark):
    return v.table(spark, SF, "lineitem")


def test_histogram_counts_every_row(lineitem):
    n = lineitem.count()
    for bins in (1, 7, 100):
        rows = di.histogram(lineitem, "l_extendedprice", bins).collect()
        assert sum(r["count"] for r in rows) == n and len(rows) == bins


def test_histogram_of_a_constant_and_of_nothing(spark):
    one = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    rows = {r.bin: r["count"] for r in di.histogram(one, "x", 3).collect()}
    assert rows == {0: 2, 1: 0, 2: 0}
    assert di.histogram(one.where("x > 9"), "x", 3).count() == 0


def test_shares_and_ends(lineitem):
    for r in bars.stacked_bar(lineitem, "l_returnflag", "l_linestatus").groupBy("l_returnflag").agg(F.sum("share").alias("s")).collect():
        assert r.s == pytest.approx(1)
    assert bars.pie(lineitem, "l_shipdate", top=3).agg(F.sum("share")).first()[0] == pytest.approx(1)
    tops = di.ecdf(lineitem, "l_quantity", "l_returnflag").groupBy("l_returnflag").agg(F.max("share").alias("m")).collect()
    assert {r.m for r in tops} == {1.0}
    assert bars.waffle(lineitem, "l_linenumber").agg(F.sum("cells")).first()[0] == 100


def test_density_integrates_to_about_one(lineitem):
    rows = sorted(di.density(lineitem, "l_extendedprice", 200).collect(), key=lambda r: r.x)
    area = sum((b.x - a.x) * (a.density + b.density) / 2 for a, b in zip(rows, rows[1:]))
    assert 0.8 < area < 1.01


def test_hexbin_and_grid_count_every_row(lineitem):
    n = lineitem.count()
    assert grids.hexbin(lineitem, "l_quantity", "l_extendedprice", 9).agg(F.sum("count")).first()[0] == n
    assert grids.hist2d(lineitem, "l_quantity", "l_extendedprice", 4, 5).agg(F.sum("count")).first()[0] == n


def test_projection_matches_numpy(spark):
    import numpy as np

    vectors = v.table(spark, SF, "embeddings")
    scores, loadings = re.projection(vectors, "vec_id", "embedding", 2)
    rows = vectors.select("vec_id", "embedding").toPandas()
    matrix = np.array(rows["embedding"].tolist(), dtype=float)
    matrix -= matrix.mean(axis=0)
    values, axes = np.linalg.eigh(np.cov(matrix.T))
    for k, name in ((1, "pc1"), (2, "pc2")):
        axis = axes[:, -k] * np.sign(axes[np.abs(axes[:, -k]).argmax(), -k])
        wanted = dict(zip(rows["vec_id"], matrix @ axis))
        for r in scores.collect():
            assert r[name] == pytest.approx(wanted[r.vec_id], abs=1e-6)
        assert [r[name] for r in loadings.orderBy("dimension").collect()] == pytest.approx(list(axis), abs=1e-6)


@pytest.mark.parametrize("spectrum", ["steep", "flat", "few", "zero"])
def test_wide_axes_against_the_whole_matrix(spark, spectrum):
    import numpy as np

    rng = np.random.default_rng(3)
    n, d, k = 400, 150, 4
    scale = {"steep": 0.8 ** np.arange(d), "flat": 1 - np.arange(d) / 1000, "few": np.r_[3.0, 2.0, np.zeros(d - 2)], "zero": np.zeros(d)}[spectrum]
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    matrix = rng.standard_normal((n, d)) * scale @ turn.T + 5
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(matrix)], "id long, v array<double>").repartition(3)
    scores, loadings = re.projection(rows, "id", "v", k, block=6)
    matrix = matrix - matrix.mean(axis=0)
    values = np.linalg.svd(matrix, compute_uv=False)[:k] ** 2
    got = np.array([r[1:] for r in scores.orderBy("id").collect()])
    assert (got**2).sum(axis=0) == pytest.approx(values, rel=1e-6, abs=1e-9)
    axes = np.array([r[1:] for r in loadings.orderBy("dimension").collect()])
    assert axes.T @ axes == pytest.approx(np.eye(k), abs=1e-9)
    assert got == pytest.approx(matrix @ axes, abs=1e-9)
    assert all(axes[abs(axes[:, j]).argmax(), j] > 0 for j in range(k))


def test_shuffle_is_a_repeatable_permutation(spark):
    ids = spark.range(500)
    first = [r.place for r in sa.shuffled(ids, "id", 42).orderBy("id").collect()]
    again = [r.place for r in sa.shuffled(ids.repartition(3), "id", 42).orderBy("id").collect()]
    other = [r.place for r in sa.shuffled(ids, "id", 7).orderBy("id").collect()]
    assert sorted(first) == list(range(500)) and first == again and first != other


def test_creativity_has_the_mean_of_its_distribution(spark):
    mean = spark.range(4000).agg(F.avg(sa.creativity(1, F.col("id")))).first()[0]
    assert abs(mean - 1 / 3) < 0.02


def test_pages_partition_the_collection(spark):
    placed = ga.sorted_places(counted(spark, SF), ascending=False, block=7)
    pages = [[r.chart_id for r in ga.page(placed, n).collect()] for n in range(9)]
    n = placed.count()
    assert [len(p) for p in pages] == [24] * (n // 24) + ([n % 24] if n % 24 else [])
    assert len({c for p in pages for c in p}) == n
    assert {r.chart_id for r in ga.page(placed, 99).collect()} == set(pages[-1])


def test_facets_sum_to_the_filtered_count(spark):
    charts = collection_v(spark, SF)
    rows = ga.facets(charts, family="Heatmap", quality="(all)").collect()
    total = {f: sum(r.charts for r in rows if r.facet == f and r.value != "all") for f in ("quality", "family", "dataset")}
    assert total["quality"] == total["dataset"] == ga.filter_charts(charts, family="Heatmap").count()
    assert total["family"] == charts.count()


def test_long_axes_are_whole(spark):
    """20,001 categories: no chart refuses or cuts them."""
    n = 20_001
    df = spark.range(n).select(F.format_string("c%06d", "id").alias("c"), (F.col("id") % 2).cast("string").alias("h"), F.lit(1).alias("one"), F.timestamp_seconds(F.col("id") % 3).alias("t"))
    tiles = bars.mosaic(df, "c", "h").agg(F.count(F.lit(1)), F.max("x0"), F.max(F.abs(F.col("x0") - F.substring("c", 2, 6).cast("int") / n))).first()
    assert tiles[0] == n and tiles[2] < 1e-9
    assert bars.upset(df, "h", "c").agg(F.sum("degree")).first()[0] == n
    levels = timeline.waterfall(df, "c", "one")
    assert levels.where(F.col("end") == F.substring("c", 2, 6).cast("int") + 1).count() == n
    layers = timeline.streamgraph(df, "t", "c", None, "second")
    assert layers.groupBy("bucket").agg(F.max("y1").alias("m"), F.sum("value").alias("s")).where("m = s").count() == 3
    assert grids.heatmap(df, "h", "c").count() == 2 * n
    families = df.select(F.lit("d").alias("dataset_id"), F.col("c").alias("canonical_type"), F.col("c").alias("model"))
    row = bundle.manifest(families, families).first()
    assert len(row.canonical_type_counts) == len(row.models) == n == bundle.manifest_families(families).count() == bundle.manifest_models(families).count()


def test_category_places_follow_the_text_order(spark):
    words = ["", "a", "ab", "abcdefg", "abcdefh", "b", "é", "ñandú", "\U0001f600", "Z", None]
    df = spark.createDataFrame([(w,) for w in words], "c string")
    placed = [r.c for r in common.with_place(df, "c").orderBy("_place", "c").collect()]
    assert placed == [None, *sorted((w for w in words if w is not None), key=lambda w: w.encode())]


def test_sample_keeps_small_groups_whole(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 5, "small").otherwise("hot"))
    got = {r.g: r["count"] for r in di.sample_points(df, "id", ["id"], 40, "g").groupBy("g").count().collect()}
    assert got == {"small": 5, "hot": 40}

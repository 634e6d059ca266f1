"""Published versions, the incremental union, and chart data that is combined inside the tasks."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from chartspark.operators import sequences as sq
from chartspark.operators.charts import bars
from chartspark.operators.charts import distributions as di
from chartspark.sources import upsert as up
from chartspark.streaming import live


def report(spark, n):
    return spark.range(n * 10).select(F.lit(n).alias("v"), "id")


def seen(spark, path):
    return sorted(tuple(r) for r in live.read_latest(spark, path).collect())


def test_readers_see_whole_versions_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "report")
    with pytest.raises(LookupError):
        live.read_latest(spark, path)
    live.publish(report(spark, 1), path, 1)
    # Killed between write and mark: the earlier version stays the current one, and the replay takes the place of what was left.
    with monkeypatch.context() as m:
        m.setattr(live, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            live.publish(report(spark, 2), path, 2)
    assert seen(spark, path) == [(1, i) for i in range(10)]
    live.publish(report(spark, 3), path, 2)
    assert seen(spark, path) == [(3, i) for i in range(30)]
    # A replayed batch changes nothing.
    live.publish(report(spark, 9), path, 2)
    live.publish(report(spark, 9), path, 1)
    assert seen(spark, path) == [(3, i) for i in range(30)] and live.published(spark, path) == [1, 2]


def test_a_reader_keeps_its_version_while_newer_ones_come(spark, tmp_path):
    path = str(tmp_path / "report")
    live.publish(report(spark, 1), path, 0)
    opened = live.read_latest(spark, path)
    for n in (1, 2):
        live.publish(report(spark, n + 1), path, n)
    assert opened.count() == 10 and live.published(spark, path) == [0, 1, 2]
    live.publish(report(spark, 5), path, 3)
    assert live.published(spark, path) == [1, 2, 3] and sorted(p.name for p in (tmp_path / "report").glob("version-*")) == ["version-1", "version-2", "version-3"]
    live.publish(report(spark, 6), path, 4, keep=1)
    assert live.published(spark, path) == [4] and seen(spark, path)[0] == (6, 0)


def files(spark, path):
    return {b: spark.read.parquet(f).inputFiles() for b, f in up._folders(spark, path).items()}


def test_union_after_uneven_shards_equals_the_recompute(spark, tmp_path):
    path, rng = str(tmp_path / "union"), random.Random(3)
    make = lambda n, top: [(rng.choice([rng.randrange(top), None]) if i % 50 == 0 else rng.randrange(top), i, f"s{n}-{i}") for i in range(n)]
    shards = [spark.createDataFrame(make(n, top), "id long, pos long, text string") for n, top in ((300, 200), (5, 400), (900, 300))]
    shards[1] = shards[1].withColumn("more", F.lit("x"))
    for number in (2, 0, 1):
        up.upsert(shards[number], path, "id", "pos", number, buckets=32)
    columns = ["id", "pos", "text", "more"]
    want = sq.union_once(shards, "id", "pos").select(columns)
    assert sorted(map(repr, up.read(spark, path).select(columns).collect())) == sorted(map(repr, want.collect()))
    # The same shards again: nothing is rewritten.
    before = files(spark, path)
    assert [up.upsert(shards[n], path, "id", "pos", n, buckets=32) for n in (0, 1, 2)] == [[], [], []] and files(spark, path) == before
    # One new row: its bucket alone gets new files.
    touched = up.upsert(spark.createDataFrame([(10_000, 0, "new"), (rng.randrange(200), 0, "late")], "id long, pos long, text string"), path, "id", "pos", 7, buckets=32)
    after = files(spark, path)
    assert len(touched) == 1 and [b for b in after if after[b] != before.get(b)] == touched
    assert up.read(spark, path).where("id = 10000").count() == 1 and up.read(spark, path).where("text = 'late'").count() == 0


def test_a_union_that_dies_before_its_manifest_is_as_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "union")
    rows = lambda *ids: spark.createDataFrame([(i, 0) for i in ids], "id long, pos long")
    up.upsert(rows(1, 2, 3), path, "id", "pos", 0, buckets=4)
    with monkeypatch.context() as m:
        m.setattr(up, "publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            up.upsert(rows(4, 5), path, "id", "pos", 1, buckets=4)
    assert sorted(r.id for r in up.read(spark, path).collect()) == [1, 2, 3]
    up.upsert(rows(4, 5), path, "id", "pos", 1, buckets=4)
    assert sorted(r.id for r in up.read(spark, path).collect()) == [1, 2, 3, 4, 5]
    empty = str(tmp_path / "empty")
    up.upsert(rows(1).limit(0), empty, "id", "pos", 0)
    assert up.read(spark, empty).columns == ["id", "pos"] and up.read(spark, empty).count() == 0


def test_combinations_of_a_hot_entity_and_nulls(spark):
    rows = [("hot", f"m{i}") for i in range(3000)] + [("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("b", "x"), ("c", "x"), ("n", None), (None, "x"), ("d", None), ("d", "x")]
    got = bars.upset(spark.createDataFrame(rows, "e string, m string").repartition(6), "e", "m").collect()
    assert sorted((r.members[:2], r.entities, r.degree) for r in got) == [([], 1, 0), (["m0", "m1"], 1, 3000), (["x"], 3, 1), (["x", "y"], 2, 2)]
    assert max(len(r.members) for r in got) == 3000
    plan = bars.upset(spark.createDataFrame(rows, "e string, m string"), "e", "m")._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_xor" in plan


def test_density_against_all_values_and_points(spark):
    import math

    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(300)] + [50.0, 50.0, 1e3, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = sorted(di.density(df, "x", 100).collect(), key=lambda r: r.point)
    own = [v for v in values if v is not None and not math.isnan(v)]
    mean = sum(own) / len(own)
    h = math.sqrt(sum((v - mean) ** 2 for v in own) / (len(own) - 1)) * len(own) ** -0.2
    assert len(got) == 100
    for r in got:
        at = min(own) + r.point * (max(own) - min(own)) / 99
        want = sum(math.exp(-(((at - v) / h) ** 2) / 2) for v in own) / (len(own) * h * math.sqrt(2 * math.pi))
        assert abs(r.x - at) < 1e-9 and abs(r.density - want) < 1e-9


def test_merged_profile_equals_the_profile_and_reads_changed_files_only(spark, tmp_path):
    from chartspark.operators.charts import profile as pf

    rng = random.Random(7)
    rows = [(n, None if n % 11 == 0 else rng.gauss(1e9, 3.0), float("nan") if n % 7 == 0 else float(n), None, None if n % 5 == 0 else f"c{n % 40}") for n in range(3000)]
    schema = "`odd.name` long, far double, holes double, nothing double, word string"
    folder, states = str(tmp_path / "data"), [str(tmp_path / f"states{i}") for i in range(4)]

    def write(name, part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")

    def read(paths):
        return spark.read.schema(schema).parquet(*paths).select("*", F.col("_metadata.file_path").alias("file"))

    write("a", rows[:5])
    write("b", rows[5:1500])
    write("gone", rows[:100])
    assert len(pf.refresh_profile(spark, folder, None, states[0], read)) == 3
    write("c", rows[1500:])
    write("gone", [])
    paths = pf.refresh_profile(spark, folder, states[0], states[1], read)
    assert sorted(p.rsplit("/", 2)[1] for p in paths) == ["c", "gone"]
    # Nothing changed: nothing is read, the state is carried over.
    assert pf.refresh_profile(spark, folder, states[1], states[2], read) == []
    kept = spark.read.parquet(f"{states[2]}/counts")
    whole = spark.createDataFrame(rows, schema)
    expected = {r["column"]: r for r in pf.numeric_profile(whole).collect()}
    got = {r["column"]: r for r in pf.merged_profile(kept).collect()}
    assert set(got) == set(expected) == {"odd.name", "far", "holes", "nothing"}
    for name, row in expected.items():
        for field in ("rows", "missing", "min", "max"):
            assert got[name][field] == row[field]
        assert got[name]["mean"] == (None if row["mean"] is None else pytest.approx(row["mean"], rel=1e-12))
    assert got["nothing"].sd is None
    # Means near 1e9 are doubles 1e-7 apart, so a deviation of 3 around them is known to about 1e-8 of itself.
    exact_sd = {"odd.name": (0, 1e-12), "far": (1, 1e-7), "holes": (2, 1e-12)}
    for name, (place, rel) in exact_sd.items():
        given = [r[place] for r in rows if r[place] is not None and r[place] == r[place]]
        assert got[name].sd == pytest.approx(statistics.stdev(given), rel=rel)
    assert got["nothing"].median is None and expected["nothing"]["rows"] == 3000
    # The sketches' quartiles are within 1 % of the ranks; on request they are exact.
    values = sorted(r[0] for r in rows)
    for field, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert abs(sum(x <= got["odd.name"][field] for x in values) / len(values) - p) < 0.01
    exact = {r["column"]: r for r in pf.merged_profile(kept, whole).collect()}
    assert [exact["far"][f] for f in ("q1", "median", "q3")] == [expected["far"][f] for f in ("q1", "median", "q3")]
    categories = {r["column"]: r for r in pf.merged_categories(kept).collect()}
    assert categories["word"]["rows"] == 3000 and categories["word"].missing == 600 and abs(categories["word"].about_distinct - 32) <= 2
    write("gone", rows[:1])
    assert len(pf.refresh_profile(spark, folder, states[2], states[3], read)) == 1

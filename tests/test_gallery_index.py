import random

import pytest
from pyspark.sql import functions as F

from chartspark.operators import gallery as ga
from chartspark.operators import gallery_index as gi

SCHEMA = "chart_id long, dataset_id string, description string, raw_type string, family string, quality string"
COLUMNS = gi.COLUMNS


@pytest.fixture(scope="module")
def charts(spark):
    rng = random.Random(7)
    letters = "abcé日 -%_"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, rng.choice(["d1", "d2", "?", None]), rng.choice([None, text(rng.randint(0, 60))]), rng.choice(["Bar", "pie", ""]), rng.choice(["B", "P", "L"]),
             rng.choice(["good", "bad", "bad"])) for i in range(400)]
    rows += [(1000, "d9", "rare needle here " + "x" * 50_000, "Bar", "B", "good"), (1001, None, "aa", None, None, None), (1001, None, "aa", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def path(charts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("gallery") / "index")
    gi.write_index(charts, path)
    return path


def listed(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("term", ["needle", "ab", "a", "é", "日 ", "bcé", "%", "_a", "  BAR ", "b p", "1001", "x" * 40, "zzz", "", "\x00", "rare needle here x"])
def test_search_gives_the_rows_of_a_scan(spark, charts, path, term):
    assert listed(gi.search(spark, path, term)) == listed(ga.filter_charts(charts, search=term, search_columns=COLUMNS))


@pytest.mark.parametrize("chosen", [
    {}, {"family": "B"}, {"family": "absent"}, {"dataset": "?"}, {"dataset": "d1", "quality": "bad"}, {"dataset": "d9", "quality": "bad"}, {"quality": "(all)"},
    {"family": "P", "dataset": "d2", "quality": "(all)", "search": "ab"}, {"family": "L", "search": "needle"}, {"search": "nothing holds this"}])
def test_facets_and_selection_are_those_of_a_scan(spark, charts, path, chosen):
    term = chosen.get("search", "")
    own = {k: x for k, x in chosen.items() if k != "search"}
    assert listed(gi.facets(spark, path, term=term, **own)) == listed(ga.facets(charts, search=term, search_columns=COLUMNS, **own))
    assert listed(gi.selection(spark, path, term=term, **own)) == listed(ga.effective_selection(charts, search=term, search_columns=COLUMNS, **own))


def test_only_row_groups_with_the_trigrams_are_read(spark, path):
    plan = gi.candidates(spark, path, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram,eed)" in plan
    short = gi.candidates(spark, path, "né")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(gram,né)" in short
    # Facets without a term touch no text.
    counted = gi.facets(spark, path, family="B")._jdf.queryExecution().optimizedPlan().toString()
    assert "description" not in counted


def test_posting_lists_hold_every_place_once(spark, charts, path):
    postings = spark.read.parquet(f"{path}/postings").select("gram", "block", F.explode("places").alias("p"))
    assert postings.groupBy("gram", "block", "p").count().where("count > 1").isEmpty()
    assert postings.where("gram = 'aa\x00'").count() == len([r for r in charts.collect() if ga and " ".join(
        [str(r.chart_id), r.dataset_id or "", r.description or "", r.raw_type or "", r.family or ""]).lower().endswith("aa")])


def test_an_empty_collection(spark, charts, tmp_path):
    path = str(tmp_path / "none")
    gi.write_index(charts.limit(0).unionByName(charts.where("chart_id = 1001").limit(1)), path)
    assert gi.search(spark, path, "aa").count() == 1 and gi.search(spark, path, "b").count() == 0
    got = {(r.facet, r.value): r.charts for r in gi.facets(spark, path, quality="(all)").collect()}
    assert got["quality", "all"] == 1 and got["quality", "good"] == 0

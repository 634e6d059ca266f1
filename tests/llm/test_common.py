from pyspark.sql import functions as F

from chartspark.llm import common


def test_rows_are_chosen_by_number(spark, monkeypatch):
    monkeypatch.setattr(common, "RUN", 128)
    docs = spark.range(1000).select(F.col("id").alias("run"), F.lit("x").alias("place"), F.lit(None).cast("string").alias("a.b"))
    rows = common.numbered(docs, "test-rows")
    numbers = {r.n: r.doc.run for r in rows.select("doc", common.row_number().alias("n")).collect()}
    assert len(numbers) == 1000
    odd = spark.createDataFrame([(n,) for n, own in numbers.items() if own % 7 in (3, 5)] * 2, "row long")
    got, rest = common.where_row(rows, odd), common.where_row(rows, odd, stay=False)
    assert got.columns == docs.columns == rest.columns
    assert sorted(r.run for r in got.collect()) == [i for i in range(1000) if i % 7 in (3, 5)]
    assert sorted(r.run for r in rest.collect()) == [i for i in range(1000) if i % 7 not in (3, 5)]
    assert common.where_row(rows, odd.limit(0)).count() == 0 and common.where_row(rows, odd.limit(0), stay=False).count() == 1000
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rows_")]


def test_fresh_names():
    assert common.fresh(["a", "_ROW", "_row_"], "_row") == "_row__" and common.fresh([], "x") == "x"

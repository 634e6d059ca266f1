"""Values joined to stored rows by number, and both phases of an evaluation over a store."""

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from chartspark.operators import runs
from chartspark.operators import scoring as sc

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_values_meet_their_rows(spark):
    rows = spark.range(3000).repartition(5).withColumn("run", F.lit("r"))
    kept = runs.numbered(rows, "runs-test")
    values = kept.select(runs.row_number().alias("row"), (F.col("doc.id") * 2).alias("twice")).where("twice % 6 = 0")
    got = runs.flat(runs.with_values(kept, values, "v")).collect()
    assert sorted((r.id, r.run, r.twice) for r in got) == [(i, "r", 2 * i if i % 3 == 0 else None) for i in range(3000)]
    assert len({r._row for r in got}) == 3000
    assert runs.flat(runs.with_values(kept, values.limit(0), "v", "inner")).count() == 0


def answers():
    return lambda prompts: [{"text": p.rsplit("QUESTION:\n", 1)[1] + "!", "output_tokens": 1} for p in prompts]


def verdicts():
    return lambda prompts: ["true" if "ANSWER:\na!" in p else "false" for p in prompts]


def dead():
    def reply(prompts):
        raise RuntimeError("asked twice")

    return reply


ROWS = "graph_id string, dataset_id string, image string, dataset_description string, pos int, question struct<question: string, answer: string>"


def question_rows(spark):
    some = [(str(g), "s", None if g % 3 == 0 else f"i{g % 4}", None if g == 5 else f"text {g % 6}" * 50, p, ("ab"[p], "x")) for g in range(40) for p in range(2)]
    return spark.createDataFrame([*some, *some[:7], (None, None, None, None, 0, None)], ROWS)


def test_an_evaluation_over_a_store_has_the_rows_of_one_without(spark, tmp_path):
    rows, options = question_rows(spark), {"online": True, "order": ["pos", "graph_id"], "sleep": 0.0, "tries": 1}
    plain = sc.evaluated(rows, answers, verdicts, **options)
    first = sc.evaluated(rows, answers, verdicts, store=str(tmp_path / "s"), per_task=7, **options)
    again = sc.evaluated(rows, dead, dead, store=str(tmp_path / "s"), per_task=7, **options)
    assert plain.columns == first.columns == again.columns
    want = sorted(str(r) for r in plain.collect())
    assert len(want) == 88 and sorted(str(r) for r in first.collect()) == want and sorted(str(r) for r in again.collect()) == want


def test_rows_with_replies_of_a_store_are_not_shuffled(spark, tmp_path):
    """No exchange of the result carries the text, which is all of a wide row."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        for i, online in enumerate((False, True)):
            out = sc.evaluated(question_rows(spark), answers, verdicts, online, ["pos", "graph_id"], str(tmp_path / f"t{i}"), sleep=0.0, tries=1)
            plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
            moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
            assert moved and not [m for m in moved if "dataset_description" in m or "doc#" in m]
    finally:
        spark.conf.set(key, before)

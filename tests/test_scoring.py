"""Batch scoring: order, retries, failures, refinement, label retries."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from chartspark.operators import scoring as sc

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def flaky_model():
    calls = {"n": 0}

    def model(prompts):
        calls["n"] += 1
        if calls["n"] % 2:
            raise RuntimeError("busy")
        return [p.upper() for p in prompts]

    return model


def broken_model():
    def model(prompts):
        raise RuntimeError("down")

    return model


def short_model():
    return lambda prompts: ["only one"]


def test_retries_hide_a_busy_model(spark):
    df = spark.range(100).withColumn("p", F.concat(F.lit("p"), F.col("id").cast("string")))
    rows = sc.score(df, F.col("p"), flaky_model, sleep=0.0, batch_size=7).collect()
    assert all(r.reply.text == r.p.upper() and r.reply.error is None for r in rows) and len(rows) == 100


def test_failures_leave_null_and_error(spark):
    df = spark.range(5).withColumn("p", F.lit("x"))
    rows = sc.score(df, F.col("p"), broken_model, sleep=0.0, tries=1).collect()
    assert {(r.reply.text, r.reply.error, r.reply.cost) for r in rows} == {(None, "down", 0.0)}


def test_wrong_number_of_replies_is_a_failure_of_the_batch_only(spark):
    df = spark.range(4).coalesce(1).withColumn("p", F.lit("x"))
    rows = sc.score(df, F.col("p"), short_model, sleep=0.0, tries=1).collect()
    assert [r.reply.text for r in rows] == ["only one"] * 4


def always_wrong():
    return lambda prompts: [json.dumps({"feedback": "more", "correction": True}) for _ in prompts]


def add_mark():
    return lambda prompts: [p.rsplit("CODE:\n", 1)[1] + "!" for p in prompts]


def test_refinement_is_bounded(spark):
    charts = spark.createDataFrame([(1, "images/a_it0.png", "c", "s", "f", "h")], "chart_id int, image string, code string, spec string, features string, head string")
    rows = sorted(sc.refined(charts, always_wrong, add_mark, sleep=0.0).collect(), key=lambda r: r.round)
    assert [(r.round, r.image, r.code) for r in rows] == [(n, f"images/a_it{n}.png", "c" + "!" * n) for n in range(4)]


def unreadable():
    return lambda prompts: ["??" for _ in prompts]


def test_unreadable_review_ends_the_chart(spark):
    charts = spark.createDataFrame([(1, "i_it0.png", "c", "s", "f", "h")], "chart_id int, image string, code string, spec string, features string, head string")
    rows = sc.refined(charts, unreadable, add_mark, sleep=0.0).collect()
    assert [(r.round, r.feedback, r.correction) for r in rows] == [(0, None, None)]


def one_label():
    return lambda prompts: ['["trends"]' for _ in prompts]


def test_labels_that_never_fit_are_null(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"])], "id int, questions array<string>")
    got = {r.id: (r.labels, r.rounds) for r in sc.typed_questions(df, "questions", one_label, rounds=3, sleep=0.0).collect()}
    assert got == {1: (["trends"], 1), 2: (None, 3)}


def test_retries_stop_after_three(spark):
    df = spark.range(4)
    tries = []

    def attempt(rows, number):
        tries.append(number)
        return rows.withColumn("done", F.col("id") < number)

    got = {r.id: r.attempt for r in sc.with_retries(df, "id", attempt, F.col("done")).collect()}
    assert got == {0: 1, 1: 2, 2: 3} and tries == [1, 2, 3]


def counted_model(path):
    def factory():
        def model(prompts):
            with open(path, "a") as f:
                f.write("x")
            raise ConnectionError("down")

        return model

    return factory


def test_a_dead_server_is_not_asked_for_every_prompt(spark, tmp_path):
    df = spark.range(20).coalesce(1).withColumn("p", F.lit("x"))
    rows = sc.score(df, F.col("p"), counted_model(str(tmp_path / "calls")), sleep=0.0, tries=3, batch_size=10).collect()
    assert [(r.reply.text, r.reply.error) for r in rows] == [(None, "down")] * 20
    assert (tmp_path / "calls").read_text() == "x" * 6


def test_online_answering_needs_an_order(spark):
    with pytest.raises(ValueError, match="tell the questions"):
        sc.answered(spark.range(1), flaky_model, online=True)

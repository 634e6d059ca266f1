"""Accuracy and cost reports over graded answers.

A null `correct` is ignored by type, wrong per chart, and in the denominator per model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The question types every summary reports, then the overall row.
QUESTION_TYPES = ("metadata", "value extraction", "comparison", "trends", "reasoning")
FULL = "full"

ANSWER = ("chart_id", "question", "model", "correct")


def right(correct: str = "correct") -> Column:
    return F.coalesce(F.col(correct), F.lit(False))


def accuracy_by_type(df: DataFrame, by: Sequence[str] = ("model",), qtype: str = "qtype", correct: str = "correct") -> DataFrame:
    """Correct, incorrect and accuracy per question type plus the `full` row, zero-filled.

    Unknown and null types count only in `full`. A row typed `full` counts there twice, as
    every graded row does there once and its own type names the same line.
    One pass: two counters per reported line, so the shuffle carries one short row per group.
    """
    yes, no = F.col(correct), ~F.col(correct)
    lines = []
    counters = []
    for i, name in enumerate([*QUESTION_TYPES, FULL]):
        here = F.col(qtype).eqNullSafe(name)
        good, bad = F.count_if(yes & here), F.count_if(no & here)
        if name == FULL:
            good, bad = good + F.count_if(yes), bad + F.count_if(no)
        counters += [good.alias(f"_c{i}"), bad.alias(f"_i{i}")]
        lines.append(F.struct(F.lit(name).alias("type"), F.col(f"_c{i}").alias("correct"), F.col(f"_i{i}").alias("incorrect")))
    wide = df.groupBy(*by).agg(*counters)
    long = wide.select(*by, F.inline(F.array(*lines)))
    return long.withColumn("accuracy", F.try_divide("correct", F.col("correct") + F.col("incorrect")).cast("double"))


def chart_answer_counts(df: DataFrame, chart: str = "chart_id", correct: str = "correct") -> DataFrame:
    """Right and wrong answers per chart over all models; a missing verdict is wrong."""
    return df.groupBy(chart).agg(
        F.count_if(right(correct)).alias("correct"), F.count_if(~right(correct)).alias("incorrect")
    )


def model_accuracy_per_chart(df: DataFrame, chart: str = "chart_id", model: str = "model") -> DataFrame:
    """Share of right answers among all rows of a (chart, model)."""
    counted = df.groupBy(chart, model).agg(
        F.count_if(right()).alias("correct"), F.count(F.lit(1)).alias("total")
    )
    return counted.withColumn("accuracy", F.col("correct") / F.col("total"))


def top_models(df: DataFrame, chart: str = "chart_id", model: str = "model", n: int = 3) -> DataFrame:
    """Best models of each chart, most accurate first; names break ties."""
    scored = model_accuracy_per_chart(df, chart, model)
    order = Window.partitionBy(chart).orderBy(F.desc("accuracy"), F.asc(model))
    return scored.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= n)


def last_answers(df: DataFrame, keys: Sequence[str] = ("chart_id", "question", "model"), order: str = "row_id",
                 question: str = "question") -> DataFrame:
    """The last row per key in input order; rows without question text are dropped.

    An aggregate, not a window: each task keeps one row per key before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(F.col(order).alias("_order"), *[F.col(c) for c in rest])
    kept = (
        df.where(F.coalesce(F.col(question), F.lit("")) != "")
        .groupBy(*keys)
        .agg(F.max_by(packed, F.col(order)).alias("_row"))
    )
    return kept.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def questions_with_answers(questions: DataFrame, results: DataFrame, order: str = "row_id") -> DataFrame:
    """Each chart question with the last answer of each model; unanswered questions stay."""
    answers = last_answers(results.select(*ANSWER, order), order=order).select(
        F.col("chart_id").alias("_chart"), F.col("question").alias("_question"), "model", "correct",
        F.col(order).alias("answer_row"),
    )
    match = (questions["chart_id"] == answers["_chart"]) & (questions["question"] == answers["_question"])
    return questions.join(answers, match, "left").drop("_chart", "_question")


def question_accuracy(questions: DataFrame, results: DataFrame, order: str = "row_id") -> DataFrame:
    """Share of models that are right per question text of a chart; null without answers."""
    answers = last_answers(results.select(*ANSWER, order), order=order).groupBy(
        F.col("chart_id").alias("_chart"), F.col("question").alias("_question")
    ).agg(F.count(F.lit(1)).alias("answers"), F.count_if(right()).alias("right_answers"))
    match = (questions["chart_id"] == answers["_chart"]) & (questions["question"] == answers["_question"])
    joined = questions.join(answers, match, "left").drop("_chart", "_question")
    return joined.withColumns({
        "answers": F.coalesce("answers", F.lit(0)),
        "right_answers": F.coalesce("right_answers", F.lit(0)),
        "accuracy": F.try_divide("right_answers", "answers").cast("double"),
    })


def answer_agreement(questions: DataFrame, results: DataFrame, order: str = "row_id") -> DataFrame:
    """`question_accuracy` with flags for questions that no model, or every model, got right."""
    scored = question_accuracy(questions, results, order)
    return scored.withColumns({
        "none_right": (F.col("answers") > 0) & (F.col("right_answers") == 0),
        "all_right": (F.col("answers") > 0) & (F.col("right_answers") == F.col("answers")),
    })


def leaderboard(df: DataFrame, model: str = "model") -> DataFrame:
    """One row per model: rank by overall accuracy, then accuracy of every type."""
    lines = [*QUESTION_TYPES, FULL]
    wide = accuracy_by_type(df, [model]).groupBy(model).pivot("type", lines).agg(F.max("accuracy"))
    named = wide.select(model, *[F.col(f"`{n}`").alias(n.replace(" ", "_")) for n in lines])
    # One row per model is left, so this ranking is a short sort.
    return named.withColumn("place", F.rank().over(Window.orderBy(F.desc_nulls_last(FULL))).cast("long"))


def usage_totals(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Token and cost sums; a missing count is zero."""
    return df.groupBy(*by).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"{c}_total") for c in columns])


def charts_with_counts(charts: DataFrame, counts: DataFrame, chart: str = "chart_id") -> DataFrame:
    """All charts with their answer counts; charts without results get zeros."""
    joined = charts.join(counts, chart, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("correct", "incorrect")})


def results_of_known_charts(results: DataFrame, charts: DataFrame, chart: str = "chart_id", dataset: str = "dataset_id") -> DataFrame:
    """Results joined to the dataset of their chart; results of unknown charts are dropped.

    Plain equi-join: adaptive execution broadcasts the chart side only when its measured
    size is small, and splits a hot chart otherwise.
    """
    return results.join(charts.select(chart, dataset), chart, "inner")

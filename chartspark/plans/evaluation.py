"""Queries: accuracy, agreement and cost over graded answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark.operators import evaluation as ev
from chartspark.operators import ordering
from chartspark.plans import views as v
from chartspark.plans.registry import register

ACCURACY = "case when c + i = 0 then null else c / cast(c + i as double) end"

BY_TYPE = v.ctes(v.RESULTS) + """, lines as (
  select unnest(['metadata','value extraction','comparison','trends','reasoning']) as type),
counted as (
  select model, qtype as type, count(*) filter (where correct) as c, count(*) filter (where not correct) as i
  from results_v group by 1, 2
  union all
  select model, 'full', count(*) filter (where correct), count(*) filter (where not correct)
  from results_v group by 1),
grid as (select model, type from (select distinct model from results_v) m cross join
         (select type from lines union all select 'full') t),
summary as (select g.model, g.type, cast(coalesce(c, 0) as bigint) as c, cast(coalesce(i, 0) as bigint) as i
            from grid g left join counted k on g.model = k.model and g.type = k.type)
"""


@register("agg1_accuracy_by_type", BY_TYPE + f"""
select model, type, c as correct, i as incorrect, round({ACCURACY}, 9) as accuracy from summary""")
def accuracy_by_type(spark, sf):
    out = ev.accuracy_by_type(v.results_v(spark, sf))
    return out.withColumn("accuracy", F.round("accuracy", 9))


@register("agg2_chart_answer_counts", v.ctes(v.RESULTS) + """
select chart_id, count(*) filter (where coalesce(correct, false)) as correct,
       count(*) filter (where not coalesce(correct, false)) as incorrect
from results_v group by chart_id""")
def chart_answer_counts(spark, sf):
    return ev.chart_answer_counts(v.results_v(spark, sf))


PER_CHART = v.ctes(v.RESULTS) + """, scored as (
  select chart_id, model, count(*) filter (where coalesce(correct, false)) as correct, count(*) as total,
         count(*) filter (where coalesce(correct, false)) / cast(count(*) as double) as accuracy
  from results_v group by 1, 2)
"""


@register("agg3_model_accuracy_per_chart", PER_CHART + """
select chart_id, model, correct, total, round(accuracy, 9) as accuracy from scored""")
def model_accuracy_per_chart(spark, sf):
    out = ev.model_accuracy_per_chart(v.results_v(spark, sf))
    return out.withColumn("accuracy", F.round("accuracy", 9))


@register("srt8_top_models", PER_CHART + """, placed as (
  select *, row_number() over (partition by chart_id order by accuracy desc, model) as place from scored)
select chart_id, model, correct, total, round(accuracy, 9) as accuracy, place from placed where place <= 3""")
def top_models(spark, sf):
    out = ev.top_models(v.results_v(spark, sf), n=3)
    return out.withColumn("accuracy", F.round("accuracy", 9))


LAST = """last_rows as (
  select * from (select *, row_number() over (partition by chart_id, question, model order by row_id desc) as rn
                 from results_v) r where rn = 1),
per_question as (
  select chart_id, question, count(*) as answers, count(*) filter (where coalesce(correct, false)) as right_answers
  from last_rows group by 1, 2)"""


def questions(spark, sf):
    exploded = v.records_v(spark, sf).select(
        F.col("id").cast("long").alias("chart_id"), F.posexplode("graph.questions").alias("pos", "q")
    )
    return exploded.select("chart_id", F.col("pos").cast("long").alias("pos"), "q.question", F.col("q.type").alias("qtype"))


@register("joi3_questions_with_answers", v.ctes(v.RESULTS, v.REC_QUESTIONS, LAST) + """
select q.chart_id, q.pos, q.question, q.qtype, l.model, l.correct, l.row_id as answer_row
from rec_questions q left join last_rows l on q.chart_id = l.chart_id and q.question = l.question""")
def questions_with_answers(spark, sf):
    return ev.questions_with_answers(questions(spark, sf), v.results_v(spark, sf))


QUESTION_ACC = v.ctes(v.RESULTS, v.REC_QUESTIONS, LAST) + """, scored as (
  select q.chart_id, q.pos, q.question, q.qtype, coalesce(p.answers, 0) as answers,
         coalesce(p.right_answers, 0) as right_answers,
         round(p.right_answers / cast(p.answers as double), 9) as accuracy
  from rec_questions q left join per_question p on q.chart_id = p.chart_id and q.question = p.question)
"""


@register("agg4_question_accuracy", QUESTION_ACC + "select * from scored")
def question_accuracy(spark, sf):
    out = ev.question_accuracy(questions(spark, sf), v.results_v(spark, sf))
    return out.withColumn("accuracy", F.round("accuracy", 9))


@register("agg17_answer_agreement", QUESTION_ACC + """
select *, answers > 0 and right_answers = 0 as none_right,
       answers > 0 and right_answers = answers as all_right from scored""")
def answer_agreement(spark, sf):
    out = ev.answer_agreement(questions(spark, sf), v.results_v(spark, sf))
    return out.withColumn("accuracy", F.round("accuracy", 9))


@register("agg16_leaderboard", BY_TYPE + f""", acc as (select model, type, round({ACCURACY}, 9) as a from summary),
wide as (
  select model, max(a) filter (where type = 'metadata') as metadata,
         max(a) filter (where type = 'value extraction') as value_extraction,
         max(a) filter (where type = 'comparison') as comparison, max(a) filter (where type = 'trends') as trends,
         max(a) filter (where type = 'reasoning') as reasoning, max(a) filter (where type = 'full') as "full"
  from acc group by model)
select *, rank() over (order by "full" desc nulls last) as place from wide""")
def leaderboard(spark, sf):
    out = ev.leaderboard(v.results_v(spark, sf))
    accuracies = [c for c in out.columns if c not in ("model", "place")]
    return out.withColumns({c: F.round(c, 9) for c in accuracies})


@register("agg11_usage_totals", v.ctes(v.RESULTS) + """
select model, coalesce(qtype, 'none') as phase,
       cast(sum(coalesce(k, 0)) as bigint) as input_tokens_total,
       cast(sum(coalesce(case when k % 3 = 0 then null else k end, 0)) as bigint) as cached_tokens_total,
       round(sum(value), 4) as cost_total
from results_v group by 1, 2""")
def usage_totals(spark, sf):
    usage = v.results_v(spark, sf).select(
        "model", F.coalesce("qtype", F.lit("none")).alias("phase"), F.col("k").cast("long").alias("input_tokens"),
        F.when(F.col("k") % 3 != 0, F.col("k")).cast("long").alias("cached_tokens"), F.col("value").alias("cost"),
    )
    out = ev.usage_totals(usage, ["model", "phase"], ["input_tokens", "cached_tokens", "cost"])
    return out.withColumn("cost_total", F.round("cost_total", 4))


@register("joi1_results_of_known_charts", v.ctes(v.RESULTS, v.CHARTS) + """
select r.chart_id, r.model, r.row_id, r.question, r.qtype, r.correct, c.dataset_id
from results_v r join charts_v c on r.chart_id = c.chart_id""")
def results_of_known_charts(spark, sf):
    results = v.results_v(spark, sf).select("chart_id", "model", "row_id", "question", "qtype", "correct")
    return ev.results_of_known_charts(results, v.charts_v(spark, sf))


@register("joi2_charts_with_counts", v.ctes(v.RESULTS, v.CHARTS) + """, counts as (
  select chart_id, count(*) filter (where coalesce(correct, false)) as correct,
         count(*) filter (where not coalesce(correct, false)) as incorrect from results_v group by 1)
select c.chart_id, c.dataset_id, coalesce(k.correct, 0) as correct, coalesce(k.incorrect, 0) as incorrect
from charts_v c left join counts k on c.chart_id = k.chart_id""")
def charts_with_counts(spark, sf):
    charts = v.charts_v(spark, sf).select("chart_id", "dataset_id")
    return ev.charts_with_counts(charts, ev.chart_answer_counts(v.results_v(spark, sf)))


@register("win4_running_usage", v.ctes(v.RESULTS) + """
select row_id, model, cast(sum(coalesce(k, 0)) over (order by row_id) as bigint) as tokens_so_far,
       round(sum(value) over (order by row_id), 3) as cost_so_far from results_v""")
def running_usage(spark, sf):
    results = v.results_v(spark, sf).select("row_id", "model", "k", "value")
    totals = {
        "tokens_so_far": F.coalesce(F.col("k"), F.lit(0)),
        "cost_so_far": F.coalesce(F.col("value"), F.lit(0.0)).cast("decimal(18,6)"),
    }
    out = ordering.running(results, [], ["row_id"], totals)
    return out.select("row_id", "model", F.col("tokens_so_far").cast("long").alias("tokens_so_far"),
                      F.round(F.col("cost_so_far").cast("double"), 3).alias("cost_so_far"))

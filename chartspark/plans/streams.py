"""Queries: streams over folders of files, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark.functions.images import typed_images
from chartspark.operators.columns import evaluation_rows
from chartspark.plans import views as v
from chartspark.plans.evaluation import ACCURACY, BY_TYPE
from chartspark.plans.registry import register
from chartspark.schemas import RECORD
from chartspark.session import scratch_dir
from chartspark.sources import writers as wr
from chartspark.streaming import live


def finished(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


@register("str1_live_accuracy", BY_TYPE + f"""
select model, type, c as correct, i as incorrect, round({ACCURACY}, 9) as accuracy from summary""")
def live_accuracy(spark, sf):
    source, report = scratch_dir(spark, "graded"), scratch_dir(spark, "accuracy")
    wr.append_jsonl(v.results_v(spark, sf).repartition(4).select("model", "qtype", "correct"), source)
    results = live.stream_jsonl(spark, source, "model string, qtype string, correct boolean", files_per_batch=2)
    finished(live.write_latest(live.live_accuracy(results), report, scratch_dir(spark, "state")))
    return live.read_latest(spark, report).withColumn("accuracy", F.round("accuracy", 9))


@register("str2_shard_ingest", v.ctes(v.REC_QUESTIONS) + """
select cast(chart_id as varchar) as graph_id, dataset_id, cast(pos as integer) as pos, question, qtype,
       case when chart_id % 5 > 0 then 'images/' || chart_id || '_it' || (chart_id % 5 - 1) || '.png' end as image
from rec_questions""")
def shard_ingest(spark, sf):
    """Two shards, the second one arriving after the first run: each file is taken once."""
    source, target, state = (scratch_dir(spark, n) for n in ("shards", "questions", "state"))
    records = v.records_v(spark, sf)
    early = F.col("id").cast("long") % 2 == 0

    def flatten(raw):
        return evaluation_rows(raw.withColumn("images", typed_images(F.col("images"))))

    for part in (early, ~early):
        wr.append_jsonl(records.where(part), source)
        finished(live.ingest(live.stream_jsonl(spark, source, RECORD), target, state, flatten))
    rows = spark.read.parquet(target)
    return rows.select("graph_id", "dataset_id", "pos", "question.question", F.col("question.type").alias("qtype"), "image")


@register("str3_live_usage", v.ctes(v.RESULTS) + """
select model, coalesce(qtype, 'none') as phase, cast(sum(k) as bigint) as input_tokens_total, round(sum(value), 4) as cost_total
from results_v group by 1, 2""")
def live_usage(spark, sf):
    source, report = scratch_dir(spark, "usage"), scratch_dir(spark, "totals")
    usage = v.results_v(spark, sf).select(
        "model", F.coalesce("qtype", F.lit("none")).alias("phase"), F.col("k").cast("long").alias("input_tokens"), F.col("value").alias("cost"))
    wr.append_jsonl(usage.repartition(3), source)
    rows = live.stream_jsonl(spark, source, "model string, phase string, input_tokens bigint, cost double", files_per_batch=1)
    finished(live.write_latest(live.live_usage(rows), report, scratch_dir(spark, "state")))
    return live.read_latest(spark, report).withColumn("cost_total", F.round("cost_total", 4))

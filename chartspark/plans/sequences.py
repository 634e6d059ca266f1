"""Queries: refinement rounds, prompt prefixes, ordered groups and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark.operators import sequences as sq
from chartspark.plans import views as v
from chartspark.plans.registry import register
from chartspark.session import scratch_dir
from chartspark.sources import upsert as up

ONCE = v.ctes(v.IMAGES) + """, twice as (
  select * from images_v union all select chart_id, pos + 1000, path, 'again' from images_v),
once as (select * from (select *, row_number() over (partition by chart_id, path order by pos) as rn from twice) t where rn = 1)
"""


def doubled_images(spark, sf):
    images = v.images_v(spark, sf)
    again = images.select("chart_id", (F.col("pos") + 1000).alias("pos"), "path", F.lit("again").alias("feedback"))
    return images.union(again)


@register("agg14_iterations", ONCE + """
select chart_id, pos, path, feedback, pos as iteration,
       row_number() over (partition by chart_id order by pos) - 1 as step,
       'it' || (row_number() over (partition by chart_id order by pos) - 1) as label,
       row_number() over (partition by chart_id order by pos desc) = 1 as is_last
from once""")
def iterations(spark, sf):
    return sq.iterations(doubled_images(spark, sf))


@register("win5_iteration_labels", ONCE + """
select chart_id, path, 'it' || (row_number() over (partition by chart_id order by pos) - 1) as label from once""")
def iteration_labels(spark, sf):
    return sq.iterations(doubled_images(spark, sf), block=2).select("chart_id", "path", "label")


@register("win6_refinement", v.ctes(v.IMAGES) + """
select chart_id, count(*) as rounds, min(case when trim(feedback) = '' then pos end) as first_clean,
       trim(arg_max(feedback, pos)) = '' as cleared, count(*) filter (where trim(feedback) <> '') as open_rounds
from images_v group by 1""")
def refinement(spark, sf):
    return sq.refinement(v.images_v(spark, sf))


@register("win6_feedback_changes", v.ctes(v.IMAGES) + """, seen as (
  select chart_id, pos, trim(feedback) = '' as clean, length(feedback) as chars,
         lag(trim(feedback) = '') over w as before, lag(length(feedback)) over w as chars_before
  from images_v window w as (partition by chart_id order by pos))
select chart_id, pos, clean, coalesce(not before and clean, false) as cleared_now, chars - chars_before as chars_change
from seen""")
def feedback_changes(spark, sf):
    return sq.feedback_changes(v.images_v(spark, sf), block=2)


PREFIX = v.ctes(v.RESULTS) + """, keyed as (select row_id, model as dataset_id, cast(k // 50 as varchar) as image from results_v),
flagged as (select *, not coalesce(lag(dataset_id) over (order by row_id) = dataset_id
                                   and lag(image) over (order by row_id) = image, false) as new_prefix from keyed),
numbered as (select *, cast(sum(case when new_prefix then 1 else 0 end) over (order by row_id) as bigint) as prefix_block from flagged)
"""


def keyed_rows(spark, sf):
    return v.results_v(spark, sf).select(
        "row_id", F.col("model").alias("dataset_id"), F.floor(F.col("k") / 50).cast("string").alias("image")
    )


@register("win1_new_prefix", PREFIX + "select row_id, dataset_id, image, new_prefix from flagged")
def new_prefix(spark, sf):
    return sq.prefix_flags(keyed_rows(spark, sf))


@register("win2_prefix_blocks", PREFIX + """
select *, row_number() over (partition by prefix_block order by row_id) - 1 as place,
       row_number() over (partition by prefix_block order by row_id) = 1 as warms_cache from numbered""")
def prefix_blocks(spark, sf):
    return sq.prefix_blocks(keyed_rows(spark, sf))


@register("agg13_group_lists", v.ctes(v.CHARTS) + """, placed as (
  select dataset_id, chart_id, row_number() over (partition by dataset_id order by chart_id) - 1 as place from charts_v)
select dataset_id, cast(place // 50 as bigint) as part, string_agg(cast(chart_id as varchar), ',' order by place) as charts
from placed group by 1, 2""")
def group_lists(spark, sf):
    charts = v.charts_v(spark, sf).select("chart_id", "dataset_id")
    listed = sq.group_lists(charts, ["dataset_id"], "chart_id", F.col("chart_id").cast("string"), size=50)
    return listed.select("dataset_id", "part", F.array_join("items", ",").alias("charts"))


SHARDS = """shards as (
  select 0 as shard, doc_id as id, source, text, null as lang from documents where doc_id % 3 <> 0
  union all select 1, doc_id, source, text, lang from documents)"""


def shards(spark, sf):
    docs = v.table(spark, sf, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), "source", "text", "lang")
    # The second shard is the whole table, the first lacks the identifiers that are to come from the second alone.
    return [rows.where("id % 3 <> 0").drop("lang"), rows]


@register("set1_union_shards", v.ctes(SHARDS) + "select shard, id, source, text, lang from shards")
def union_shards(spark, sf):
    return sq.union_shards(shards(spark, sf))


UNION_ONCE = v.ctes(SHARDS) + """
select id, source, text, lang from (select *, row_number() over (partition by id order by shard) as rn from shards) s where rn = 1"""


@register("set2_union_once", UNION_ONCE)
def union_once(spark, sf):
    return sq.union_once(shards(spark, sf), "id", "source")


@register("set2_incremental_union", UNION_ONCE)
def incremental_union(spark, sf):
    """The second shard comes first, the first one in two uneven parts after it; a part that comes again changes nothing."""
    path = scratch_dir(spark, "union")
    first, second = shards(spark, sf)
    early = F.col("id") % 10 == 1
    up.upsert(second, path, "id", "source", 1, buckets=16)
    for part in (first.where(early), first.where(~early), first.where(early)):
        up.upsert(part, path, "id", "source", 0, buckets=16)
    return up.read(spark, path).select("id", "source", "text", "lang")


@register("set3_feature_differences", """
with f as (select doc_id, [source, lang, 'n_chars'] as expected, ['lang', 'n_chars', 'source', lang] as cols,
                  [source, 'x'] as used, [lang, source, 'x', 'y'] as plotted from documents)
select doc_id, array_to_string(list_filter(list_distinct(expected), lambda x: not list_contains(cols, x)), ',') as missing,
       array_to_string(list_filter(plotted, lambda x: not list_contains(used, x)), ',') as extra from f""")
def feature_differences(spark, sf):
    docs = v.table(spark, sf, "documents")
    out = sq.feature_differences(
        F.array(F.col("source"), F.col("lang"), F.lit("n_chars")), F.array(F.lit("lang"), F.lit("n_chars"), F.lit("source"), F.col("lang")),
        F.array(F.col("source"), F.lit("x")), F.array(F.col("lang"), F.col("source"), F.lit("x"), F.lit("y")),
    )
    rows = docs.select("doc_id", F.inline(F.array(out)))
    return rows.select("doc_id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


@register("agg12_question_types", v.ctes(v.REC_QUESTIONS) + "select qtype, count(*) as questions from rec_questions group by 1")
def question_types(spark, sf):
    rows = v.records_v(spark, sf).select(F.explode("graph.questions.type").alias("qtype"))
    return rows.groupBy("qtype").agg(F.count(F.lit(1)).alias("questions"))

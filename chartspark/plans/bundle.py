"""Queries: image resolution, chart index, rollups, manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark.functions import images as im
from chartspark.operators import bundle as bu
from chartspark.operators import evaluation as ev
from chartspark.plans import views as v
from chartspark.plans.registry import register
from chartspark.plans.text import FIRST, spelling_sql

BASE = "http://host/data/"

LISTING = """listing as (
  select path, cast(length(feedback) + 100 as bigint) as length from (
    select case when pos % 2 = 0 then path else 'other/' || split_part(path, '/', -1) end as path, feedback, pos from rec_images) f
  where pos <> 3)"""

SHOWN = """shown as (
  select doc_id as chart_id, pos, case when pos % 2 = 0 then 'old/' || split_part(path, '/', -1) else path end as path from rec_images)"""

SOLVED = v.ctes(v.RESULTS, v.CHARTS, v.REC_IMAGES, LISTING, SHOWN) + """, solved as (
  select s.chart_id, s.pos, s.path, coalesce(e.path, n.path) as source, coalesce(e.length, n.length) as length
  from shown s left join listing e on s.path = e.path
  left join listing n on 'images/' || split_part(s.path, '/', -1) = n.path),
avail as (select chart_id, count(source) as found, count(*) filter (where source is null) as missing,
                 cast(coalesce(sum(length), 0) as bigint) as image_bytes from solved group by 1)
"""


def record_images(spark, sf):
    exploded = v.records_v(spark, sf).select(
        F.col("id").cast("long").alias("chart_id"), F.posexplode("images").alias("pos", "image")
    )
    return exploded.select("chart_id", F.col("pos").cast("long").alias("pos"), "image.path", "image.feedback")


def shown_images(spark, sf):
    moved = F.concat(F.lit("old/"), F.substring_index("path", "/", -1))
    path = F.when(F.col("pos") % 2 == 0, moved).otherwise(F.col("path"))
    return record_images(spark, sf).select("chart_id", "pos", path.alias("path"))


def listing(spark, sf):
    other = F.concat(F.lit("other/"), F.substring_index("path", "/", -1))
    path = F.when(F.col("pos") % 2 == 0, F.col("path")).otherwise(other)
    stored = record_images(spark, sf).where(F.col("pos") != 3)
    return stored.select(path.alias("path"), (F.length("feedback") + 100).cast("long").alias("length"))


@register("joi5_resolve_images", SOLVED + "select * from solved")
def resolve_images(spark, sf):
    return bu.resolve_images(shown_images(spark, sf), listing(spark, sf))


@register("joi6_image_availability", SOLVED + "select * from avail")
def image_availability(spark, sf):
    return bu.image_availability(shown_images(spark, sf), listing(spark, sf))


@register("val8_missing_files", SOLVED + "select chart_id, pos, path from solved where source is null")
def missing_files(spark, sf):
    return bu.missing_files(shown_images(spark, sf), listing(spark, sf))


INDEX = SOLVED + f""", counts as (
  select chart_id, count(*) filter (where coalesce(correct, false)) as correct,
         count(*) filter (where not coalesce(correct, false)) as incorrect from results_v group by 1),
base as (
  select cast(d.doc_id as varchar) as id, d.source as dataset_id, d.text as dataset_description,
         c.raw_type as graph_type, concat_ws(' ', d.source, d.lang) as short_description,
         case when d.doc_id % 5 > 0 then 'images/' || d.doc_id || '_it' || (d.doc_id % 5 - 1) || '.png' end as final_path,
         case when d.doc_id % 5 = 4 and (d.doc_id + 3) % 3 <> 0 then 'bad' else 'good' end as quality,
         coalesce(k.correct, 0) as correct, coalesce(k.incorrect, 0) as incorrect
  from documents d join charts_v c on d.doc_id = c.chart_id left join counts k on d.doc_id = k.chart_id),
stored as (select b.*, l.path is not null as stored, 'thumbnails/' || dataset_id || '/' || id || '.jpg' as th,
                  'charts/' || dataset_id || '/' || id || '/' as de
           from base b left join listing l on b.final_path = l.path),
idx as (
  select id, dataset_id, dataset_description, {spelling_sql('graph_type')} as canonical_type, graph_type, short_description,
         case when stored then th end as thumbnail, case when stored then 'http://host/data/' || th end as thumbnail_url,
         de as detail, 'http://host/data/' || de as detail_url, de || 'metadata.json' as metadata,
         'http://host/data/' || de || 'metadata.json' as metadata_url, de || 'results.jsonl.gz' as results,
         'http://host/data/' || de || 'results.jsonl.gz' as results_url,
         coalesce(final_path, 'images/') as final_image, quality, correct, incorrect from stored)
"""


def index(spark, sf, base_url=BASE):
    records = v.records_v(spark, sf).select(
        F.col("id").cast("long").alias("chart_id"), "id", F.col("dataset.id").alias("dataset_id"),
        F.col("dataset.description").alias("dataset_description"), F.col("graph.type").alias("graph_type"),
        F.col("graph.short_description").alias("short_description"),
        im.final_image(F.col("images"))["path"].alias("final_path"), im.quality(F.col("images")).alias("quality"),
    )
    counted = ev.charts_with_counts(records, ev.chart_answer_counts(v.results_v(spark, sf)))
    resolved = bu.resolve_images(counted.withColumnRenamed("final_path", "path"), listing(spark, sf))
    return bu.chart_index(resolved.withColumnsRenamed({"path": "final_path", "source": "final_source"}), base_url)


@register("bundle_chart_index", INDEX + "select * from idx")
def chart_index(spark, sf):
    return index(spark, sf)


@register("prj14_detail_urls", INDEX + """
select id, case when cast(id as bigint) % 2 = 0 then detail_url else 'http://host/data/' || detail end as detail_url,
       metadata_url, case when cast(id as bigint) % 2 = 0 then results_url else 'http://host/data/' || detail || 'results.jsonl.gz' end as results_url
from idx""")
def detail_urls(spark, sf):
    even = F.col("id").cast("long") % 2 == 0
    holed = index(spark, sf).withColumns({c: F.when(even, F.col(c)) for c in ("detail_url", "detail", "results_url")})
    return bu.detail_urls(holed, BASE)


SIZED = SOLVED + """, sized as (
  select c.chart_id, c.dataset_id, c.description as text, coalesce(r.n, 0) as n, coalesce(a.found, 0) as found,
         coalesce(a.image_bytes, 0) as image_bytes
  from charts_v c left join (select chart_id, count(*) as n from results_v group by 1) r on c.chart_id = r.chart_id
  left join avail a on c.chart_id = a.chart_id)
"""


def sized(spark, sf):
    charts = v.charts_v(spark, sf).select("chart_id", "dataset_id", "description")
    return bu.chart_sizes(charts, v.results_v(spark, sf), shown_images(spark, sf), listing(spark, sf))


@register("agg9_chart_entries", SIZED + """
select dataset_id, cast(chart_id as varchar) as id, 'charts/' || dataset_id || '/' || chart_id || '/' as detail,
       'charts/' || dataset_id || '/' || chart_id || '/metadata.json' as metadata,
       'charts/' || dataset_id || '/' || chart_id || '/results.jsonl.gz' as results,
       cast(image_bytes as bigint) as detail_bytes, n as result_record_count, found as image_count from sized""")
def chart_entries(spark, sf):
    return bu.chart_entries(sized(spark, sf))


@register("agg9_dataset_rollup", SIZED + f""",
rolled as (select dataset_id, arg_min(text, chart_id) as text, count(*) as chart_count, cast(sum(found) as bigint) as image_count,
                  cast(sum(n) as bigint) as result_record_count, cast(sum(image_bytes) as bigint) as detail_bytes from sized group by 1)
select dataset_id, text as description, case when {FIRST} = '' then '(no description)' else left({FIRST}, 120) end as label,
       chart_count, image_count, result_record_count, detail_bytes,
       'datasets/' || dataset_id || '.json' as manifest, 'http://host/data/datasets/' || dataset_id || '.json' as manifest_url,
       'datasets/' || dataset_id || '.charts.jsonl' as charts, 'http://host/data/datasets/' || dataset_id || '.charts.jsonl' as charts_url
from rolled""")
def dataset_rollup(spark, sf):
    return bu.dataset_rollup(sized(spark, sf), base_url=BASE)


@register("agg10_manifest", INDEX + """
select 1 as schema_version, 'http://host/data/' as base_url, 'charts.jsonl.gz' as chart_index, 'http://host/data/charts.jsonl.gz' as chart_index_url,
       (select count(distinct dataset_id) from idx) as dataset_count, (select count(*) from idx) as chart_count,
       'shuffle' as chart_order, 42 as shuffle_seed,
       (select cast(count(distinct model) as integer) from results_v) as model_count,
       (select string_agg(model, ',' order by model) from (select distinct model from results_v) m) as models,
       (select string_agg(canonical_type || '=' || n, ',' order by canonical_type)
        from (select canonical_type, count(*) as n from idx group by 1) t) as canonical_type_counts""")
def manifest(spark, sf):
    out = bu.manifest(index(spark, sf), v.results_v(spark, sf), BASE)
    pairs = F.transform(F.map_entries("canonical_type_counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return out.withColumns({"models": F.array_join("models", ","), "canonical_type_counts": F.array_join(pairs, ",")})


@register("agg10_families", INDEX + "select canonical_type, count(*) as chart_count from idx group by 1")
def families(spark, sf):
    return bu.manifest_families(index(spark, sf))


@register("agg10_models", INDEX + "select distinct model from results_v")
def models(spark, sf):
    return bu.manifest_models(v.results_v(spark, sf))


@register("prj13_rewritten_records", v.ctes(v.RESULTS, v.CHARTS, v.REC_IMAGES, LISTING) + """, plain as (
  select r.*, case when l.path is not null then replace(r.path, '.png', '.jpg') else r.path end as shown from rec_images r left join listing l on r.path = l.path)
select cast(doc_id as varchar) as id, '{"level":2,"none":null}' as extra, cast(pos as integer) as pos,
       '{"code":"df[\\"' || source || '\\"].plot(\\"v' || pos || '\\")","feedback":"' || feedback || '","path":"' || shown || '"}' as image
from plain union all
select cast(doc_id as varchar), '{"level":2,"none":null}', cast(doc_id % 5 + o.pos as integer), replace(o.image, '#', cast(doc_id as varchar))
from documents, (values (0, '{"feedback":["a"," b "],"path":"images/#-x.png","w":3.5}'), (1, '{"w":[1,null]}'), (2, '{"path":7}')) o(pos, image)""")
def rewritten_records(spark, sf):
    resolved = bu.resolve_images(record_images(spark, sf), listing(spark, sf), folder="none/")
    return v.stored_images(bu.rewritten_records(v.stored_records_v(spark, sf), resolved))

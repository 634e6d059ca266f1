"""Queries: browsing a chart collection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark.functions import images as im
from chartspark.functions.taxonomy import family_by_rules
from chartspark.operators import evaluation as ev
from chartspark.operators import gallery as ga
from chartspark.operators import gallery_index as gi
from chartspark.operators import sampling as sa
from chartspark.plans import views as v
from chartspark.plans.registry import register
from chartspark.plans.text import SENTENCE, rules_sql, type_text_sql
from chartspark.session import scratch_dir


def collection_v(spark, sf):
    """Charts with family, quality and short description."""
    records = v.records_v(spark, sf).select(
        F.col("id").cast("long").alias("chart_id"), F.col("dataset.id").alias("dataset_id"),
        F.col("graph.type").alias("raw_type"), F.col("dataset.description").alias("description"),
        F.col("graph.short_description").alias("short_description"), im.quality(F.col("images")).alias("quality"),
    )
    return records.withColumn("family", family_by_rules(F.col("raw_type")))


COLLECTION = v.ctes(v.RESULTS, v.CHARTS) + f""", typed as (select *, {type_text_sql('raw_type')} as tt from charts_v),
collection as (
  select t.chart_id, t.dataset_id, t.raw_type, t.description, concat_ws(' ', d.source, d.lang) as short_description,
         case when d.doc_id % 5 = 4 and (d.doc_id + 3) % 3 <> 0 then 'bad' else 'good' end as quality,
         {rules_sql('tt', 'raw_type')} as family
  from typed t join documents d on t.chart_id = d.doc_id),
counts as (select chart_id, count(*) filter (where coalesce(correct, false)) as correct,
                  count(*) filter (where not coalesce(correct, false)) as incorrect from results_v group by 1)
"""

BLOB = "lower(concat_ws(' ', cast(chart_id as varchar), coalesce(dataset_id, ''), coalesce(description, ''), coalesce(raw_type, ''), coalesce(family, '')))"


@register("flt1_filter_charts", COLLECTION + """
select 'family' as term, chart_id, dataset_id, family, quality from collection where family = 'Pie / Donut'
union all select 'dataset', chart_id, dataset_id, family, quality from collection where dataset_id = 'src3'
union all select 'quality', chart_id, dataset_id, family, quality from collection where quality = 'bad'
union all select 'two', chart_id, dataset_id, family, quality from collection where family = 'Heatmap' and quality = 'good'""")
def filter_charts(spark, sf):
    charts = collection_v(spark, sf)
    terms = {"family": {"family": "Pie / Donut"}, "dataset": {"dataset": "src3"}, "quality": {"quality": "bad"}, "two": {"family": "Heatmap", "quality": "good"}}
    sets = [ga.filter_charts(charts, **chosen).select(F.lit(name).alias("term"), "chart_id", "dataset_id", "family", "quality") for name, chosen in terms.items()]
    return sets[0].unionByName(sets[1]).unionByName(sets[2]).unionByName(sets[3])


@register("flt2_search", COLLECTION + f"""
select chart_id, family from collection where contains({BLOB}, 'plot')
union all select chart_id + 1000000000, family from collection where contains({BLOB.replace("coalesce(dataset_id, ''), ", "")}, 'the on')""")
def search(spark, sf):
    charts = collection_v(spark, sf)
    wide = ga.filter_charts(charts, search=" Plot ", search_columns=("chart_id", "dataset_id", "description", "raw_type", "family"))
    local = ga.filter_charts(charts, search="The On", search_columns=("chart_id", "description", "raw_type", "family"))
    return wide.select("chart_id", "family").union(local.select(F.col("chart_id") + 1_000_000_000, "family"))


CATALOGUE = """catalogue as (
  select doc_id as did, case doc_id % 7 when 0 then 'abc' when 1 then null else cast(n_chars + 0.5 as varchar) end as n_rows,
         cast(doc_id % 2100 as varchar) as n_features, case doc_id % 3 when 0 then 'arff' when 1 then 'ARFF' else lang end as format
  from documents)"""


def catalogue(spark, sf):
    seventh, third = F.col("doc_id") % 7, F.col("doc_id") % 3
    return v.table(spark, sf, "documents").select(
        F.col("doc_id").alias("did"),
        F.when(seventh == 0, "abc").when(seventh != 1, (F.col("n_chars") + 0.5).cast("string")).alias("NumberOfInstances"),
        (F.col("doc_id") % 2100).cast("string").alias("NumberOfFeatures"),
        F.when(third == 0, "arff").when(third == 1, "ARFF").otherwise(F.col("lang")).alias("format"),
    )


SIZED = """sized as (
  select * from catalogue where try_cast(coalesce(n_rows, '0') as double) is not null
    and trunc(cast(coalesce(n_rows, '0') as double)) >= 200 and cast(n_features as bigint) between 1 and 2000)"""


@register("flt3_sized_datasets", v.ctes(CATALOGUE, SIZED) + "select did, upper(format) = 'ARFF' as arff from sized")
def sized_datasets(spark, sf):
    sized = sa.sized_datasets(catalogue(spark, sf))
    return sized.select("did", (F.upper("format") == "ARFF").alias("arff"))


@register("flt3_odd_numbers", """
select doc_id as did from documents where doc_id % 7 in (2, 3, 5)""")
def odd_numbers(spark, sf):
    """Row counts that are no numbers, infinite, very large, whole, just too small, with a fraction, or missing."""
    counts = F.array(*[F.lit(x) for x in ("NaN", "Infinity", "1e30", "200", "199.9", "200.9", None)])
    datasets = v.table(spark, sf, "documents").select(
        F.col("doc_id").alias("did"), F.get(counts, (F.col("doc_id") % 7).cast("int")).alias("NumberOfInstances"), F.lit("2000.9").alias("NumberOfFeatures"))
    return sa.sized_datasets(datasets).select("did")


@register("flt4_format", v.ctes(CATALOGUE) + "select did from catalogue where upper(format) = 'ARFF'")
def of_format(spark, sf):
    return sa.of_format(catalogue(spark, sf)).select("did")


@register("src11_sorted_catalogue", v.ctes(CATALOGUE) + "select cast(did as integer) as did, format from catalogue order by 1")
def sorted_catalogue(spark, sf):
    return sa.sorted_catalogue(catalogue(spark, sf)).select("did", "format")


DRAW = "left(md5('{seed}-' || {key}), 15)"


@register("srt5_random_dataset", v.ctes(CATALOGUE, SIZED) + f"""
select n, did from (
  select 0 as n, did, row_number() over (order by {DRAW.format(seed='7-0', key='did')}, did) as rn from sized
  union all select 1, did, row_number() over (order by {DRAW.format(seed='7-1', key='did')}, did) from sized) p where rn = 1""")
def random_dataset(spark, sf):
    picks = [sa.random_dataset(catalogue(spark, sf), 7, n).select(F.lit(n).alias("n"), "did") for n in (0, 1)]
    return picks[0].union(picks[1])


@register("srt4_seeded_shuffle", f"""
select doc_id, row_number() over (order by {DRAW.format(seed='42', key='doc_id')}, doc_id) - 1 as place,
       row_number() over (order by doc_id) - 1 as unshuffled from documents""")
def seeded_shuffle(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id")
    return sa.shuffled(sa.shuffled(docs, "doc_id", 42), "doc_id", None, "unshuffled").select("doc_id", "place", "unshuffled")


@register("srt6_random_style", """
select doc_id, ['default', 'classic', 'ggplot', 'grayscale'][(('0x' || left(md5('3-' || doc_id), 15))::bigint % 4) + 1] as style
from documents""")
def random_style(spark, sf):
    styles = ["default", "classic", "ggplot", "grayscale"]
    return v.table(spark, sf, "documents").select("doc_id", sa.pick_value(3, F.col("doc_id"), styles).alias("style"))


U = "('0x' || left(md5('5-{i}-' || event_id), 15))::bigint / 1152921504606846976.0::double"


@register("srt7_creativity", f"""
select event_id, round(list_sort([{', '.join(U.format(i=i) for i in range(5))}])[2], 9) as creativity from events""")
def creativity(spark, sf):
    return v.table(spark, sf, "events").select("event_id", F.round(sa.creativity(5, F.col("event_id")), 9).alias("creativity"))


@register("srt9_chart_uuid", """
with h as (select doc_id, md5('9-' || doc_id || '-' || source) as m from documents)
select doc_id, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-4' || substr(m, 14, 3) || '-a' || substr(m, 18, 3) || '-' || substr(m, 21, 12) as id
from h""")
def chart_uuid(spark, sf):
    docs = v.table(spark, sf, "documents")
    return docs.select("doc_id", sa.chart_uuid(9, F.col("doc_id"), F.col("source")).alias("id"))


@register("flt6_subset", v.ctes(v.RESULTS, v.CHARTS) + """, ids as (
  select source as id from documents group by source having count(*) % 2 = 0)
select chart_id, dataset_id from charts_v where dataset_id in (select id from ids)""")
def subset(spark, sf):
    charts = v.charts_v(spark, sf).select("chart_id", "dataset_id")
    ids = charts.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") % 2 == 0)
    return ga.subset(charts, ids)


@register("flt7_valid_images", v.ctes(v.REC_IMAGES) + """
select doc_id, count(*) as valid from rec_images where pos % 2 = 0 group by 1
union all select doc_id, 0 from documents where doc_id % 5 = 0""")
def valid_images(spark, sf):
    records = v.records_v(spark, sf)
    holed = F.transform("images", lambda x, i: x.withField("path", F.when(i % 2 == 0, x["path"])))
    return records.select(F.col("id").cast("long").alias("doc_id"), F.size(im.valid_images(holed)).cast("long").alias("valid"))


@register("agg5_family_counts", COLLECTION + "select family, count(*) as charts from collection group by 1")
def family_counts(spark, sf):
    return ga.family_counts(collection_v(spark, sf))


@register("agg6_dataset_counts", f"""
with n as (select source as dataset_id, count(*) as charts, arg_min(text, doc_id) as text from documents group by 1),
cut as (select dataset_id, charts, replace({SENTENCE}, chr(10), ' ') as c from n)
select dataset_id, charts,
       case when c = '' then '(no description)' when length(c) > 70 then left(c, 67) || '…' else c end as label from cut""")
def dataset_counts(spark, sf):
    return ga.dataset_counts(v.charts_v(spark, sf))


@register("agg8_quality_counts", COLLECTION + """
select count(*) filter (where quality = 'good') as good, count(*) filter (where quality = 'bad') as bad from collection""")
def quality_counts(spark, sf):
    return ga.quality_counts(collection_v(spark, sf))


FACETS = COLLECTION + f""", found as (select * from collection where contains({BLOB}, 'plot')),
bad as (select * from found where quality = 'bad')
select 'quality' as facet, value, cast(charts as bigint) as charts from (
  select 'good' as value, count(*) filter (where quality = 'good') as charts from found where family = 'Density Plot'
  union all select 'bad', count(*) filter (where quality = 'bad') from found where family = 'Density Plot'
  union all select 'all', count(*) from found where family = 'Density Plot') q
union all select 'family', family, count(*) from bad group by 2
union all select 'dataset', dataset_id, count(*) from bad
          where family = 'Density Plot' or not exists (select 1 from bad where family = 'Density Plot') group by 2"""


@register("agg7_facets", FACETS)
def facets(spark, sf):
    return ga.facets(collection_v(spark, sf), family="Density Plot", quality="bad", search="plot")


FACETS_RESET = COLLECTION + """
select 'quality' as facet, 'good' as value, cast(0 as bigint) as charts union all select 'quality', 'bad', 0
union all select 'quality', 'all', 0
union all select 'family', family, count(*) from collection where quality = 'good' group by 2
union all select 'dataset', dataset_id, count(*) from collection where quality = 'good' group by 2"""


@register("agg7_facets_reset", FACETS_RESET)
def facets_reset(spark, sf):
    return ga.facets(collection_v(spark, sf), family="No such family")


SELECTIONS = [("Heatmap", "src3"), ("Heatmap", "absent"), ("No such family", "src3"), ("No such family", "absent"), ("(all)", "src3"), ("Heatmap", "(all)")]


SELECTED = COLLECTION + """, chosen(n, f, d) as (values (0, 'Heatmap', 'src3'), (1, 'Heatmap', 'absent'), (2, 'No such family', 'src3'),
  (3, 'No such family', 'absent'), (4, '(all)', 'src3'), (5, 'Heatmap', '(all)')),
first as (select n, f, d, case when exists (select 1 from collection where quality = 'good' and (d = '(all)' or dataset_id = d) and (f = '(all)' or family = f))
  then f else '(all)' end as family from chosen)
select cast(n as integer) as n, family,
       case when exists (select 1 from collection where quality = 'good' and (d = '(all)' or dataset_id = d) and (first.family = '(all)' or collection.family = first.family))
       then d else '(all)' end as dataset from first"""


@register("agg7_selection", SELECTED)
def selection(spark, sf):
    charts, out = collection_v(spark, sf), None
    for n, (family, dataset) in enumerate(SELECTIONS):
        row = ga.effective_selection(charts, family, dataset).select(F.lit(n).alias("n"), "family", "dataset")
        out = row if out is None else out.unionByName(row)
    return out


@register("joi4_facet_labels", v.ctes(v.CHARTS) + """
select 'dataset' as facet, dataset_id as value, count(*) as charts,
       case when dataset_id < 'f' then dataset_id else 'about ' || dataset_id end as label
from charts_v group by 2""")
def facet_labels(spark, sf):
    charts = v.charts_v(spark, sf)
    facet = charts.groupBy(F.lit("dataset").alias("facet"), F.col("dataset_id").alias("value")).agg(F.count(F.lit(1)).alias("charts"))
    labels = charts.where(F.col("dataset_id") >= "f").groupBy("dataset_id").agg(F.max(F.concat(F.lit("about "), "dataset_id")).alias("label"))
    return ga.with_labels(facet, labels)


PLACED = COLLECTION + """, counted as (
  select c.chart_id, coalesce(k.incorrect, 0) as incorrect from collection c left join counts k on c.chart_id = k.chart_id),
placed as (select chart_id, incorrect, row_number() over (order by incorrect desc, chart_id) - 1 as place,
                  row_number() over (order by incorrect, chart_id) - 1 as place_asc from counted)
"""


def counted(spark, sf):
    charts = v.charts_v(spark, sf).select("chart_id")
    return ev.charts_with_counts(charts, ev.chart_answer_counts(v.results_v(spark, sf))).select("chart_id", "incorrect")


@register("srt1_sorted_charts", PLACED + "select chart_id, incorrect, place, place_asc from placed")
def sorted_charts(spark, sf):
    down = ga.sorted_places(counted(spark, sf), ascending=False)
    up = ga.sorted_places(counted(spark, sf), ascending=True).select("chart_id", F.col("place").alias("place_asc"))
    return down.join(up, "chart_id")


@register("srt2_pages", PLACED + "select chart_id, place, cast(place // 24 as bigint) as page from placed")
def pages(spark, sf):
    return ga.with_pages(ga.sorted_places(counted(spark, sf), ascending=False)).select("chart_id", "place", "page")


@register("srt2_page", PLACED + """
select chart_id, place, cast(place // 24 as bigint) as page from placed
where place // 24 = 1 or place // 24 = (select max(place // 24) from placed)""")
def page(spark, sf):
    placed = ga.sorted_places(counted(spark, sf), ascending=False)
    second, beyond = ga.page(placed, 1), ga.page(placed, 10**9)
    return second.union(beyond).select("chart_id", "place", "page").distinct()


@register("srt3_head_json", """
select o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}' as record
from orders order by o_orderkey limit 25""")
def head_json(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return ga.head_json(orders, ["o_orderkey"], 25)


def indexed(spark, sf):
    """An index of the collection in the scratch folder."""
    path = scratch_dir(spark, "gallery-index")
    gi.write_index(collection_v(spark, sf), path)
    return path


SEARCHES = [" Plot ", "the on", "q-", "7", "src3", "no such text", ""]


@register("flt2_indexed_search", COLLECTION + " union all ".join(
    f"select {n} as search, chart_id, family from collection where contains({BLOB}, '{term.strip().lower()}')" for n, term in enumerate(SEARCHES)))
def indexed_search(spark, sf):
    """Whole terms, terms of one and two characters, one that no chart holds and none at all."""
    path = indexed(spark, sf)
    parts = [gi.search(spark, path, term).select(F.lit(n).alias("search"), "chart_id", "family") for n, term in enumerate(SEARCHES)]
    return reduce(DataFrame.unionByName, parts)


@register("agg7_indexed_facets", FACETS)
def indexed_facets(spark, sf):
    return gi.facets(spark, indexed(spark, sf), family="Density Plot", quality="bad", term="plot")


@register("agg7_indexed_reset", FACETS_RESET)
def indexed_reset(spark, sf):
    return gi.facets(spark, indexed(spark, sf), family="No such family")


@register("agg7_indexed_selection", SELECTED)
def indexed_selection(spark, sf):
    path = indexed(spark, sf)
    rows = [gi.selection(spark, path, family, dataset).select(F.lit(n).alias("n"), "family", "dataset") for n, (family, dataset) in enumerate(SELECTIONS)]
    return reduce(DataFrame.unionByName, rows)

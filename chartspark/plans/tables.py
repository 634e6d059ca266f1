"""Queries: table profiles, chart specifications, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark.operators.charts import profile as pf
from chartspark.operators.charts.spec import run_spec
from chartspark.plans import views as v
from chartspark.plans.charts import rounded
from chartspark.plans.registry import register
from chartspark.session import scratch_dir

NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("agg15_numeric_profile", " union all ".join(f"""
select '{c}' as "column", count(*) as rows, count(*) - count({c}) as missing, min({c})::double as min, max({c})::double as max,
       round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as sd, round(quantile_cont({c}::double, 0.25), 6) as q1,
       round(quantile_cont({c}::double, 0.5), 6) as median, round(quantile_cont({c}::double, 0.75), 6) as q3 from lineitem""" for c in NUMERIC))
def numeric_profile(spark, sf):
    return rounded(rounded(pf.numeric_profile(v.table(spark, sf, "lineitem")), 4, "mean", "sd"), 6, "q1", "median", "q3")


DOCS = ("text", "lang", "source")


@register("agg15_categorical_profile", " union all ".join(f"""
select '{c}' as "column", count(*) as rows, count(*) - count({c}) as missing, count(distinct {c}) as distinct_values from documents""" for c in DOCS))
def categorical_profile(spark, sf):
    return pf.categorical_profile(v.table(spark, sf, "documents"))


def refreshed_states(spark, rows, key):
    """States of three folders of files, profiled when one still lacks half its rows, and again after it is whole."""
    folder, before, after = scratch_dir(spark, "profiled"), scratch_dir(spark, "states"), scratch_dir(spark, "states")
    part = F.pmod(key, F.lit(3))
    for n in range(2):
        rows.where(part == n).write.parquet(f"{folder}/part{n}")
    rows.where((part == 2) & (F.pmod(key, F.lit(2)) == 0)).write.parquet(f"{folder}/part2")

    def read(paths):
        return spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias("file"))

    pf.refresh_profile(spark, folder, None, before, read)
    rows.where(part == 2).write.mode("overwrite").parquet(f"{folder}/part2")
    pf.refresh_profile(spark, folder, before, after, read)
    return spark.read.parquet(f"{after}/counts")


@register("agg15_refreshed_profile", " union all ".join(f"""
select '{c}' as "column", count(*) as rows, count(*) - count({c}) as missing, min({c})::double as min, max({c})::double as max,
       round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as sd from lineitem""" for c in NUMERIC))
def refreshed_profile(spark, sf):
    items = v.table(spark, sf, "lineitem").select(*NUMERIC)
    return rounded(pf.merged_profile(refreshed_states(spark, items, F.col("l_orderkey"))).drop("q1", "median", "q3"), 4, "mean", "sd")


@register("agg15_refreshed_categories", " union all ".join(f"""
select '{c}' as "column", count(*) as rows, count(*) - count({c}) as missing from documents""" for c in DOCS))
def refreshed_categories(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", *DOCS)
    return pf.merged_categories(refreshed_states(spark, docs, F.col("doc_id"))).drop("about_distinct")


@register("agg15_top_categories", " union all ".join(f"""
select * from (select '{c}' as "column", {c} as value, count(*) as rows, cast(row_number() over (order by count(*) desc, {c}) as integer) as place
               from orders group by {c}) t where place <= 3""" for c in ("o_orderstatus", "o_orderpriority")))
def top_categories(spark, sf):
    return pf.top_categories(v.table(spark, sf, "orders"), 3)


@register("cht40_suggest", """
select * from (values
  ('Histogram', 'c_custkey,c_nationkey,c_acctbal', '', 'c_mktsegment'), ('Density Plot', 'c_custkey,c_nationkey,c_acctbal', '', 'c_mktsegment'),
  ('Distribution Summary', 'c_custkey,c_nationkey,c_acctbal', '', 'c_mktsegment'),
  ('Box / Violin', 'c_mktsegment', 'c_custkey,c_nationkey,c_acctbal', 'c_mktsegment'), ('Error Bar', 'c_mktsegment', 'c_custkey,c_nationkey,c_acctbal', ''),
  ('Bar Chart', 'c_mktsegment', 'c_custkey,c_nationkey,c_acctbal', 'c_mktsegment'), ('Pie / Donut', 'c_mktsegment', '', ''),
  ('Heatmap', 'c_custkey,c_nationkey,c_acctbal', 'c_custkey,c_nationkey,c_acctbal', ''),
  ('Scatter Plot', 'c_custkey,c_nationkey,c_acctbal', 'c_custkey,c_nationkey,c_acctbal', 'c_mktsegment'),
  ('Hexbin', 'c_custkey,c_nationkey,c_acctbal', 'c_custkey,c_nationkey,c_acctbal', ''),
  ('Bubble Chart', 'c_custkey,c_nationkey,c_acctbal', 'c_custkey,c_nationkey,c_acctbal', 'c_mktsegment'),
  ('Scatter Matrix', 'c_custkey,c_nationkey,c_acctbal', 'c_custkey,c_nationkey,c_acctbal', 'c_mktsegment'),
  ('Parallel Coordinates', 'c_custkey,c_nationkey,c_acctbal', '', 'c_mktsegment'), ('Projection Plot', 'c_custkey,c_nationkey,c_acctbal', '', 'c_mktsegment'),
  ('Radar Chart', 'c_custkey,c_nationkey,c_acctbal', '', 'c_mktsegment'),
  ('Faceted Plot', 'c_custkey,c_nationkey,c_acctbal', 'c_custkey,c_nationkey,c_acctbal', 'c_mktsegment')) t(family, x, y, hue)
where (select count(distinct c_mktsegment) from customer) between 2 and 10""")
def suggest(spark, sf):
    return pf.suggest(v.table(spark, sf, "customer"))


SPEC = {
    "plot_type": "Grouped Bar Chart", "title": "Discounted price", "filters": ["l_quantity > 10", "l_linestatus = 'F'"],
    "transformations": {"net": "l_extendedprice * (1 - l_discount)"}, "binning": {"l_quantity": 8}, "x": "l_quantity",
    "hue": "l_returnflag", "y": "net", "aggregation": "mean",
}

SPEC_SQL = """
with r as (select *, l_extendedprice * (1 - l_discount) as net from lineitem where l_quantity > 10 and l_linestatus = 'F'),
e as (select min(l_quantity) as lo, max(l_quantity) as hi from r),
g as (select lo + least(floor((l_quantity - lo) / ((hi - lo) / 8)), 7) * (hi - lo) / 8 as l_quantity, l_returnflag, avg(net) as net
      from r, e group by 1, 2)
"""


@register("cht1_run_spec", SPEC_SQL + "select round(l_quantity, 6) as l_quantity, l_returnflag, round(net, 4) as net from g")
def spec_table(spark, sf):
    return rounded(rounded(run_spec(v.table(spark, sf, "lineitem"), SPEC).graph_df, 6, "l_quantity"), 4, "net")


@register("cht1_graph_data", SPEC_SQL + """
select 'Grouped Bar Chart' as plot_type, 'l_quantity' as x, 'net' as y, 'l_returnflag' as hue, '' as facet, 'mean' as aggregation,
       'l_quantity: 8' as binning, 'Discounted price' as title, (select count(*) from lineitem) as n_rows_input, (select count(*) from g) as n_rows_plotted""")
def spec_data(spark, sf):
    data = run_spec(v.table(spark, sf, "lineitem"), SPEC).graph_data
    listed = ("x", "y", "hue", "facet", "aggregation", "binning")
    return data.select("plot_type", *[F.array_join(c, ",").alias(c) for c in listed], "title", "n_rows_input", "n_rows_plotted")


WIDE = {"plot_type": "Scatter Plot", "filters": ["p_size < 40"], "binning": {"p_retailprice": {"width": 25}}, "x": "p_size", "y": "p_retailprice", "hue": "p_type"}


@register("cht1_run_spec_rows", "select p_size, p_type, floor(p_retailprice / 25) * 25 as p_retailprice from part where p_size < 40")
def spec_rows(spark, sf):
    return run_spec(v.table(spark, sf, "part"), WIDE).graph_df

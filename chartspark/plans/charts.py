"""Queries: the table behind each kind of chart."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark.operators.charts import bars, distributions as di, grids, relations as re, timeline as ti
from chartspark.plans import views as v
from chartspark.plans.registry import register

LI = "lineitem"


def lineitem(spark, sf):
    return v.table(spark, sf, "lineitem")


def orders(spark, sf):
    return v.table(spark, sf, "orders")


def rounded(df, places=6, *columns):
    return df.withColumns({c: F.round(c, places) for c in columns})


@register("cht2_bar", """
select l_returnflag, 'count' as agg, cast(count(*) as double) as value from lineitem group by 1
union all select l_returnflag, 'sum', round(sum(l_extendedprice), 2) from lineitem group by 1
union all select l_returnflag, 'mean', round(avg(l_quantity), 6) from lineitem group by 1
union all select l_returnflag, 'median', round(quantile_cont(l_extendedprice, 0.5), 6) from lineitem group by 1
union all select l_returnflag, 'std', round(stddev_samp(l_discount), 6) from lineitem group by 1""")
def bar(spark, sf):
    li = lineitem(spark, sf)
    parts = [("count", None, 0), ("sum", "l_extendedprice", 2), ("mean", "l_quantity", 6), ("median", "l_extendedprice", 6), ("std", "l_discount", 6)]
    out = None
    for agg, y, places in parts:
        one = bars.bar(li, "l_returnflag", y, agg).select(
            "l_returnflag", F.lit(agg).alias("agg"), F.round(F.col("value").cast("double"), places).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@register("cht3_stacked_bar", """
with c as (select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as value from lineitem group by 1, 2)
select *, round(value / sum(value) over (partition by l_returnflag), 6) as share from c""")
def stacked_bar(spark, sf):
    return rounded(rounded(bars.stacked_bar(lineitem(spark, sf), "l_returnflag", "l_linestatus", "l_quantity", "sum"), 2, "value"), 6, "share")


@register("cht4_line", """
select date_trunc('month', o_orderdate)::timestamp as bucket, o_orderpriority, round(avg(o_totalprice), 4) as value from orders group by 1, 2""")
def line(spark, sf):
    return rounded(ti.line(orders(spark, sf), "o_orderdate", "o_totalprice", "mean", "month", "o_orderpriority"), 4, "value")


@register("cht4_line_filled", """
with p as (select date_trunc('day', o_orderdate)::timestamp as bucket, o_orderpriority, count(*) as value from orders group by 1, 2),
spine as (select o_orderpriority, unnest(generate_series((select min(bucket) from p), (select max(bucket) from p), interval 1 day)) as bucket
          from (select distinct o_orderpriority from p) h)
select s.bucket, s.o_orderpriority, p.value from spine s left join p on s.bucket = p.bucket and s.o_orderpriority = p.o_orderpriority""")
def line_filled(spark, sf):
    return ti.line(orders(spark, sf), "o_orderdate", None, "count", "day", "o_orderpriority", fill=True)


@register("cht5_streamgraph", """
with p as (select date_trunc('quarter', o_orderdate)::timestamp as bucket, o_orderpriority, sum(o_totalprice) as value from orders group by 1, 2),
s as (select *, sum(value) over (partition by bucket order by o_orderpriority) as y1 from p)
select bucket, o_orderpriority, round(value, 2) as value, round(y1 - value, 2) as y0, round(y1, 2) as y1 from s""")
def streamgraph(spark, sf):
    return rounded(ti.streamgraph(orders(spark, sf), "o_orderdate", "o_orderpriority", "o_totalprice", "quarter"), 2, "value", "y0", "y1")


HIST = """
with r as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
c as (select l_returnflag, least(floor((l_extendedprice - lo) / ((hi - lo) / 30)), 29)::bigint as bin, count(*) as n
      from lineitem, r group by 1, 2),
s as (select l_returnflag, unnest(range(0, 30)) as bin from (select distinct l_returnflag from lineitem) g)
select s.l_returnflag, s.bin, round(lo + s.bin * ((hi - lo) / 30), 6) as low, round(lo + (s.bin + 1) * ((hi - lo) / 30), 6) as high,
       coalesce(c.n, 0) as count
from s cross join r left join c on s.bin = c.bin and s.l_returnflag = c.l_returnflag"""


@register("cht6_histogram", HIST)
def histogram(spark, sf):
    return rounded(di.histogram(lineitem(spark, sf), "l_extendedprice", 30, "l_returnflag"), 6, "low", "high")


@register("cht6_histogram_plain", """
with r as (select min(value) as lo, max(value) as hi from events),
c as (select least(floor((value - lo) / ((hi - lo) / 50)), 49)::bigint as bin, count(*) as n from events, r group by 1),
s as (select unnest(range(0, 50)) as bin)
select s.bin, round(lo + s.bin * ((hi - lo) / 50), 6) as low, round(lo + (s.bin + 1) * ((hi - lo) / 50), 6) as high, coalesce(n, 0) as count
from s cross join r left join c on s.bin = c.bin""")
def histogram_plain(spark, sf):
    return rounded(di.histogram(v.table(spark, sf, "events"), "value", 50), 6, "low", "high")


@register("cht7_hist2d", """
with r as (select min(l_quantity) as x0, max(l_quantity) as x1, min(l_extendedprice) as y0, max(l_extendedprice) as y1 from lineitem)
select least(floor((l_quantity - x0) / ((x1 - x0) / 10)), 9)::bigint as bin_x,
       least(floor((l_extendedprice - y0) / ((y1 - y0) / 20)), 19)::bigint as bin_y, count(*) as count, round(avg(l_discount), 6) as mean_z
from lineitem, r group by 1, 2""")
def hist2d(spark, sf):
    return rounded(grids.hist2d(lineitem(spark, sf), "l_quantity", "l_extendedprice", 10, 20, "l_discount"), 6, "mean_z")


@register("cht8_hexbin", """
with r as (select min(l_quantity) as x0, max(l_quantity) as x1, min(l_extendedprice) as y0, max(l_extendedprice) as y1 from lineitem),
p as (select (l_quantity - x0) / ((x1 - x0) / 20) as ix, (l_extendedprice - y0) / ((y1 - y0) / 11) as iy from lineitem, r),
d as (select *, pow(ix - floor(ix + 0.5), 2) + 3 * pow(iy - floor(iy + 0.5), 2) < pow(ix - floor(ix) - 0.5, 2) + 3 * pow(iy - floor(iy) - 0.5, 2) as near from p),
h as (select case when near then floor(ix + 0.5) else floor(ix) + 0.5 end as hex_x,
             case when near then floor(iy + 0.5) else floor(iy) + 0.5 end as hex_y, count(*) as count from d group by 1, 2)
select hex_x, hex_y, count, round(x0 + hex_x * ((x1 - x0) / 20), 6) as x, round(y0 + hex_y * ((y1 - y0) / 11), 6) as y from h, r""")
def hexbin(spark, sf):
    return rounded(grids.hexbin(lineitem(spark, sf), "l_quantity", "l_extendedprice", 20), 6, "x", "y")


@register("cht9_heatmap", """
with c as (select p_brand, p_type, count(*) as n from part group by 1, 2)
select b.p_brand, t.p_type, coalesce(n, 0) as value
from (select distinct p_brand from part) b cross join (select distinct p_type from part) t
left join c on b.p_brand = c.p_brand and t.p_type = c.p_type""")
def heatmap(spark, sf):
    return grids.heatmap(v.table(spark, sf, "part"), "p_brand", "p_type")


CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("cht10_correlation", " union all ".join(
    f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for a in CORR for b in CORR))
def correlation(spark, sf):
    return rounded(grids.correlation(lineitem(spark, sf), CORR), 6, "r")


@register("cht11_confusion", """
with c as (select quality, toxic, count(*) as count from labels group by 1, 2)
select *, round(count / sum(count) over (partition by quality), 6) as row_share from c""")
def confusion(spark, sf):
    return rounded(grids.confusion(v.table(spark, sf, "labels"), "quality", "toxic"), 6, "row_share")


BOX = """
q as (select l_returnflag as g, count(*) as n, quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.5) as median,
             quantile_cont(l_extendedprice, 0.75) as q3 from lineitem group by 1),
box as (select g, any_value(n) as n, any_value(q1) as q1, any_value(median) as median, any_value(q3) as q3,
               min(l_extendedprice) filter (where l_extendedprice between q1 - {w} * (q3 - q1) and q3 + {w} * (q3 - q1)) as whisker_low,
               max(l_extendedprice) filter (where l_extendedprice between q1 - {w} * (q3 - q1) and q3 + {w} * (q3 - q1)) as whisker_high,
               count(*) filter (where not l_extendedprice between q1 - {w} * (q3 - q1) and q3 + {w} * (q3 - q1)) as outliers
        from lineitem l join q on l.l_returnflag = q.g group by 1)"""


@register("cht12_box_stats", "with " + BOX.format(w="0.5::double") + """
select g as l_returnflag, n, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, whisker_low, whisker_high, outliers from box""")
def box_stats(spark, sf):
    return rounded(di.box_stats(lineitem(spark, sf), "l_extendedprice", "l_returnflag", whis=0.5), 6, "q1", "median", "q3")


KDE = """
s as (select l_returnflag as g, count(*) as n, stddev_samp({x}) * pow(count(*), -0.2) as h, min({x}) as lo, max({x}) as hi from lineitem group by 1),
c as (select l_returnflag as g, {x} as x, count(*) as w from lineitem group by 1, 2),
p as (select s.*, unnest(range(0, {grid})) as point from s),
kde as (select p.g, p.point, any_value(p.lo + p.point * (p.hi - p.lo) / {last}) as x,
             sum(c.w * exp(-pow((p.lo + p.point * (p.hi - p.lo) / {last} - c.x) / p.h, 2) / 2)) / (any_value(p.n) * any_value(p.h) * sqrt(2 * pi())) as density
      from p join c on p.g = c.g group by 1, 2)"""


@register("cht13_density", "with " + KDE.format(x="l_extendedprice", grid=32, last=31) + """
select g as l_returnflag, cast(point as integer) as point, round(x, 6) as x, round(density * 1e6, 6) as density_e6 from kde""")
def density(spark, sf):
    out = di.density(lineitem(spark, sf), "l_extendedprice", 32, "l_returnflag")
    return out.select("l_returnflag", "point", F.round("x", 6).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density_e6"))


@register("cht14_ecdf", """
with c as (select l_returnflag, l_extendedprice as x, count(*) as n from lineitem group by 1, 2)
select l_returnflag, x, round(sum(n) over (partition by l_returnflag order by x) / sum(n) over (partition by l_returnflag), 9) as share from c""")
def ecdf(spark, sf):
    return rounded(di.ecdf(lineitem(spark, sf), "l_extendedprice", "l_returnflag"), 9, "share")


@register("cht15_qq", """
with p as (select (i + 0.5::double) / 20 as p from range(0, 20) r(i)),
q as (select l_returnflag as g, quantile_cont(l_extendedprice, [""" + ", ".join(f"{(i + 0.5) / 20}" for i in range(20)) + """]) as qs
      from lineitem where l_returnflag in ('A', 'R') group by 1),
u as (select g, unnest(qs) as q, generate_subscripts(qs, 1) as i from q)
select round((i - 0.5::double) / 20, 6) as p, round(max(q) filter (where g = 'A'), 6) as q_a, round(max(q) filter (where g = 'R'), 6) as q_b
from u group by 1""")
def qq(spark, sf):
    return rounded(di.qq(lineitem(spark, sf), "l_extendedprice", "l_returnflag", "A", "R", 20), 6, "p", "q_a", "q_b")


@register("cht16_error_bar", """
with s as (select o_orderpriority, count(o_totalprice) as n, avg(o_totalprice) as mean, stddev_samp(o_totalprice) as sd from orders group by 1)
select o_orderpriority, n, round(mean, 4) as mean, round(sd, 4) as sd, round(sd / sqrt(n), 4) as sem,
       round(mean - 1.96::double * sd / sqrt(n), 4) as low, round(mean + 1.96::double * sd / sqrt(n), 4) as high from s""")
def error_bar(spark, sf):
    return rounded(di.error_bar(orders(spark, sf), "o_totalprice", "o_orderpriority"), 4, "mean", "sd", "sem", "low", "high")


SAMPLE = """
d as (select *, left(md5('42-' || {key}), 15) as dr from {table}),
r as (select *, row_number() over (partition by {by} order by dr) as rn from d),
rain as (select *, ('0x' || left(md5('42-jitter-' || {key}), 15))::bigint / 1152921504606846976.0::double - 0.5::double as jitter from r where rn <= {n})"""


@register("cht17_sample_points", "with " + SAMPLE.format(key="p_partkey", table="part", by="p_brand", n=20) + """
select p_partkey, p_size, p_retailprice, p_brand, round(jitter, 9) as jitter from rain""")
def sample_points(spark, sf):
    return rounded(di.sample_points(v.table(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"], 20, "p_brand"), 9, "jitter")


@register("cht18_bubble", """
select p_brand, round(avg(p_size), 6) as x, round(avg(p_retailprice), 6) as y, round(sum(p_retailprice), 2) as size from part group by 1""")
def bubble(spark, sf):
    part = v.table(spark, sf, "part")
    return rounded(rounded(re.bubble(part, "p_brand", "p_size", "p_retailprice", "p_retailprice"), 6, "x", "y"), 2, "size")


@register("cht19_regression", """
select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) as r2, cast(regr_count(l_extendedprice, l_quantity) as bigint) as n from lineitem group by 1""")
def regression(spark, sf):
    out = re.regression(lineitem(spark, sf), "l_quantity", "l_extendedprice", "l_returnflag")
    return rounded(rounded(rounded(out, 4, "slope"), 3, "intercept"), 6, "r2")


@register("cht19_residuals", """
with f as (select l_returnflag as g, regr_slope(l_extendedprice, l_quantity) as s, regr_intercept(l_extendedprice, l_quantity) as i from lineitem group by 1)
select l_orderkey, l_linenumber, l_partkey, round(i + s * l_quantity, 3) as fitted, round(l_extendedprice - (i + s * l_quantity), 3) as residual
from lineitem join f on l_returnflag = g""")
def residuals(spark, sf):
    slim = lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    out = re.residuals(slim, "l_quantity", "l_extendedprice", "l_returnflag")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("fitted", 3).alias("fitted"), F.round("residual", 3).alias("residual"))


@register("cht20_scatter_matrix", " union all ".join(
    f"select '{a}' as x_name, '{b}' as y_name, cast({a} as double) as x, cast({b} as double) as y from part"
    for a, b in (("p_partkey", "p_size"), ("p_partkey", "p_retailprice"), ("p_size", "p_retailprice"))))
def scatter_matrix(spark, sf):
    return grids.scatter_matrix(v.table(spark, sf, "part"), ["p_partkey", "p_size", "p_retailprice"])


@register("cht21_parallel_coordinates", """
with r as (select min(p_size) as s0, max(p_size) as s1, min(p_retailprice) as p0, max(p_retailprice) as p1 from part)
select p_partkey, round((p_size - s0) / (s1 - s0)::double, 9) as p_size, round((p_retailprice - p0) / (p1 - p0), 9) as p_retailprice, 0.0::double as flat
from part, r""")
def parallel_coordinates(spark, sf):
    part = v.table(spark, sf, "part").withColumn("flat", F.lit(7))
    return rounded(re.parallel_coordinates(part, ["p_size", "p_retailprice", "flat"], "p_partkey"), 9, "p_size", "p_retailprice")


@register("cht22_radar", """
with m as (select c_mktsegment, avg(c_acctbal) as c_acctbal, avg(c_nationkey) as c_nationkey from customer group by 1)
select c_mktsegment, 'c_acctbal' as axis, round(c_acctbal, 6) as value, round(c_acctbal / (select max(c_acctbal) from m), 6) as scaled from m
union all select c_mktsegment, 'c_nationkey', round(c_nationkey, 6), round(c_nationkey / (select max(c_nationkey) from m), 6) from m""")
def radar(spark, sf):
    return rounded(re.radar(v.table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], "c_mktsegment"), 6, "value", "scaled")


@register("cht23_pie", """
with c as (select p_brand, count(*) as n, row_number() over (order by count(*) desc, p_brand) as rn from part group by 1),
s as (select case when rn <= 7 then p_brand else 'Other' end as slice, cast(sum(n) as bigint) as value from c group by 1)
select slice, value, round(value / sum(value) over (), 6) as share from s""")
def pie(spark, sf):
    return rounded(bars.pie(v.table(spark, sf, "part"), "p_brand", top=7), 6, "share")


def people(spark, sf):
    nation, region = v.table(spark, sf, "nation"), v.table(spark, sf, "region")
    customer = v.table(spark, sf, "customer")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)


PEOPLE = "customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


@register("cht24_hierarchy", f"""
select r_name, n_name, c_mktsegment, cast(case grouping_id(r_name, n_name, c_mktsegment) when 0 then 3 when 1 then 2 when 3 then 1 else 0 end as integer) as depth,
       round(sum(c_acctbal), 2) as value
from {PEOPLE} group by rollup (r_name, n_name, c_mktsegment)""")
def hierarchy(spark, sf):
    return rounded(bars.hierarchy(people(spark, sf), ["r_name", "n_name", "c_mktsegment"], "c_acctbal"), 2, "value")


@register("cht25_mosaic", f"""
with c as (select r_name, c_mktsegment, count(*) as value from {PEOPLE} group by 1, 2),
w as (select r_name, sum(value) / (select sum(value) from c) as width from c group by 1),
o as (select *, coalesce(sum(width) over (order by r_name rows between unbounded preceding and 1 preceding), 0) as x0 from w),
h as (select *, value / sum(value) over (partition by r_name) as height from c),
s as (select *, coalesce(sum(height) over (partition by r_name order by c_mktsegment rows between unbounded preceding and 1 preceding), 0) as y0 from h)
select r_name, c_mktsegment, value, round(x0, 6) as x0, round(width, 6) as width, round(y0, 6) as y0, round(height, 6) as height from s join o using (r_name)""")
def mosaic(spark, sf):
    return rounded(bars.mosaic(people(spark, sf), "r_name", "c_mktsegment"), 6, "x0", "width", "y0", "height")


@register("cht26_upset", """
with s as (select user_id, string_agg(event_type, ',' order by event_type) as members, count(*) as degree
           from (select distinct user_id, event_type from events) e group by 1)
select members, cast(degree as integer) as degree, count(*) as entities from s group by 1, 2""")
def upset(spark, sf):
    return bars.upset(v.table(spark, sf, "events"), "user_id", "event_type").withColumn("members", F.array_join("members", ","))


EDGES = f"select n_name, c_mktsegment, count(*) as weight from {PEOPLE} group by 1, 2"


@register("cht27_flow", EDGES)
def flow(spark, sf):
    return bars.flow(people(spark, sf), "n_name", "c_mktsegment")


@register("cht27_degrees", f"""
with e as ({EDGES}), b as (
  select n_name as node, 1 as o, 0 as i, weight as ow, 0 as iw from e union all select c_mktsegment, 0, 1, 0, weight from e)
select node, cast(sum(o) as bigint) as out_degree, cast(sum(i) as bigint) as in_degree, cast(sum(ow) as bigint) as out_weight, cast(sum(iw) as bigint) as in_weight
from b group by 1""")
def degrees(spark, sf):
    return bars.degrees(bars.flow(people(spark, sf), "n_name", "c_mktsegment"), "n_name", "c_mktsegment")


@register("cht28_bump", """
with c as (select year(o_orderdate) as period, o_custkey, count(*) as value from orders group by 1, 2)
select cast(period as integer) as period, o_custkey, value, rank() over (partition by period order by value desc) as place from c""")
def bump(spark, sf):
    return ti.bump(orders(spark, sf).select(F.year("o_orderdate").alias("period"), "o_custkey"), "period", "o_custkey")


@register("cht29_waterfall", """
with d as (select o_orderdate, sum(o_totalprice) as delta from orders group by 1),
l as (select *, sum(delta) over (order by o_orderdate) as "end" from d)
select o_orderdate, round(delta, 2) as delta, round("end" - delta, 2) as start, round("end", 2) as "end" from l""")
def waterfall(spark, sf):
    return rounded(rounded(ti.waterfall(orders(spark, sf), "o_orderdate", "o_totalprice"), 2, "delta"), 2, "start", "end")


@register("cht30_funnel", """
with a as (select user_id, min(ts) as t from events where event_type = 'click' group by 1),
b as (select e.user_id, min(ts) as t from events e join a on e.user_id = a.user_id and ts > a.t where event_type = 'view' group by 1),
c as (select e.user_id, min(ts) as t from events e join b on e.user_id = b.user_id and ts > b.t where event_type = 'purchase' group by 1),
n as (select 0 as step, 'click' as stage, count(*) as users from a union all select 1, 'view', count(*) from b union all select 2, 'purchase', count(*) from c)
select step, stage, users, round(users / nullif(lag(users) over (order by step), 0), 6) as step_rate,
       round(users / nullif(first_value(users) over (order by step), 0), 6) as total_rate from n""")
def funnel(spark, sf):
    events = v.table(spark, sf, "events")
    return rounded(bars.funnel(events, "user_id", "event_type", "ts", ["click", "view", "purchase"]), 6, "step_rate", "total_rate")


@register("cht31_gantt", """
select user_id, min(ts) as "start", max(ts) as "end", round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::double, 6) as seconds from events group by 1""")
def gantt(spark, sf):
    return rounded(bars.gantt(v.table(spark, sf, "events"), "user_id", "ts"), 6, "seconds")


@register("cht32_projection")
def projection(spark, sf):
    scores, _ = re.projection(v.table(spark, sf, "embeddings"), "vec_id", "embedding", 2)
    return scores


LENGTHS = """
with e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as d from embeddings),
m as (select d, avg(x) as mean from e group by 1)
select vec_id, round(sum(pow(x - mean, 2)), 6) as squared_length from e join m using (d) group by 1"""


def projected_lengths(spark, sf, block=None):
    scores, _ = re.projection(v.table(spark, sf, "embeddings"), "vec_id", "embedding", 64, block)
    squares = F.aggregate(F.array(*[F.col(f"pc{j}") * F.col(f"pc{j}") for j in range(1, 65)]), F.lit(0.0), lambda a, x: a + x)
    return scores.select("vec_id", F.round(squares, 6).alias("squared_length"))


@register("cht32_projection_length", LENGTHS)
def projection_length(spark, sf):
    """All components together keep the length of every centred vector."""
    return projected_lengths(spark, sf)


@register("cht32_projection_rounds", LENGTHS)
def projection_rounds(spark, sf):
    """The same lengths, with axes found eight at a time and without the scatter matrix."""
    return projected_lengths(spark, sf, 8)


@register("cht33_facet", """
with c as (select p_brand, count(*) as n, row_number() over (order by count(*) desc, p_brand) as rn, count(*) over () as g from part group by 1),
p as (select p_brand, case when g <= 9 or rn <= 8 then p_brand else 'Other' end as panel from c)
select panel, count(*) as points, min(p_size) as low, max(p_size) as high, (select min(p_size) from part)::double as x_low, (select max(p_size) from part)::double as x_high,
       (select min(p_retailprice) from part) as y_low, (select max(p_retailprice) from part) as y_high
from part join p using (p_brand) group by 1""")
def facet(spark, sf):
    panels = re.facet(v.table(spark, sf, "part"), "p_brand", "p_size", "p_retailprice", max_panels=9)
    return panels.groupBy("panel").agg(
        F.count(F.lit(1)).alias("points"), F.min("p_size").alias("low"), F.max("p_size").alias("high"),
        *[F.max(c).alias(c) for c in ("x_low", "x_high", "y_low", "y_high")])


@register("cht34_waffle", """
with c as (select p_brand, count(*) as value from part group by 1), t as (select sum(value) as n from c),
b as (select p_brand, value, value * 100 // n as base, value * 100 % n as rest from c, t),
r as (select *, row_number() over (order by rest desc, p_brand) as rn from b)
select p_brand, value, cast(base + case when rn <= 100 - (select sum(base) from b) then 1 else 0 end as bigint) as cells from r""")
def waffle(spark, sf):
    return bars.waffle(v.table(spark, sf, "part"), "p_brand")


@register("cht35_sequence_logo", """
with l as (select unnest(range(0, length(p_name))) as pos, p_name from part),
c as (select pos, substr(p_name, pos + 1, 1) as symbol, count(*) as n from l group by 1, 2),
f as (select *, n / sum(n) over (partition by pos) as frequency from c),
e as (select pos, sum(-frequency * log2(frequency)) as h from f group by 1),
a as (select log2(count(distinct symbol)) as bits from c)
select cast(f.pos as integer) as pos, symbol, n as count, round(frequency, 6) as frequency, round(bits - h, 6) as information, round(frequency * (bits - h), 6) as height
from f join e on f.pos = e.pos cross join a""")
def sequence_logo(spark, sf):
    return rounded(grids.sequence_logo(v.table(spark, sf, "part"), "p_name"), 6, "frequency", "information", "height")


@register("cht36_quiver", """
with p as (select event_id::double as x, user_id::double as y, value as dx, k::double as dy
           from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events) e),
r as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p)
select least(floor((x - x0) / ((x1 - x0) / 12)), 11)::bigint as bin_x, least(floor((y - y0) / ((y1 - y0) / 12)), 11)::bigint as bin_y,
       round(avg(dx), 6) as dx, round(avg(dy), 6) as dy, count(*) as count from p, r group by 1, 2""")
def quiver(spark, sf):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k")
    events = v.table(spark, sf, "events").select("event_id", "user_id", "value", k)
    return rounded(grids.quiver(events, "event_id", "user_id", "value", "k", 12), 6, "dx", "dy")


@register("cht37_raincloud", "with " + SAMPLE.format(key="event_id", table="events", by="event_type", n=50) + """,
q as (select event_type as g, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from events group by 1),
box as (select g, any_value(q1) as q1, any_value(median) as median, any_value(q3) as q3,
               min(value) filter (where value between q1 - 1.5::double * (q3 - q1) and q3 + 1.5::double * (q3 - q1)) as whisker_low,
               max(value) filter (where value between q1 - 1.5::double * (q3 - q1) and q3 + 1.5::double * (q3 - q1)) as whisker_high
        from events join q on event_type = g group by 1),
s as (select event_type as g, count(*) as n, stddev_samp(value) * pow(count(*), -0.2) as h, min(value) as lo, max(value) as hi from events group by 1),
c as (select event_type as g, value as x, count(*) as w from events group by 1, 2),
p as (select s.*, unnest(range(0, 16)) as point from s),
kde as (select p.g, p.point, any_value(p.lo + p.point * (p.hi - p.lo) / 15) as x,
             sum(c.w * exp(-pow((p.lo + p.point * (p.hi - p.lo) / 15 - c.x) / p.h, 2) / 2)) / (any_value(p.n) * any_value(p.h) * sqrt(2 * pi())) as density
      from p join c on p.g = c.g group by 1, 2)
select g as "group", 'density' as part, 'p' || point as item, round(x, 6) as x, round(density, 9) as y from kde
union all select g, 'box', item, round(x, 6), null from (unpivot box on q1, median, q3, whisker_low, whisker_high into name item value x) u
union all select event_type, 'rain', cast(event_id as varchar), round(value, 6), round(jitter, 9) from rain""")
def raincloud(spark, sf):
    out = di.raincloud(v.table(spark, sf, "events"), "event_id", "value", "event_type", n=50, grid=16)
    return rounded(rounded(out, 6, "x"), 9, "y")


@register("cht38_drop_outliers", """
with q as (select quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.75) as q3,
                  avg(l_extendedprice) as m, stddev_samp(l_extendedprice) as sd from lineitem)
select 'iqr' as method, l_orderkey, l_linenumber, l_extendedprice from lineitem, q
where l_extendedprice between q1 - 0.25::double * (q3 - q1) and q3 + 0.25::double * (q3 - q1)
union all select 'zscore', l_orderkey, l_linenumber, l_extendedprice from lineitem, q where abs(l_extendedprice - m) <= 1.5::double * sd""")
def drop_outliers(spark, sf):
    slim = lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_extendedprice")
    iqr = di.drop_outliers(slim, "l_extendedprice", "iqr", 0.25).withColumn("method", F.lit("iqr"))
    return iqr.unionByName(di.drop_outliers(slim, "l_extendedprice", "zscore", 1.5).withColumn("method", F.lit("zscore")))


@register("cht39_transform", """
with m as (select avg(o_totalprice) as m, stddev_samp(o_totalprice) as sd from orders),
p as (select o_orderpriority, rank() over (order by avg(o_totalprice) desc) as place from orders group by 1)
select o_orderkey, round(ln(o_totalprice), 9) as price_log, round((o_totalprice - m) / sd, 6) as price_z, cast(month(o_orderdate) as integer) as month,
       cast(isodow(o_orderdate) - 1 as integer) as weekday, place
from orders join p using (o_orderpriority), m""")
def transform(spark, sf):
    out = orders(spark, sf)
    out = re.transform(out, "o_totalprice", "log", "price_log")
    out = re.transform(out, "o_totalprice", "zscore", "price_z")
    out = re.transform(re.transform(out, "o_orderdate", "month", "month"), "o_orderdate", "weekday", "weekday")
    out = re.transform(out, "o_orderpriority", "order", "place", "o_totalprice")
    return out.select("o_orderkey", F.round("price_log", 9).alias("price_log"), F.round("price_z", 6).alias("price_z"), "month", "weekday", "place")

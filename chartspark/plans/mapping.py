"""Queries: matching renamed columns to their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark.operators import mapping as ma
from chartspark.plans import views as v
from chartspark.plans.registry import register


def matched(spark, sf):
    """One chart per document; the description names two of the raw columns, one override is given."""
    docs = v.table(spark, sf, "documents")
    description = F.concat(
        F.lit("mcg (McGeoch signal score), gvh (von Heijne signal score), "), "source", F.lit(" ("), "lang", F.lit(" origin). "), "text")
    charts = docs.select(
        F.col("doc_id").alias("chart_id"), description.alias("description"),
        F.array(F.lit("mcg"), F.lit("gvh"), F.lit("class"), F.col("source"), F.lit("alm1"), F.lit("z9")).alias("raw"),
        F.array(F.lit("McGeoch_Signal_Score"), F.lit("class"), F.concat("lang", F.lit("Origin")), F.lit("Score_ALM_1"), F.lit("Unrelated_Thing"), F.lit("forced")).alias("needed"),
        F.create_map(F.lit("forced"), F.lit("gvh")).alias("overrides"),
    )
    return ma.match_columns(charts, overrides="overrides")


@register("joi7_column_suggestions")
def column_suggestions(spark, sf):
    out = ma.suggestions_long(matched(spark, sf).select("chart_id", "suggestions"), "chart_id")
    return out.withColumn("score", F.round("score", 9))


@register("win3_top_candidates")
def top_candidates(spark, sf):
    out = ma.suggestions_long(matched(spark, sf).select("chart_id", "suggestions"), "chart_id")
    return out.select("chart_id", "needed", "place", "raw", F.round("score", 9).alias("score"))


@register("joi8_column_matches", """
select doc_id as chart_id, 'class' as renamed, 'class' as raw, 10.0::double as score, 'exact' as evidence from documents
union all select doc_id, 'forced', 'gvh', 10.0::double, 'manual' from documents""")
def column_matches(spark, sf):
    rows = matched(spark, sf).select("chart_id", F.inline("matches"))
    return rows.where(F.col("evidence").isin("exact", "manual"))


@register("joi8_scored_matches")
def scored_matches(spark, sf):
    rows = matched(spark, sf).select("chart_id", F.inline("matches"))
    return rows.withColumn("score", F.round("score", 9))


@register("joi9_unresolved")
def unresolved(spark, sf):
    return ma.unresolved(matched(spark, sf), "chart_id")


@register("joi10_chosen_metadata", """
select doc_id as did, source as name from documents where doc_id = (select max(doc_id) from documents)""")
def chosen_metadata(spark, sf):
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("did"), F.col("source").alias("name"))
    return docs.where(F.col("did") == docs.agg(F.max("did").alias("m")).scalar())


NAMED = """named as (
  select doc_id as chart_id, 'the ' || lang || ' source of a row' as a, 'row ' || doc_id || ' letters' as b from documents)"""


def named(spark, sf):
    """Charts whose needed columns repeat an alias word for word, so that the best score is known."""
    docs = v.table(spark, sf, "documents")
    a = F.concat(F.lit("the "), "lang", F.lit(" source of a row"))
    b = F.concat(F.lit("row "), F.col("doc_id").cast("string"), F.lit(" letters"))
    return docs.select(
        F.col("doc_id").alias("chart_id"),
        F.concat(F.lit("qzx ("), a, F.lit("), wvj ("), b, F.lit("). "), "text").alias("description"),
        F.array(F.lit("wvj"), F.lit("qzx"), F.lit("kkkk")).alias("raw"),
        F.array(F.initcap(F.replace(a, F.lit(" "), F.lit("_"))), F.upper(b)).alias("needed"),
    )


@register("joi8_alias_matches", v.ctes(NAMED) + """
select chart_id, replace(upper(left(a, 1)) || substr(a, 2), ' ', '_') as renamed, 'qzx' as raw, 1.0::double as score, a as evidence from named
union all select chart_id, upper(b), 'wvj', 1.0::double, b from named""")
def alias_matches(spark, sf):
    rows = ma.match_columns(named(spark, sf)).select("chart_id", F.inline("matches"))
    return rows.withColumn("score", F.round("score", 9))


@register("joi9_unresolved_names", v.ctes(NAMED) + """
select chart_id, 'none of them' as missing from named""")
def unresolved_names(spark, sf):
    charts = named(spark, sf).withColumn("needed", F.array_append("needed", F.lit("none of them"))).withColumn("raw", F.slice("raw", 1, 2))
    return ma.unresolved(ma.match_columns(charts), "chart_id").select("chart_id", "missing")

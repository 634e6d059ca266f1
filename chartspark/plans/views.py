"""Chart-collection views over the given tables, as DataFrames and as SQL for the check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION_TYPES = ["metadata", "value extraction", "comparison", "trends", "reasoning"]

RAW_TYPES = [
    "Grouped Bar Chart", "Scatter-Plot", "pie chart", "Correlation_Heatmap", "KDE Plot", "Violin plot",
    "Line Chart", "Sankey diagram", " Histogram ", "", "Q-Q Plot", "Sunburst chart",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def results_v(spark: SparkSession, sf: str) -> DataFrame:
    """Graded answers: chart_id, model, row_id, question, k, qtype, correct, value."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    events = table(spark, sf, "events").withColumn("k", k)
    return events.select(
        (F.col("event_id") % 1100).alias("chart_id"),
        F.col("event_type").alias("model"),
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("q"), (F.col("k") % 7).cast("string")).alias("question"),
        "k",
        F.when(F.col("k") % 7 < 6, pick(F.col("k") % 7, [*QUESTION_TYPES, "other"])).alias("qtype"),
        F.when(F.col("k") % 11 != 0, F.col("value") > 10).alias("correct"),
        "value",
    )


RESULTS = """results_v as (
  select event_id % 1100 as chart_id, event_type as model, event_id as row_id,
         concat('q', cast(k % 7 as varchar)) as question, k,
         case k % 7 when 0 then 'metadata' when 1 then 'value extraction' when 2 then 'comparison'
                    when 3 then 'trends' when 4 then 'reasoning' when 5 then 'other' else null end as qtype,
         case when k % 11 = 0 then null else value > 10 end as correct, value
  from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events) e)"""


def charts_v(spark: SparkSession, sf: str) -> DataFrame:
    """Slim chart records: chart_id, dataset_id, raw_type, description, n_chars."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("chart_id"),
        F.col("source").alias("dataset_id"),
        pick(F.col("doc_id") % 12, RAW_TYPES).alias("raw_type"),
        F.col("text").alias("description"),
        "n_chars",
    )


CHARTS = """charts_v as (
  select doc_id as chart_id, source as dataset_id,
         case doc_id % 12 when 0 then 'Grouped Bar Chart' when 1 then 'Scatter-Plot' when 2 then 'pie chart'
              when 3 then 'Correlation_Heatmap' when 4 then 'KDE Plot' when 5 then 'Violin plot'
              when 6 then 'Line Chart' when 7 then 'Sankey diagram' when 8 then ' Histogram ' when 9 then ''
              when 10 then 'Q-Q Plot' else 'Sunburst chart' end as raw_type,
         text as description, n_chars
  from documents)"""


def images_v(spark: SparkSession, sf: str) -> DataFrame:
    """Refinement iterations, one row each: chart_id, pos, path, feedback."""
    path = F.concat(F.lit("images/"), F.col("conv_id").cast("string"), F.lit("_it"),
                    F.col("turn").cast("string"), F.lit(".png"))
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("chart_id"),
        F.col("turn").alias("pos"),
        path.alias("path"),
        F.when(F.col("role") == "assistant", F.lit("")).otherwise(F.col("text")).alias("feedback"),
    )


IMAGES = """images_v as (
  select conv_id as chart_id, turn as pos,
         concat('images/', cast(conv_id as varchar), '_it', cast(turn as varchar), '.png') as path,
         case when role = 'assistant' then '' else text end as feedback
  from conversations)"""


def records_v(spark: SparkSession, sf: str) -> DataFrame:
    """Nested chart records built row by row from `documents`; no grouping is needed.

    A record has doc_id % 5 images and doc_id % 4 + 1 questions. One image of three carries
    blank feedback; every image has its own code revision.
    """
    docs = table(spark, sf, "documents")
    name = F.col("doc_id").cast("string")

    def image(i: Column) -> Column:
        return F.struct(
            F.concat(F.lit("images/"), name, F.lit("_it"), i.cast("string"), F.lit(".png")).alias("path"),
            F.when((F.col("doc_id") + i) % 3 == 0, F.lit("  ")).otherwise(F.col("lang")).alias("feedback"),
            F.concat(F.lit('df["'), F.col("source"), F.lit('"].plot("v'), i.cast("string"), F.lit('")')).alias("code"),
        )

    def question(i: Column) -> Column:
        return F.struct(
            F.concat(F.lit("q"), i.cast("string")).alias("question"),
            F.col("lang").alias("answer"),
            F.when(i % 2 == 0, "image").otherwise("both").alias("answer_basis"),
            pick(i, QUESTION_TYPES).alias("type"),
        )

    n_images, n_questions = F.col("doc_id") % 5, F.col("doc_id") % 4 + 1
    return docs.select(
        name.alias("id"),
        F.struct(F.col("source").alias("id"), F.col("text").alias("description")).alias("dataset"),
        F.struct(
            pick(F.col("doc_id") % 12, RAW_TYPES).alias("type"),
            F.lit("default").alias("style"),
            F.col("text").alias("full_description"),
            F.concat_ws(" ", F.col("source"), F.col("lang")).alias("short_description"),
            F.concat(F.lit("df['"), F.col("lang"), F.lit("'].plot()")).alias("code"),
            F.transform(F.sequence(F.lit(0).cast("bigint"), n_questions - 1), question).alias("questions"),
        ).alias("graph"),
        F.when(n_images > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n_images - 1), image))
        .otherwise(F.array().cast("array<struct<path:string,feedback:string,code:string>>"))
        .alias("images"),
    )


def stored_records_v(spark: SparkSession, sf: str) -> DataFrame:
    """The records as stored lines hold them (`record`, map<string,variant>), with odd entries after their images:
    a bare text, a number, null, an object with unknown keys, one without a path and one whose path is a number."""
    name = F.col("id")
    listed = F.transform("images", lambda x: F.parse_json(F.to_json(x)))
    own = F.concat(F.lit('{"path":"images/'), name, F.lit('-x.png","feedback":["a"," b "],"w":3.5}'))
    odd = ['"images/bare.png"', "5", "null", '{"w":[1,null]}', '{"path":7}']
    return records_v(spark, sf).select(F.create_map(
        F.lit("id"), name.cast("variant"), F.lit("dataset"), F.to_variant_object("dataset"), F.lit("graph"), F.to_variant_object("graph"),
        F.lit("extra"), F.parse_json(F.lit('{"level":2,"none":null}')),
        F.lit("images"), F.concat(listed, F.array(F.parse_json(own), *[F.parse_json(F.lit(x)) for x in odd])).cast("variant"),
    ).alias("record"))


def stored_images(records: DataFrame) -> DataFrame:
    """Image entries of stored records, one row each, with their whole JSON text."""
    get = lambda key, kind: F.try_variant_get(F.try_element_at("record", F.lit(key)), "$", kind)
    rows = records.select(get("id", "string").alias("id"), F.to_json(F.try_element_at("record", F.lit("extra"))).alias("extra"),
                          F.posexplode(get("images", "array<variant>")).alias("pos", "image"))
    return rows.select("id", "extra", "pos", F.to_json("image").alias("image"))


REC_IMAGES = """rec_images as (
  select doc_id, i as pos,
         concat('images/', cast(doc_id as varchar), '_it', cast(i as varchar), '.png') as path,
         case when (doc_id + i) % 3 = 0 then '  ' else lang end as feedback,
         concat('df["', source, '"].plot("v', cast(i as varchar), '")') as code, lang, source, text
  from (select *, unnest(range(0, doc_id % 5)) as i from documents) d)"""

REC_QUESTIONS = """rec_questions as (
  select doc_id as chart_id, source as dataset_id, text, lang, i as pos,
         concat('q', cast(i as varchar)) as question, lang as answer,
         case when i % 2 = 0 then 'image' else 'both' end as answer_basis,
         case i when 0 then 'metadata' when 1 then 'value extraction' when 2 then 'comparison'
                when 3 then 'trends' else 'reasoning' end as qtype
  from (select *, unnest(range(0, doc_id % 4 + 1)) as i from documents) d)"""


def ctes(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"

"""Queries: readers and writers. Each writes a view below the scratch folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark.functions import images as im
from chartspark.operators import bundle as bu
from chartspark.operators import evaluation as ev
from chartspark.plans import views as v
from chartspark.plans.evaluation import BY_TYPE
from chartspark.plans.registry import register
from chartspark.session import scratch_dir
from chartspark.sources import changes as ch
from chartspark.sources import readers as rd
from chartspark.sources import writers as wr

RECORD_SQL = v.ctes(v.REC_IMAGES) + """
select cast(doc_id as varchar) as id, source as dataset_id, cast(doc_id % 5 as integer) as images, cast(doc_id % 4 + 1 as integer) as questions,
       case when doc_id % 5 > 0 then 'images/' || doc_id || '_it' || (doc_id % 5 - 1) || '.png' end as final_image,
       case when doc_id % 5 = 4 and (doc_id + 3) % 3 <> 0 then 'bad' else 'good' end as quality, text as description
from documents"""


def summary(records):
    return records.select(
        "id", F.col("dataset.id").alias("dataset_id"), F.size("images").alias("images"), F.size("graph.questions").alias("questions"),
        im.final_image(F.col("images"))["path"].alias("final_image"), im.quality(F.col("images")).alias("quality"),
        F.col("dataset.description").alias("description"),
    )


@register("src1_strict_jsonl", RECORD_SQL)
def strict_jsonl(spark, sf):
    path = scratch_dir(spark, "records")
    wr.overwrite_jsonl(v.records_v(spark, sf), path)
    return summary(rd.read_records(spark, path))


@register("src2_lenient_jsonl", """
select doc_id, lang, text from documents where doc_id % 5 > 1""")
def lenient_jsonl(spark, sf):
    fifth = F.col("doc_id") % 5
    line = F.when(fifth == 0, "{bad").when(fifth == 1, "  ").otherwise(F.to_json(F.struct("doc_id", "lang", "text")))
    path = scratch_dir(spark, "lines")
    v.table(spark, sf, "documents").select(line.alias("value")).write.text(path)
    return rd.read_jsonl(spark, path, "doc_id bigint, lang string, text string", strict=False)


@register("src3_gzip_jsonl", RECORD_SQL)
def gzip_jsonl(spark, sf):
    path = scratch_dir(spark, "gzip")
    wr.write_jsonl_gz(v.records_v(spark, sf), path)
    return summary(rd.read_records(spark, path))


@register("src4_document", """
select cast(1 as integer) as schema_version, count(*) as chart_count, cast(sum(n_chars) as bigint) as chars, min(lang) as first_lang from documents""")
def document(spark, sf):
    totals = v.table(spark, sf, "documents").agg(
        F.lit(1).alias("schema_version"), F.count(F.lit(1)).alias("chart_count"), F.sum("n_chars").alias("chars"), F.min("lang").alias("first_lang"))
    path = scratch_dir(spark, "manifest")
    wr.write_document(totals, path)
    return rd.read_document(spark, path, "schema_version int, chart_count bigint, chars bigint, first_lang string")


STORED = "row_id bigint, chart_id string, graph_id string, correct boolean, value double"


def result_folder(spark, sf):
    """One `.jsonl` folder per model. Even rows have a chart_id, others a graph_id or no key at all."""
    results = v.results_v(spark, sf)
    third = F.col("row_id") % 3
    stored = results.select(
        "model", "row_id", F.when(third == 0, F.col("chart_id").cast("string")).when(third == 1, "").alias("chart_id"),
        F.when(third != 2, F.concat(F.lit("g"), F.col("chart_id").cast("string"))).alias("graph_id"), "correct", "value",
    )
    path = scratch_dir(spark, "results")
    for row in results.select("model").distinct().collect():  # one value per model
        wr.overwrite_jsonl(stored.where(F.col("model") == row.model).drop("model"), f"{path}/{row.model}.jsonl")
    return path


@register("src5_model_results", v.ctes(v.RESULTS) + """
select model, row_id, case when row_id % 3 = 0 then cast(chart_id as varchar) else 'g' || chart_id end as chart_id, correct, value
from results_v where row_id % 3 < 2""")
def model_results(spark, sf):
    return rd.read_results(spark, result_folder(spark, sf), STORED)


@register("src6_shards", """
select doc_id, lang, text, 'metadata' || doc_id % 4 || '.jsonl' as shard from documents where doc_id % 4 >= 2""")
def shards(spark, sf):
    path = scratch_dir(spark, "shards")
    docs = v.table(spark, sf, "documents").select("doc_id", "lang", "text")
    for n in range(4):
        wr.overwrite_jsonl(docs.where(F.col("doc_id") % 4 == n), f"{path}/metadata{n}.jsonl")
        wr.overwrite_jsonl(docs.where(F.col("doc_id") % 4 == n), f"{path}/metadata{n}_{n}.jsonl")
    return rd.read_shards(spark, path, r"metadata(\d)\.jsonl", 2, "doc_id bigint, lang string, text string")


@register("src6_bad_lines", """
select doc_id, text, 'metadata7.jsonl' as shard from documents where doc_id % 5 > 1""")
def bad_shard_lines(spark, sf):
    fifth = F.col("doc_id") % 5
    line = F.when(fifth == 0, "{bad").when(fifth == 1, " ").otherwise(F.to_json(F.struct("doc_id", "text")))
    path = scratch_dir(spark, "shards")
    v.table(spark, sf, "documents").select(line.alias("value")).write.text(f"{path}/metadata7.jsonl")
    return rd.read_shards(spark, path, r"metadata(\d)\.jsonl", 2, "doc_id bigint, text string", strict=False)


@register("src7_tables", " union all ".join(f"""
select '{s}' as suffix, lang, source, count(*) as rows, cast(sum(n_chars) as bigint) as chars, cast(sum(length(text)) as bigint) as letters
from documents group by 2, 3""" for s in ("csv", "tsv", "json", "jsonl", "parquet")))
def tables(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", F.regexp_replace("text", r"[\r\n]", " ").alias("text"))
    path = scratch_dir(spark, "tables")
    options = {"header": True, "quote": '"', "escape": '"'}
    docs.write.options(**options).csv(f"{path}/t.csv")
    docs.write.options(**options, sep="\t").csv(f"{path}/t.tsv")
    # A `.json` file is one document: here an array of the rows of a thousand identifiers.
    arrays = docs.groupBy(F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.to_json(F.collect_list(F.struct(*docs.columns))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/t.json")
    docs.write.json(f"{path}/t.jsonl")
    docs.write.parquet(f"{path}/t.parquet")
    schema = "doc_id bigint, lang string, source string, n_chars bigint, text string"
    out = None
    for suffix in ("csv", "tsv", "json", "jsonl", "parquet"):
        one = rd.read_table(spark, f"{path}/t.{suffix}", schema).groupBy("lang", "source").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars"), F.sum(F.length("text").cast("bigint")).alias("letters"))
        one = one.withColumn("suffix", F.lit(suffix))
        out = one if out is None else out.unionByName(one)
    return out


@register("src8_row_index", "select count(*) as lines, true as dense from documents")
def row_index(spark, sf):
    path = scratch_dir(spark, "lines")
    wr.overwrite_jsonl(v.records_v(spark, sf), path)
    per_file = rd.read_lines(spark, path).groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.max("row_index").alias("last"), F.sum("row_index").alias("total"))
    dense = (F.col("last") == F.col("n") - 1) & (F.col("total") * 2 == F.col("n") * (F.col("n") - 1))
    return per_file.agg(F.sum("n").alias("lines"), F.bool_and(dense).alias("dense"))


@register("src8_find_record", """
select cast(doc_id as varchar) as id, source as dataset_id from documents where doc_id = (select max(doc_id) from documents)""")
def find_record(spark, sf):
    path = scratch_dir(spark, "lines")
    wr.overwrite_jsonl(v.records_v(spark, sf), path)
    last = v.table(spark, sf, "documents").agg(F.max("doc_id")).first()[0]
    found = rd.find_record(rd.read_indexed_records(spark, path), chart_id=str(last))
    return found.select("id", F.col("dataset.id").alias("dataset_id"))


@register("src8_bad_lines", """
select cast(doc_id as varchar) as id, source as dataset_id, text as description from documents where doc_id % 5 > 1""")
def bad_record_lines(spark, sf):
    fifth = F.col("id").cast("long") % 5
    record = F.to_json(F.struct("id", "dataset", "graph", "images"))
    path = scratch_dir(spark, "lines")
    v.records_v(spark, sf).select(F.when(fifth == 0, "{bad").when(fifth == 1, "  ").otherwise(record).alias("value")).write.text(path)
    kept = rd.read_indexed_records(spark, path, strict=False)
    return kept.select("id", F.col("dataset.id").alias("dataset_id"), F.col("dataset.description").alias("description"))


@register("src9_point_lookup", v.ctes(v.RESULTS) + "select * from results_v where chart_id = (select min(chart_id) + 5 from results_v)")
def point_lookup(spark, sf):
    path = scratch_dir(spark, "index")
    results = v.results_v(spark, sf)
    wr.write_results_index(results, path, "chart_id", ["row_id"])
    wanted = results.agg(F.min("chart_id") + 5).first()[0]
    return wr.lookup(spark, path, wanted)


@register("src9_key_index", v.ctes(v.RESULTS) + """
select 'one' as lookup, * from results_v where chart_id = (select min(chart_id) + 5 from results_v)
union all select 'absent', * from results_v where chart_id = -1
union all select 'many', * from results_v where chart_id in (select doc_id * 3 from documents where doc_id % 2 = 0)""")
def key_index(spark, sf):
    """One key, a key that no file holds, and a table of keys with repeats, nulls and keys that don't occur."""
    path = scratch_dir(spark, "key-index")
    results = v.results_v(spark, sf)
    wr.write_key_index(results, path, "chart_id", ["row_id"], slots=32)
    wanted = results.agg(F.min("chart_id") + 5).first()[0]
    docs = v.table(spark, sf, "documents").select((F.col("doc_id") * 3).alias("chart"), F.col("doc_id") % 2 == 0)
    keys = docs.select(F.when(docs[1], F.col("chart")).alias("chart"))
    found = {"one": wr.lookup_key(spark, path, wanted, slots=32), "absent": wr.lookup_key(spark, path, -1, slots=32),
             "many": wr.lookup_keys(spark, path, keys.unionByName(keys), slots=32)}
    parts = [rows.select(F.lit(name).alias("lookup"), *results.columns) for name, rows in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("src10_changed_files", v.ctes(v.RESULTS) + """
select chart_id, cast(count(*) filter (where coalesce(correct, false)) as bigint) as correct,
       cast(count(*) filter (where not coalesce(correct, false)) as bigint) as incorrect from results_v group by 1""")
def changed_files(spark, sf):
    """One model's results are stored in half and counted; then its files are replaced by the whole, and only the new files are read."""
    folder, before, after = result_folder(spark, sf), scratch_dir(spark, "counts"), scratch_dir(spark, "counts")
    schema = "chart_id string, graph_id string, row_id bigint, correct boolean"

    def count(paths):
        rows = rd.read_jsonl(spark, paths, schema, keep_file=True).withColumnRenamed("_file", "file")
        # The row number gives back the chart of rows stored without a key.
        return rows.groupBy("file", (F.col("row_id") % 1100).alias("chart_id")).agg(
            F.count_if(ev.right()).alias("correct"), F.count_if(~ev.right()).alias("incorrect"))

    whole = v.results_v(spark, sf).where("model = 'error'").select("row_id", "correct")
    wr.overwrite_jsonl(whole.where("row_id % 2 = 0"), f"{folder}/error.jsonl")
    ch.refresh_folder(spark, folder, None, before, count)
    wr.overwrite_jsonl(whole, f"{folder}/error.jsonl")
    ch.refresh_folder(spark, folder, before, after, count)
    return ch.totals(spark.read.parquet(f"{after}/counts"))


@register("snk1_append_jsonl", """
select doc_id, lang, cast(2 as bigint) as copies from documents""")
def append_jsonl(spark, sf):
    path = scratch_dir(spark, "append")
    docs = v.table(spark, sf, "documents").select("doc_id", "lang", "text")
    for _ in range(2):
        wr.append_jsonl(docs, path)
    stored = rd.read_jsonl(spark, path, "doc_id bigint, lang string, text string")
    return stored.groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("copies"))


@register("snk2_overwrite_jsonl", "select doc_id, text from documents")
def overwrite_jsonl(spark, sf):
    path = scratch_dir(spark, "overwrite")
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    for _ in range(2):
        wr.overwrite_jsonl(docs, path)
    return rd.read_jsonl(spark, path, "doc_id bigint, text string")


EXTRA = """'{"level":2,"none":null}' as extra"""


@register("snk4_rewrite", v.ctes(v.REC_IMAGES) + f"""
select cast(doc_id as varchar) as id, {EXTRA}, cast(pos as integer) as pos,
       '{{"code":"df[\\"' || source || '\\"].plot(\\"v' || pos || '\\")","feedback":"' || feedback || '","path":"' || substr(path, 8) || '"}}' as image
from rec_images union all
select cast(doc_id as varchar), {EXTRA}, cast(doc_id % 5 + o.pos as integer), replace(o.image, '#', cast(doc_id as varchar))
from documents, (values (0, '{{"feedback":["a"," b "],"path":"#-x.png","w":3.5}}'), (1, '"images/bare.png"'), (2, '5'), (3, 'null'),
                        (4, '{{"w":[1,null]}}'), (5, '{{"path":7}}')) o(pos, image)""")
def rewrite(spark, sf):
    path = scratch_dir(spark, "rewrite")
    wr.overwrite_objects(v.stored_records_v(spark, sf), path)
    wr.rewrite(
        spark, path,
        change=lambda records: records.withColumn("record", im.stored_without_prefix(F.col("record"), "images/")),
        read=lambda p: rd.read_objects(spark, p), write=wr.overwrite_objects,
    )
    return v.stored_images(rd.read_objects(spark, path))


@register("snk5_by_dataset", "select source as dataset_id, doc_id as chart_id, text as description from documents")
def by_dataset(spark, sf):
    path = scratch_dir(spark, "bundle")
    wr.write_by_dataset(v.charts_v(spark, sf).select("dataset_id", "chart_id", "description"), path, ["chart_id"])
    return spark.read.schema("chart_id bigint, description string, dataset_id string").json(path)


@register("snk5_results", v.ctes(v.RESULTS) + """
select d.source as dataset_id, r.chart_id, r.row_id, r.model, r.question, r.correct from results_v r join documents d on r.chart_id = d.doc_id""")
def results_by_dataset(spark, sf):
    path = scratch_dir(spark, "results")
    results = v.results_v(spark, sf).select("chart_id", "row_id", "model", "question", "correct")
    wr.write_by_dataset(bu.results_of_datasets(results, v.charts_v(spark, sf)), path, ["chart_id", "row_id"])
    return spark.read.schema("chart_id bigint, row_id bigint, model string, question string, correct boolean, dataset_id string").json(path)


@register("snk6_manifest", """
select count(distinct source) as dataset_count, count(*) as chart_count, (select string_agg(event_type, ',' order by event_type)
       from (select distinct event_type from events) e) as models from documents""")
def manifest(spark, sf):
    from chartspark.plans.bundle import manifest as built

    path = scratch_dir(spark, "manifest")
    wr.write_document(built(spark, sf), path)
    return rd.read_document(spark, path, "dataset_count bigint, chart_count bigint, models string")


@register("snk7_accuracy_summary", BY_TYPE + "select model, type, c as correct, i as incorrect from summary")
def accuracy_summary(spark, sf):
    path = scratch_dir(spark, "summary")
    wr.write_summary(ev.accuracy_by_type(v.results_v(spark, sf)), path)
    return spark.read.schema("type string, correct bigint, incorrect bigint, model string").json(path)

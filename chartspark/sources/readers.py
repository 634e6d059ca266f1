"""Readers: JSON lines (strict, lenient, gzip), model results, shards, tables by suffix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartspark.functions.images import typed_images
from chartspark.schemas import RECORD, RESULT, STRUCTURED_KEYS, TEXT_OR_LIST_KEYS

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True, keep_file: bool = False,
               files: Callable[[Column], Column] | None = None) -> DataFrame:
    """JSON lines, plain or gzip. Blank lines are skipped.

    Strict: the query fails at the first undecodable line, naming its file and text.
    Lenient: such lines are skipped. Either way it is a filter inside the one scan. `files`
    is a condition on the file path: files that fail it are not read.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    if files is not None:
        lines = lines.where(files(F.col("_file")))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.where(~F.rlike("value", F.lit(r"^\s*$"))).withColumn(
        "_row", F.from_json("value", f"{schema}, {CORRUPT} string", options))
    good = F.col(f"_row.{CORRUPT}").isNull()
    if strict:
        message = F.concat(F.lit("Invalid JSON in "), "_file", F.lit(": "), "value")
        rows = parsed.where(F.when(good, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    else:
        rows = parsed.where(good)
    out = rows.select("_row.*", "_file").drop(CORRUPT)
    return out if keep_file else out.drop("_file")


def read_records(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """Chart records with typed images; see `schemas.RECORD` for the stored shape."""
    raw = read_jsonl(spark, path, RECORD, strict)
    return raw.withColumn("images", typed_images(F.col("images")))


def read_objects(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """JSON objects, one a line, as `record` (map<string,variant>): every key and value as stored.

    Strict: a line that is no object fails the query, naming its file and text. Lenient: it is skipped.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    parsed = lines.where(~F.rlike("value", F.lit(r"^\s*$"))).withColumn("record", F.from_json("value", "map<string,variant>"))
    good = F.col("record").isNotNull()
    if strict:
        message = F.concat(F.lit("Invalid JSON in "), "_file", F.lit(": "), "value")
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return parsed.where(good).select("record")


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole-file JSON: one document per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def jsonl_name(file_path: Column) -> Column:
    """Name of the `.jsonl` file a row came from, or of the `.jsonl` folder that Spark wrote."""
    return F.url_decode(F.regexp_extract(file_path, r"([^/]+\.jsonl)(?:\.gz)?(?:/[^/]*)?$", 1))


def read_results(spark: SparkSession, path: str, schema: str = RESULT, strict: bool = True) -> DataFrame:
    """Every `*.jsonl` result of a folder; its name without the extension is the model.

    The key is `chart_id`, else `graph_id`; rows without a key are dropped.
    """
    rows = read_jsonl(spark, f"{path}/*.jsonl*", schema, strict, keep_file=True)
    key = F.coalesce(F.nullif("chart_id", F.lit("")), F.nullif("graph_id", F.lit("")))
    keyed = rows.withColumns({"chart_id": key, "model": F.regexp_replace(jsonl_name(F.col("_file")), r"\.jsonl$", "")})
    return keyed.where(F.col("chart_id").isNotNull()).drop("_file", "graph_id")


def read_shards(spark: SparkSession, path: str, pattern: str, min_number: int, schema: str, strict: bool = True) -> DataFrame:
    """Shards whose name fits `pattern` and whose number, its first group, is at least `min_number`.

    The condition is on the file path only, so other shards are left out before they are read.
    An undecodable line fails the query, or is skipped when not strict.
    """

    def wanted(file_path: Column) -> Column:
        return F.regexp_extract(jsonl_name(file_path), f"^{pattern}$", 1).try_cast("int") >= min_number

    rows = read_jsonl(spark, f"{path}/*.jsonl*", schema, strict, keep_file=True, files=wanted)
    return rows.withColumn("shard", jsonl_name(F.col("_file"))).drop("_file")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Any source table, by suffix: csv, tsv, json, jsonl or parquet."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if suffix in ("csv", "tsv"):
        options = {"header": True, "sep": "\t" if suffix == "tsv" else ",", "multiLine": False, "quote": '"', "escape": '"'}
        return reader.options(**options, inferSchema=schema is None).csv(path)
    if suffix == "json":
        return reader.option("multiLine", True).json(path)
    if suffix == "jsonl":
        return reader.json(path)
    if suffix == "parquet":
        return reader.parquet(path)
    raise ValueError(f"Unsupported table format: {path}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their 0-based number in the file: `file`, `row_index`, `value`.

    Identifiers are consecutive inside each split of a file, so the first one and the line
    counts of the earlier splits, one row per split, number the lines without sorting any.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"),
    )
    counts = lines.groupBy(F.col("file").alias("_f"), F.col("_split").alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("_f").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_f", "_s", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = lines.join(starts, (F.col("file") == F.col("_f")) & (F.col("_split") == F.col("_s")))
    return joined.select("file", (F.col("_id") + F.col("_shift")).alias("row_index"), "value")


def read_indexed_records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Chart records with the line number that carries their order.

    Strict: the query fails at an undecodable line, naming its file, 1-based number and text. Lenient: it is skipped.
    """
    lines = read_lines(spark, path).where(~F.rlike("value", F.lit(r"^\s*$")))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.withColumn("_record", F.from_json("value", RECORD if CORRUPT in RECORD else f"{RECORD}, {CORRUPT} string", options))
    good = F.col(f"_record.{CORRUPT}").isNull()
    if strict:
        message = F.concat(F.lit("Invalid JSON in "), "file", F.lit(", line "), (F.col("row_index") + 1).cast("string"), F.lit(": "), "value")
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return parsed.where(good).select("file", "row_index", "_record.*").drop(CORRUPT).withColumn("images", typed_images(F.col("images")))


def find_record(records: DataFrame, chart_id: str | None = None, index: int | None = None) -> DataFrame:
    """The first record with this id or at this line; fails when there is none."""
    wanted = F.lit(False)
    if chart_id is not None:
        wanted = wanted | (F.col("id") == chart_id)
    if index is not None:
        wanted = wanted | (F.col("row_index") == index)
    found = records.where(wanted).orderBy("row_index").limit(1)
    if found.isEmpty():
        raise LookupError(f"no record with id {chart_id} or index {index}")
    return found


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: path, file (the path as `_metadata` of rows has it), name, length, modified. File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        "path", F.col("_metadata.file_path").alias("file"), F.substring_index("path", "/", -1).alias("name"), "length", F.col("modificationTime").alias("modified")
    )


def structured_data(data: Column) -> Column:
    """Structured chart data as a typed struct; a lone text becomes a list of one."""
    fields = []
    for key in STRUCTURED_KEYS:
        if key in ("plot_type", "title"):
            value = F.try_variant_get(data, f"$.{key}", "string")
        elif key in ("n_rows_input", "n_rows_plotted"):
            value = F.try_variant_get(data, f"$.{key}", "bigint")
        else:
            listed = F.try_variant_get(data, f"$.{key}", "array<string>")
            value = listed
            if key in TEXT_OR_LIST_KEYS or key == "facet":
                single = F.try_variant_get(data, f"$.{key}", "string")
                value = F.coalesce(listed, F.when(single.isNotNull(), F.array(single)))
        fields.append(value.alias(key))
    return F.struct(*fields)

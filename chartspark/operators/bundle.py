"""Publishable bundle of a chart collection: image resolution, index, rollups, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.functions import images as im
from chartspark.functions.taxonomy import family_by_spelling
from chartspark.functions.text import join_url, label_120


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def resolve_images(images: DataFrame, listing: DataFrame, folder: str = "images/") -> DataFrame:
    """Add the stored file of each image path: the exact path, else the same name in `folder`.

    `listing` has one row per file (path, length). Both look-ups are equi-joins on that key. Rows without a path find
    nothing; they are dealt out by a second key, as all nulls of one join key are read by one task.
    """
    found = F.struct(F.col("path"), F.lit(0).cast("bigint"))
    exact = listing.select(found.alias("_exact_key"), F.col("path").alias("_exact"), F.col("length").alias("_exact_length"))
    named = listing.select(found.alias("_named_key"), F.col("path").alias("_named"), F.col("length").alias("_named_length"))
    path = F.coalesce(images["path"], F.lit(""))
    dealt = F.when(images["path"].isNull(), F.monotonically_increasing_id() + 1).otherwise(0)
    rows = images.withColumn("_dealt", dealt).withColumns({"_path": F.struct(path, "_dealt"), "_name": F.struct(F.concat(F.lit(folder), file_name(path)), "_dealt")})
    joined = rows.join(exact, rows["_path"] == exact["_exact_key"], "left").join(named, rows["_name"] == named["_named_key"], "left")
    return joined.select(
        *[rows[c] for c in images.columns],
        F.coalesce("_exact", "_named").alias("source"),
        F.coalesce("_exact_length", "_named_length").alias("length"),
    )


def image_availability(images: DataFrame, listing: DataFrame) -> DataFrame:
    """Found and missing images per chart, each file name counted once (its first path decides)."""
    named = images.where(F.coalesce("path", F.lit("")) != "").withColumn("_name", file_name(F.col("path")))
    once = named.groupBy("chart_id", "_name").agg(F.min_by("path", "pos").alias("path"))
    resolved = resolve_images(once, listing)
    return resolved.groupBy("chart_id").agg(
        F.count("source").alias("found"),
        F.count_if(F.col("source").isNull()).alias("missing"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("image_bytes"),
    )


def missing_files(images: DataFrame, listing: DataFrame, folder: str = "images/") -> DataFrame:
    """Image paths that resolve to no file."""
    return resolve_images(images, listing, folder).where(F.col("source").isNull()).drop("source", "length")


def url_or_null(base_url: str, relative: Column) -> Column:
    return join_url(F.lit(base_url), relative)


def chart_index(charts: DataFrame, base_url: str = "") -> DataFrame:
    """The 18 slim columns of a chart index.

    `charts` has id, dataset_id, dataset_description, graph_type, short_description,
    final_path, final_source (null when the file is missing), quality, correct, incorrect.
    """
    dataset, chart = F.col("dataset_id").cast("string"), F.col("id").cast("string")
    thumbnail = F.concat(F.lit("thumbnails/"), dataset, F.lit("/"), chart, F.lit(".jpg"))
    detail = F.concat(F.lit("charts/"), dataset, F.lit("/"), chart, F.lit("/"))
    metadata, results = F.concat(detail, F.lit("metadata.json")), F.concat(detail, F.lit("results.jsonl.gz"))
    stored = F.col("final_source").isNotNull()
    return charts.select(
        chart.alias("id"),
        dataset.alias("dataset_id"),
        "dataset_description",
        family_by_spelling(F.col("graph_type")).alias("canonical_type"),
        "graph_type",
        "short_description",
        F.when(stored, thumbnail).alias("thumbnail"),
        F.when(stored, url_or_null(base_url, thumbnail)).alias("thumbnail_url"),
        detail.alias("detail"),
        url_or_null(base_url, detail).alias("detail_url"),
        metadata.alias("metadata"),
        url_or_null(base_url, metadata).alias("metadata_url"),
        results.alias("results"),
        url_or_null(base_url, results).alias("results_url"),
        im.bundle_path(F.col("final_path")).alias("final_image"),
        "quality",
        F.coalesce("correct", F.lit(0)).alias("correct"),
        F.coalesce("incorrect", F.lit(0)).alias("incorrect"),
    )


def detail_urls(index: DataFrame, base_url: str) -> DataFrame:
    """Addresses of a chart's detail files; missing ones are built from what is there."""
    relative = F.coalesce("detail", F.concat(F.lit("charts/"), "dataset_id", F.lit("/"), "id", F.lit("/")))
    detail = F.coalesce("detail_url", url_or_null(base_url, relative))
    return index.select(
        "id",
        detail.alias("detail_url"),
        F.coalesce("metadata_url", join_url(detail, F.lit("metadata.json"))).alias("metadata_url"),
        F.coalesce("results_url", join_url(detail, F.lit("results.jsonl.gz"))).alias("results_url"),
    )


def chart_sizes(charts: DataFrame, results: DataFrame, images: DataFrame, listing: DataFrame) -> DataFrame:
    """Per chart: result records, stored images and their bytes.

    Results and images are counted per chart before they meet, so no join sees a hot key.
    """
    counted = results.groupBy("chart_id").agg(F.count(F.lit(1)).alias("result_record_count"))
    stored = image_availability(images, listing).select(
        "chart_id", F.col("found").alias("image_count"), F.col("image_bytes").alias("detail_bytes")
    )
    joined = charts.join(counted, "chart_id", "left").join(stored, "chart_id", "left")
    sizes = ("result_record_count", "image_count", "detail_bytes")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in sizes})


def chart_entries(sized: DataFrame) -> DataFrame:
    """One row per chart for the entry list of its dataset: places of its files, counts and bytes."""
    dataset, chart = F.col("dataset_id").cast("string"), F.col("chart_id").cast("string")
    detail = F.concat(F.lit("charts/"), dataset, F.lit("/"), chart, F.lit("/"))
    return sized.select(
        dataset.alias("dataset_id"), chart.alias("id"), detail.alias("detail"),
        F.concat(detail, F.lit("metadata.json")).alias("metadata"), F.concat(detail, F.lit("results.jsonl.gz")).alias("results"),
        "detail_bytes", "result_record_count", "image_count",
    )


def results_of_datasets(results: DataFrame, charts: DataFrame) -> DataFrame:
    """Results with the dataset of their chart; those of unknown charts are left out. `charts` has one row per chart."""
    return results.join(charts.select("chart_id", "dataset_id"), "chart_id")


def dataset_rollup(sized: DataFrame, order: str = "chart_id", base_url: str = "") -> DataFrame:
    """One row per dataset: label, chart, result and image counts, bytes, its file names and their addresses (null without `base_url`)."""
    rolled = sized.groupBy(F.col("dataset_id").cast("string").alias("dataset_id")).agg(
        F.min_by("description", order).alias("description"),
        F.count(F.lit(1)).alias("chart_count"),
        *[F.sum(c).alias(c) for c in ("image_count", "result_record_count", "detail_bytes")],
    )
    entry = F.concat(F.lit("datasets/"), "dataset_id", F.lit(".json"))
    charts = F.concat(F.lit("datasets/"), "dataset_id", F.lit(".charts.jsonl"))
    return rolled.select(
        "dataset_id", "description", label_120(F.col("description")).alias("label"), "chart_count", "image_count",
        "result_record_count", "detail_bytes",
        entry.alias("manifest"), url_or_null(base_url, entry).alias("manifest_url"),
        charts.alias("charts"), url_or_null(base_url, charts).alias("charts_url"),
    )


def manifest(index: DataFrame, models: DataFrame, base_url: str = "", shuffle_seed: int | None = 42) -> DataFrame:
    """One row: dataset, chart and model counts, sorted models, charts per family by name.

    All counts come from one (dataset, family) count. The lists are whole, as the one
    document that holds them asks for; `manifest_families` and `manifest_models` give the same as rows,
    and `dataset_rollup` the entries of its datasets.
    """
    cube = index.groupBy("dataset_id", "canonical_type").agg(F.count(F.lit(1)).alias("n"))
    totals = cube.groupBy("dataset_id").agg(F.sum("n").alias("n")).agg(
        F.count(F.lit(1)).alias("dataset_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("chart_count"))
    families = cube.groupBy("canonical_type").agg(F.sum("n").alias("n")).agg(F.array_sort(F.collect_list(F.struct("canonical_type", "n"))).alias("l"))
    distinct = models.select("model").distinct()
    listed = distinct.agg(F.array_sort(F.collect_list("model")).alias("l"))
    return totals.select(
        F.lit(1).alias("schema_version"),
        F.lit(base_url).alias("base_url"),
        F.lit("charts.jsonl.gz").alias("chart_index"),
        url_or_null(base_url, F.lit("charts.jsonl.gz")).alias("chart_index_url"),
        "dataset_count",
        "chart_count",
        F.lit("metadata" if shuffle_seed is None else "shuffle").alias("chart_order"),
        F.lit(shuffle_seed).cast("int").alias("shuffle_seed"),
        distinct.agg(F.count(F.lit(1)).cast("int")).scalar().alias("model_count"),
        listed.scalar().alias("models"),
        families.select(F.map_from_entries("l")).scalar().alias("canonical_type_counts"),
    )


def manifest_families(index: DataFrame) -> DataFrame:
    """Charts per family, a row each: for any number of families."""
    return index.groupBy("canonical_type").agg(F.count(F.lit(1)).alias("chart_count"))


def manifest_models(models: DataFrame) -> DataFrame:
    """The models, a row each: for any number of models."""
    return models.select("model").distinct()


def rewritten_records(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """Records whose stored images point to their copy in the bundle, others to their file name.

    `records` has whole records as `record` (map<string,variant>), whose other keys stay as they are.
    `resolved` has chart_id, path and source; the paths of one chart are as many as its record lists.
    """
    copied = F.concat(F.lit("images/"), F.regexp_replace(file_name(F.col("path")), r"\.[^.]*$", ""), F.lit(".jpg"))
    maps = resolved.where(F.col("source").isNotNull()).select("chart_id", "path", copied.alias("copy")).distinct().groupBy(
        F.col("chart_id").cast("string").alias("_chart")
    ).agg(F.map_from_entries(F.collect_list(F.struct("path", "copy"))).alias("_paths"))
    key = F.try_variant_get(F.try_element_at("record", F.lit("id")), "$", "string")
    joined = records.join(maps, key == F.col("_chart"), "left")
    return joined.withColumn("record", im.stored_mapped_paths(F.col("record"), F.col("_paths"))).drop("_chart", "_paths")

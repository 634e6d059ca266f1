"""Gallery indexes: trigram posting lists for text search and bitmaps for facet counts.

One folder holds three tables over the same row numbers: `rows` (the charts, in blocks), `postings` (trigram, block and the
places in it) and `bitmaps` (facet, value, bucket and its bits). A click then reads a few posting lists and bitmaps, not the texts.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.operators.gallery import ALL, search_blob, search_term

COLUMNS = ("chart_id", "dataset_id", "description", "raw_type", "family")
#: Rows of a block are numbered with so many bits; a posting list names places of one block.
BLOCK_BITS = 16
#: Posting lists end a text with two of these, so that every place begins a trigram.
END = "\x00"
#: Bytes of a row group of posting lists: a search skips all groups without its trigrams.
GROUP_BYTES = 1 << 20
#: Characters of text whose trigrams are held at once; their lists take some 30 times as much.
HELD = 1 << 21


def _parts(texts: pa.Array):
    """`(first, end)`: runs of about HELD characters, one text at least."""
    first, held = 0, 0
    for i, size in enumerate(pc.utf8_length(texts).to_pylist()):
        if held and held + size > HELD:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(texts):
        yield first, len(texts)


def _postings(batches):
    """Places of each trigram in each block, combined within a run of texts."""
    for batch in batches:
        for first, end in _parts(batch.column("blob")):
            part = batch.slice(first, end - first)
            found: dict[tuple[str, int], array] = defaultdict(lambda: array("i"))
            for number, text in zip(part.column("id").to_pylist(), part.column("blob"), strict=True):
                block, place, whole = number >> BLOCK_BITS, number & ((1 << BLOCK_BITS) - 1), text.as_py() + 2 * END
                for gram in {whole[i : i + 3] for i in range(len(whole) - 2)}:
                    found[gram, block].append(place)
            ends = np.cumsum([0, *map(len, found.values())], dtype=np.int32)
            places = pa.array(np.concatenate([np.frombuffer(p, dtype=np.int32) for p in found.values()]) if found else np.zeros(0, dtype=np.int32))
            yield pa.RecordBatch.from_pydict({
                "gram": pa.array([g for g, _ in found], type=pa.string()), "block": pa.array([b for _, b in found], type=pa.int64()),
                "places": pa.ListArray.from_arrays(pa.array(ends), places)})


def write_index(charts: DataFrame, path: str, columns: Sequence[str] = COLUMNS) -> None:
    """Index `charts` (with chart_id, dataset_id, quality and family) for `search`, `facets` and `selection`; `columns` are searched.

    Every row gets a number, written with it; the other tables are built from what was written. A trigram that occurs in very many
    texts has a list for each block of 65536 rows, range partitions split between them, and no list grows beyond a block.
    """
    spark = charts.sparkSession
    numbered = charts.select(F.struct(*charts.columns).alias("chart"), F.monotonically_increasing_id().alias("id"))
    numbered.withColumn("block", F.shiftright("id", BLOCK_BITS)).write.partitionBy("block").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows").select("id", "chart.*")

    lists = rows.select("id", search_blob(columns).alias("blob")).mapInArrow(_postings, "gram string, block long, places array<int>")
    whole = lists.groupBy("gram", "block").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    whole.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/postings")

    values = F.array(*(F.struct(F.lit(name).alias("facet"), value.alias("value")) for name, value in (
        ("quality", F.col("quality")), ("family", F.col("family")), ("dataset", F.coalesce(F.col("dataset_id").cast("string"), F.lit("?"))))))
    bits = rows.select("id", F.inline(values)).groupBy("facet", "value", F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    bits.repartitionByRange("facet", "value", "bucket").sortWithinPartitions("facet", "value", "bucket").write.partitionBy("facet").parquet(f"{path}/bitmaps")


def candidates(spark: SparkSession, path: str, search: str) -> DataFrame:
    """`(block, id)` of the charts that hold every trigram of the term; of a term of one or two characters, any trigram that begins with it."""
    wanted = search.strip().lower()
    postings = spark.read.parquet(f"{path}/postings")
    grams = sorted({wanted[i : i + 3] for i in range(len(wanted) - 2)})
    # Conditions on the trigram alone reach the scan, which skips row groups by it. Long lists of values do not: their first ones do, and suffice.
    if grams:
        scan = [F.col("gram") == g for g in grams[:8]]
        grams = grams[:8]
    else:
        scan = [F.col("gram").startswith(wanted)]
    held = postings.where(reduce(Column.__or__, scan)).select("gram", "block", F.explode("places").alias("place"))
    each = held.groupBy("block", "place").agg(F.count(F.lit(1)).alias("n"))
    if grams:
        each = each.where(F.col("n") == len(grams))
    return each.select("block", (F.shiftleft("block", BLOCK_BITS) + F.col("place")).alias("id"))


def _found(spark: SparkSession, path: str, search: str, columns: Sequence[str]) -> DataFrame:
    """`id, chart…` of the charts whose columns hold the term; only blocks with candidates are read."""
    rows = spark.read.parquet(f"{path}/rows")
    if search.strip():
        rows = rows.join(candidates(spark, path, search), ["block", "id"], "left_semi")
    return rows.select("id", "chart.*").where(search_term(columns, search))


def search(spark: SparkSession, path: str, term: str, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """The indexed charts whose `columns`, those of the index, hold `term`: the rows that a scan gives."""
    return _found(spark, path, term, columns).drop("id")


def _masks(spark: SparkSession, path: str, chosen: dict[str, str], term: str, columns: Sequence[str]) -> dict[str, DataFrame]:
    """`(bucket, bits)` of every active term, by name."""
    bitmaps = spark.read.parquet(f"{path}/bitmaps")
    out = {name: bitmaps.where((F.col("facet") == name) & (F.col("value") == value)).select("bucket", "bits") for name, value in chosen.items() if value != ALL}
    if term.strip():
        out["search"] = _found(spark, path, term, columns).groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    return out


def _counts(bitmaps: DataFrame, masks: Sequence[DataFrame]) -> DataFrame:
    """`(value, charts)`: bits of each value's bitmaps that all masks have too. Buckets meet one by one; only counts leave them."""
    now = bitmaps.select("value", "bucket", "bits")
    for mask in masks:
        both = now.join(mask.select("bucket", F.col("bits").alias("mask")), "bucket")
        now = both.select("value", "bucket", F.explode(F.array("bits", "mask")).alias("bits")).groupBy("value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return now.groupBy("value").agg(F.sum(F.bitmap_count("bits")).alias("charts")).where(F.col("charts") > 0)


def facets(spark: SparkSession, path: str, family: str = ALL, dataset: str = ALL, quality: str = "good", term: str = "",
           columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Counts per facet value, `facet, value, charts`, each under the terms of the other facets: what `gallery.facets` counts, from the bitmaps."""
    bitmaps = spark.read.parquet(f"{path}/bitmaps")
    on = _masks(spark, path, {"family": family, "dataset": dataset, "quality": quality}, term, columns)
    of = lambda name, *under: _counts(bitmaps.where(F.col("facet") == name), [on[u] for u in (*under, "search") if u in on])

    by_quality = of("quality", "family", "dataset")
    by_family = of("family", "dataset", "quality")
    stays = F.lit(True)
    if "family" in on:
        # A family without charts under the other terms doesn't restrict the datasets.
        stays = by_family.where(F.col("value") == family).agg(F.count(F.lit(1)).alias("n")).scalar() > 0
    narrow, wide = of("dataset", "quality", "family"), of("dataset", "quality")
    by_dataset = narrow.where(stays) if "family" not in on else narrow.where(stays).unionByName(wide.where(~stays))
    parts = [("quality", by_quality), ("quality", by_quality.agg(F.lit("all").alias("value"), F.coalesce(F.sum("charts"), F.lit(0)).alias("charts"))),
             ("family", by_family), ("dataset", by_dataset)]
    counted = reduce(DataFrame.unionByName, (p.select(F.lit(f).alias("facet"), "value", "charts") for f, p in parts))
    always = [F.struct(F.lit("quality").alias("facet"), F.lit(q).alias("value"), F.lit(0).cast("bigint").alias("charts")) for q in ("good", "bad", "all")]
    zeros = spark.range(1).select(F.inline(F.array(*always)))
    return counted.unionByName(zeros).groupBy("facet", "value").agg(F.sum("charts").alias("charts"))


def selection(spark: SparkSession, path: str, family: str = ALL, dataset: str = ALL, quality: str = "good", term: str = "",
              columns: Sequence[str] = COLUMNS) -> DataFrame:
    """One row `family, dataset`: the choices that still have charts, "(all)" for those that have none; as `gallery.effective_selection`."""
    bitmaps = spark.read.parquet(f"{path}/bitmaps").where(F.col("facet") == "quality")
    on = _masks(spark, path, {"family": family, "dataset": dataset, "quality": quality}, term, columns)

    def some(*under: str) -> DataFrame:
        return _counts(bitmaps, [on[u] for u in (*under, "search") if u in on]).agg((F.coalesce(F.sum("charts"), F.lit(0)) > 0).alias("some"))

    both, loose = some("family", "dataset", "quality").select(F.col("some").alias("both")), some("dataset", "quality").select(F.col("some").alias("loose"))
    return both.join(loose, F.lit(True)).select(
        F.when(F.col("both"), F.lit(family)).otherwise(F.lit(ALL)).alias("family"),
        F.when(F.col("both") | F.col("loose"), F.lit(dataset)).otherwise(F.lit(ALL)).alias("dataset"))

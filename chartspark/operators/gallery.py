"""Browse a chart collection: filter, facet, sort, page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.functions.text import label_sentence
from chartspark.operators.ordering import positions_by_value

# The term that switches a filter off, and the page size.
ALL = "(all)"
PAGE_SIZE = 24


def search_blob(columns: Sequence[str]) -> Column:
    """Lower-cased columns joined by spaces; a missing one counts as empty text."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def search_term(columns: Sequence[str], search: str) -> Column:
    wanted = search.strip().lower()
    return F.contains(search_blob(columns), F.lit(wanted)) if wanted else F.lit(True)


def terms(family: str = ALL, dataset: str = ALL, quality: str = ALL) -> dict[str, Column]:
    """One condition per active term, over columns dataset_id, quality and family.

    The plain column comes first: it is compared in the scan, the derived ones afterwards.
    A missing dataset id is shown, and chosen, as "?".
    """
    stored = F.col("dataset_id").cast("string")
    given = {
        "dataset_id": (dataset, (stored == dataset) | stored.isNull() if dataset == "?" else stored == dataset),
        "quality": (quality, F.col("quality") == quality),
        "family": (family, F.col("family") == family),
    }
    return {name: test for name, (value, test) in given.items() if value != ALL}


def all_of(tests: Sequence[Column]) -> Column:
    condition = F.lit(True)
    for test in tests:
        condition = condition & test
    return condition


def filter_charts(
    df: DataFrame, family: str = ALL, dataset: str = ALL, quality: str = ALL, search: str = "",
    search_columns: Sequence[str] = ("chart_id", "dataset_id", "description", "short_description", "raw_type", "family"),
) -> DataFrame:
    """Charts that meet every active term; one predicate, so plain columns reach the scan."""
    return df.where(all_of([*terms(family, dataset, quality).values(), search_term(search_columns, search)]))


def subset(df: DataFrame, ids: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Rows whose key is listed; the same list cuts charts, datasets and results alike."""
    listed = ids.select(F.col(ids.columns[0]).cast("string").alias("_id")).distinct()
    return df.join(listed, df[key].cast("string") == listed["_id"], "left_semi")


def family_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("family").agg(F.count(F.lit(1)).alias("charts")).orderBy(F.desc("charts"), "family")


def dataset_counts(df: DataFrame, order: str = "chart_id") -> DataFrame:
    """Charts per dataset, labelled from the description seen first."""
    counted = df.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("charts"), F.min_by("description", order).alias("_description")
    )
    labelled = counted.select("dataset_id", "charts", label_sentence(F.col("_description")).alias("label"))
    return labelled.orderBy(F.desc("charts"), "dataset_id")


def quality_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("quality") == "good").alias("good"), F.count_if(F.col("quality") == "bad").alias("bad"))


def facets(df: DataFrame, family: str = ALL, dataset: str = ALL, quality: str = "good", search: str = "",
           search_columns: Sequence[str] = ("chart_id", "dataset_id", "description", "raw_type", "family")) -> DataFrame:
    """Counts per facet value, each facet under the terms of the other facets.

    A chosen family without charts under the other terms falls back to "(all)" before the
    datasets are counted. One pass: every chart names the facet values that it counts for,
    and these are combined inside its task; only the fallback needs a second look, which ends
    at the first hit.
    """
    on = terms(family, dataset, quality)
    found = df.where(search_term(search_columns, search))

    def under(*names: str) -> Column:
        return all_of([on[name] for name in names if name in on])

    family_stays = on.get("family", F.lit(True))
    if "family" in on:
        first = found.where(under("dataset_id", "quality", "family")).limit(1)
        family_stays = family_stays | (first.agg(F.count(F.lit(1)).alias("rows")).scalar() == 0)

    def entry(condition: Column, name: str, value: Column) -> Column:
        return F.when(condition, F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value"), F.lit(1).alias("n")))

    entries = F.array(
        entry(under("family", "dataset_id"), "quality", F.col("quality")),
        entry(under("family", "dataset_id"), "quality", F.lit("all")),
        entry(under("dataset_id", "quality"), "family", F.col("family")),
        entry(under("quality") & family_stays, "dataset", F.coalesce(F.col("dataset_id").cast("string"), F.lit("?"))),
    )
    counted = found.select(F.inline(F.array_compact(entries))).groupBy("facet", "value").agg(F.sum("n").alias("charts"))
    always = [F.struct(F.lit("quality").alias("facet"), F.lit(q).alias("value"), F.lit(0).cast("bigint").alias("charts")) for q in ("good", "bad", "all")]
    zeros = df.sparkSession.range(1).select(F.inline(F.array(*always)))
    return counted.unionByName(zeros).groupBy("facet", "value").agg(F.sum("charts").alias("charts"))


def effective_selection(df: DataFrame, family: str = ALL, dataset: str = ALL, quality: str = "good", search: str = "",
                        search_columns: Sequence[str] = ("chart_id", "dataset_id", "description", "raw_type", "family")) -> DataFrame:
    """One row `family, dataset`: the choices that still have charts, "(all)" for those that have none.

    The family is looked up under the other terms first, then the dataset under the family that
    remains. Two flags of one pass decide both.
    """
    on = terms(family, dataset, quality)
    found = df.where(search_term(search_columns, search))
    loose = all_of([on[name] for name in ("dataset_id", "quality") if name in on])
    both = all_of(list(on.values()))
    flags = found.agg(F.coalesce(F.bool_or(both), F.lit(False)).alias("both"), F.coalesce(F.bool_or(loose), F.lit(False)).alias("loose"))
    return flags.select(
        F.when(F.col("both"), F.lit(family)).otherwise(F.lit(ALL)).alias("family"),
        F.when(F.col("both") | F.col("loose"), F.lit(dataset)).otherwise(F.lit(ALL)).alias("dataset"))


def with_labels(facet: DataFrame, labels: DataFrame) -> DataFrame:
    """Facet values with their label; a value without one shows itself."""
    named = labels.select(F.col("dataset_id").cast("string").alias("_id"), F.col("label").alias("_label"))
    joined = facet.join(named, facet["value"] == named["_id"], "left")
    return joined.select(*facet.columns, F.coalesce("_label", "value").alias("label"))


def sorted_places(df: DataFrame, ascending: bool, row: str = "chart_id", block: int | None = None) -> DataFrame:
    """Place of each chart by number of wrong answers, input order kept on ties both ways."""
    return positions_by_value(df, "incorrect", row, ascending, "place", block)


def with_pages(placed: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return placed.withColumn("page", F.floor(F.col("place") / size))


def page(placed: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of a placed collection; a number beyond the last page shows the last page."""
    last = placed.agg(F.floor(F.coalesce(F.max("place"), F.lit(0)) / size)).scalar()
    return with_pages(placed, size).where(F.col("page") == F.least(F.lit(max(number, 0)).cast("bigint"), last))


def head_json(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in input order as JSON texts, ready for a prompt."""
    return df.orderBy(*order).limit(n).select(*order, F.to_json(F.struct(*df.columns)).alias("record"))

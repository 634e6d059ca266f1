"""Expressions on the image list of a chart record: array<struct(path, feedback, code)>.

An element without a path stands for an entry that was not an image object; it keeps its place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartspark.functions.text import strip

MAX_ROUNDS = 3


def typed_images(images: Column) -> Column:
    """array<variant> to array<struct(path, feedback, code)>; a feedback list becomes one text."""

    def one(x: Column) -> Column:
        path = F.when(F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$.path", "string"))
        listed = F.try_variant_get(x, "$.feedback", "array<string>")
        single = F.try_variant_get(x, "$.feedback", "string")
        return F.struct(
            path.alias("path"),
            F.when(listed.isNotNull(), feedback_list(listed)).otherwise(single).alias("feedback"),
            F.try_variant_get(x, "$.code", "string").alias("code"),
        )

    return F.transform(images, one)


def feedback_list(items: Column) -> Column:
    """Stripped, non-empty items joined by a space."""
    return F.array_join(F.filter(F.transform(items, strip), lambda x: x != ""), " ")


def feedback_bullets(items: Column) -> Column:
    """One "- item" line per stripped, non-empty item."""
    kept = F.filter(F.transform(items, strip), lambda x: x != "")
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), x)), "\n")


def valid_images(images: Column) -> Column:
    return F.filter(images, lambda x: x["path"].isNotNull())


def first_image(images: Column) -> Column:
    return F.try_element_at(images, F.lit(1))


def last_image(images: Column) -> Column:
    return F.try_element_at(images, F.lit(-1))


def iteration(path: Column) -> Column:
    """Number after the last `_it` of the file stem; 0 when there is none."""
    digits = F.regexp_extract(path, r"_it(\d+)(?:\.[^./]*)?$", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def final_image(images: Column) -> Column:
    """The valid image of the largest iteration; the first one on a tie."""
    valid = valid_images(images)
    best = F.array_max(F.transform(valid, lambda x, i: F.struct(iteration(x["path"]).alias("n"), (-i).alias("i"))))
    return F.get(valid, -best["i"])


def quality(images: Column, max_rounds: int = MAX_ROUNDS) -> Column:
    """Bad when the final image took `max_rounds` and still has feedback, else good."""
    last = final_image(images)
    open_feedback = strip(F.coalesce(last["feedback"], F.lit(""))) != ""
    late = iteration(last["path"]) >= max_rounds
    return F.when(F.coalesce(late & open_feedback, F.lit(False)), "bad").otherwise("good")


def bundle_path(path: Column) -> Column:
    """`images/<file name>`, the place of an image inside its chart folder."""
    name = F.substring_index(F.rtrim(F.coalesce(path, F.lit("")), F.lit("/")), "/", -1)
    return F.concat(F.lit("images/"), name)


def without_prefix(images: Column, prefix: str) -> Column:
    """Cut `prefix` from every path that starts with it."""

    def one(x: Column) -> Column:
        path = F.when(x["path"].startswith(prefix), F.substring(x["path"], len(prefix) + 1, 2**31 - 1))
        return x.withField("path", path.otherwise(x["path"]))

    return F.transform(images, one)


def mapped_paths(images: Column, paths: Column) -> Column:
    """Valid images with their path looked up in `paths`, else moved to `bundle_path`; order is kept."""

    def one(x: Column) -> Column:
        found = F.try_element_at(F.coalesce(paths, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), x["path"])
        return x.withField("path", F.coalesce(found, bundle_path(x["path"])))

    return F.transform(valid_images(images), one)


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def with_changed_path(image: Column, change: Callable[[Column], Column]) -> Column:
    """A stored image (variant) with its text path changed; other keys, and all that is no such object, stay as they are."""
    path = F.try_variant_get(image, "$.path", "variant")
    changed = F.transform_values(
        image.cast("map<string,variant>"),
        lambda key, value: F.when(key == "path", change(F.try_variant_get(value, "$", "string")).cast("variant")).otherwise(value))
    return F.when(is_object(image) & (F.schema_of_variant(path) == "STRING"), F.to_variant_object(changed)).otherwise(image)


def stored_without_prefix(record: Column, prefix: str) -> Column:
    """Cut `prefix` from the image paths of a whole record (map<string,variant>); everything else is kept as stored."""

    def cut(path: Column) -> Column:
        return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 2**31 - 1)).otherwise(path)

    def one(key: Column, value: Column) -> Column:
        listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: with_changed_path(x, cut)).cast("variant")
        return F.when((key == "images") & F.schema_of_variant(value).startswith("ARRAY"), listed).otherwise(value)

    return F.transform_values(record, one)


def stored_mapped_paths(record: Column, paths: Column) -> Column:
    """A whole record (map<string,variant>) with every image path looked up in `paths`, else moved to `bundle_path`.

    Image entries that are no objects go; objects without a text path stay. A record without an image list gets an empty one.
    """
    known = F.coalesce(paths, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))

    def moved(path: Column) -> Column:
        return F.coalesce(F.try_element_at(known, path), bundle_path(path))

    listed = F.try_variant_get(F.try_element_at(record, F.lit("images")), "$", "array<variant>")
    objects = F.filter(F.coalesce(listed, F.array().cast("array<variant>")), is_object)
    changed = F.transform(objects, lambda x: with_changed_path(x, moved)).cast("variant")
    return F.map_concat(F.map_filter(record, lambda key, _: key != "images"), F.create_map(F.lit("images"), changed))


def chosen_code(images: Column, graph_code: Column, source: str = "image") -> Column:
    """Code of the last image, else of the chart; `source="graph"` asks for the latter."""
    if source == "graph":
        return graph_code
    return F.when(F.size(images) > 0, last_image(images)["code"]).otherwise(graph_code)


def labelled_questions(questions: Column, labels: Column) -> Column:
    """Questions with their type set by position; null types when the lists differ in length."""
    fits = F.coalesce(F.size(questions) == F.size(labels), F.lit(False))
    return F.transform(
        questions, lambda q, i: q.withField("type", F.when(fits, F.get(labels, i)))
    )

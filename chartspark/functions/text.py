"""Text expressions: Column in, Column out, all built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning when column names are matched.
STOP_WORDS = (
    "a", "an", "and", "attribute", "attributes", "by", "class", "data", "dataset", "feature", "features",
    "for", "from", "in", "is", "nominal", "numeric", "of", "on", "or", "target", "the", "to", "used",
    "value", "values", "variable", "variables",
)

# Image extensions served under their own MIME type.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp")

# Fixed value: label of a dataset without description.
NO_DESCRIPTION = "(no description)"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once, however often `body` reads it.

    The value becomes the element of a one-item array, so the optimizer cannot copy its
    expression into every place of use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove leading and trailing blanks of every kind, not only spaces."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def type_text(raw: Column) -> Column:
    """Chart-type spelling reduced to lower-case words and `/`, one space apart."""
    return F.trim(F.regexp_replace(F.lower(raw), "[^a-z0-9/]+", " "))


def identifier_text(name: Column) -> Column:
    """Column name as lower-case words: camelCase split, possessive dropped."""
    words = F.regexp_replace(F.translate(name, "_", " "), "([a-z])([A-Z])", "$1 $2")
    plain = F.replace(F.lower(words), F.lit("'s"), F.lit(""))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def meaningful_tokens(name: Column) -> Column:
    """Words of a name without the stop words, in order, with repeats."""
    return F.filter(F.split(identifier_text(name), " "), lambda w: ~w.isin("", *STOP_WORDS))


def word_tokens(words: Column) -> Column:
    """Distinct meaningful words of a text that `identifier_text` made."""
    return F.array_except(F.split(words, " "), F.array(*[F.lit(w) for w in ("", *STOP_WORDS)]))


def label_120(description: Column) -> Column:
    """Text before the first ". ", at most 120 characters."""
    first = strip(F.substring_index(strip(F.coalesce(description, F.lit(""))), ". ", 1))
    return F.when(first == "", NO_DESCRIPTION).otherwise(F.left(first, F.lit(120)))


def _short(text: Column, mark: str) -> Column:
    cut = F.concat(F.left(text, F.lit(67)), F.lit(mark))
    return F.when(text == "", NO_DESCRIPTION).when(F.length(text) > 70, cut).otherwise(text)


def label_short(description: Column) -> Column:
    """Text before the first ". " on one line, cut to 67 characters and three dots."""
    first = strip(F.substring_index(strip(F.coalesce(description, F.lit(""))), ". ", 1))
    return _short(F.translate(first, "\n", " "), "...")


def label_sentence(description: Column) -> Column:
    """Text before the first "." on one line, cut to 67 characters and an ellipsis."""
    first = strip(F.substring_index(strip(F.coalesce(description, F.lit(""))), ".", 1))
    return _short(F.translate(first, "\n", " "), "…")


def join_url(base: Column, relative: Column) -> Column:
    joined = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(relative, F.lit("/")))
    return F.when(F.coalesce(base, F.lit("")) != "", joined)


def split_reasoning(text: Column) -> Column:
    """struct(thought, answer): cut at the first closing tag, both parts stripped."""
    parts = F.split(text, "</think>", 2)
    closed = F.contains(text, F.lit("</think>"))
    thought = strip(F.replace(parts[0], F.lit("<think>"), F.lit("")))
    return F.struct(
        F.when(closed, thought).alias("thought"), F.when(closed, strip(parts[1])).otherwise(text).alias("answer")
    )


def after_reasoning(text: Column) -> Column:
    """struct(thought, answer, failed): cut only when the opening tag is present, nothing stripped.

    An opening tag without a closing one has no answer and is marked as failed.
    """
    parts = F.split(text, "</think>", 2)
    opened, closed = F.contains(text, F.lit("<think>")), F.contains(text, F.lit("</think>"))
    return F.struct(
        F.when(opened & closed, parts[0]).alias("thought"),
        F.when(~opened, text).when(closed, F.get(parts, F.lit(1))).alias("answer"),
        (opened & ~closed).alias("failed"),
    )


def strip_fences(text: Column) -> Column:
    """Drop one leading and one trailing code fence."""
    head = F.regexp_replace(strip(text), r"(?U)^```(?:json|python)?\s*", "")
    return strip(F.regexp_replace(head, r"(?U)\s*```$", ""))


def drop_json_fences(text: Column) -> Column:
    """Delete every json fence mark, wherever it stands."""
    return F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))


def array_slice(text: Column) -> Column:
    """From the first `[` to the last `]`; empty when there is none."""
    return F.regexp_extract(text, r"(?s)(\[.*\])", 1)


def verdict(text: Column) -> Column:
    """true or false for exactly that word in any case, else null."""
    word = F.lower(strip(text))
    return F.when(word == "true", True).when(word == "false", False)


def text_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def image_tokens(width: Column, height: Column) -> Column:
    return F.lit(167.0) + F.lit(0.000972) * width * height


def mime_type(path: Column) -> Column:
    extension = F.lower(F.substring_index(path, ".", -1))
    return F.when(extension.isin(*IMAGE_EXTENSIONS), F.concat(F.lit("image/"), extension)).otherwise("image/jpeg")


def prompt_key(dataset_id: Column, image: Column) -> Column:
    return F.concat(dataset_id.cast("string"), image)


def description_aliases(description: Column, target: Column | None = None) -> Column:
    """array<struct(raw, alias)>: each `word (long name)`, then what the target represents.

    The text is searched once; name and alias are cut from the short hits. Possessive
    repeats keep the search linear.
    """
    found = F.regexp_extract_all(description, F.lit(r"(?U)\b[A-Za-z][A-Za-z0-9_]*+\s*+\([^()]++\)"), 0)
    named = F.transform(found, lambda hit: F.struct(
        F.regexp_extract(hit, "^[A-Za-z0-9_]+", 0).alias("raw"), F.regexp_extract(hit, r"(?s)\((.*)\)$", 1).alias("alias")))
    if target is None:
        return named
    shown = F.regexp_extract_all(description, F.lit(r"(?i)target attribute[^.]*?representing[\s\p{Z}]+([^.,;]+)"), 1)
    meant = F.transform(shown, lambda x: F.struct(target.alias("raw"), x.alias("alias")))
    return F.concat(named, F.when(target.isNull() | (target == ""), F.slice(meant, 1, 0)).otherwise(meant))


def needed_columns(expected: Column, code: Column) -> Column:
    """Expected features, then columns that the code reads from `df`, each once, in that order."""
    # Double and single quotes both open a name; the name ends at the first quote of either kind.
    read = F.regexp_extract_all(code, F.lit(r"""(?U)df\s*\[\s*['"]([^'"]+)['"]\s*\]"""), 1)
    given = F.coalesce(F.filter(expected, lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(given, F.coalesce(read, F.array().cast("array<string>"))))


def replace_names(text: Column, old: Column, new: Column) -> Column:
    """Replace each old name by its new one, one after the other, also inside words.

    When the two lists differ in length the old names stay.
    """
    pairs = F.arrays_zip(old.alias("o"), new.alias("n"))
    replaced = F.aggregate(pairs, text, lambda acc, x: F.replace(acc, x["o"], x["n"]))
    return F.when(F.size(old) == F.size(new), replaced).otherwise(text)


def override_pair(item: Column) -> Column:
    """struct(raw, renamed, ok) of a `RAW=RENAMED` text, cut at the first `=`."""
    parts = F.split(item, "=", 2)
    raw, renamed = strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1)))
    ok = F.contains(item, F.lit("=")) & (raw != "") & (renamed != "")
    return F.struct(
        F.when(ok, raw).alias("raw"), F.when(ok, renamed).alias("renamed"), F.coalesce(ok, F.lit(False)).alias("ok")
    )


def accuracy_hue(fraction: Column) -> Column:
    """Colour angle from red (0) to green (120)."""
    return (fraction * 120).cast("int")


def answer_mark(correct: Column) -> Column:
    return F.when(F.coalesce(correct, F.lit(False)), "✓").otherwise("✗")


def short_id(identifier: Column) -> Column:
    return F.left(identifier, F.lit(8))

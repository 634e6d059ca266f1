"""Checks of model output against its contract: one row (key, rule, ok, detail) per rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.operators.evaluation import QUESTION_TYPES
from chartspark.schemas import STRUCTURED_KEYS

# Contract of the generation stages.
N_SPECS = 10
N_QUESTIONS = 20
SPEC_KEYS = ("type", "features", "description")
QUESTION_KEYS = ("question", "answer", "answer_basis")
ANSWER_BASES = ("image", "both")
REVIEW_KEYS = ("feedback", "correction")
VERDICT_KEYS = ("useful", "description")
MAX_GRID = 5
MAX_WORDS = 2500
LABEL_TRIES = 30
DEFAULT_STYLE = "default"
DESCRIPTION_HEADERS = (
    "1) Chart type, purpose and semantic meaning",
    "2) What is plotted (variables and encodings)",
    "3) Data shown (from graph_df)",
    "4) Patterns and relationships visible",
    "5) Image/visual properties (from the image)",
    "6) Caveats and unknowns",
)


def checks(df: DataFrame, key: str, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Evaluate every rule on every row in one projection; a null outcome is a failure."""
    rows = [
        F.struct(F.lit(name).alias("rule"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.cast("string").alias("detail"))
        for name, (ok, detail) in rules.items()
    ]
    return df.select(F.col(key).alias("key"), F.inline(F.array(*rows)))


def has_exactly(json: Column, keys: Sequence[str]) -> Column:
    wanted = F.array(*[F.lit(k) for k in sorted(keys)])
    return F.array_sort(F.json_object_keys(json)) == wanted


def kind(json: Column, key: str) -> Column:
    """Type name of a member: STRING, BOOLEAN, BIGINT, ARRAY<…>; null when the text is no JSON."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant"))


def items(json: Column) -> Column:
    """Elements of a JSON array as JSON texts; null when the text is no array."""
    return F.from_json(json, "array<string>")


def member(json: Column, key: str) -> Column:
    return F.get_json_object(json, f"$.{key}")


def verdict_checks(df: DataFrame, key: str, reply: str) -> DataFrame:
    text = F.col(reply)
    return checks(df, key, {
        "keys": (has_exactly(text, VERDICT_KEYS), F.array_join(F.json_object_keys(text), ",")),
        "useful is boolean": (kind(text, "useful") == "BOOLEAN", kind(text, "useful")),
        "description is string": (kind(text, "description") == "STRING", kind(text, "description")),
    })


def spec_checks(df: DataFrame, key: str, reply: str, features: str) -> DataFrame:
    specs = items(F.col(reply))
    types = F.transform(specs, lambda s: member(s, "type"))
    named = F.array_distinct(F.flatten(F.transform(specs, lambda s: F.coalesce(items(member(s, "features")), F.array().cast("array<string>")))))
    unknown = F.array_except(named, F.col(features))
    return checks(df, key, {
        "ten specs": (F.size(specs) == N_SPECS, F.size(specs)),
        "keys": (F.forall(specs, lambda s: has_exactly(s, SPEC_KEYS)), F.lit(None)),
        "types differ": (F.size(F.array_distinct(types)) == F.size(specs), F.size(F.array_distinct(types))),
        "features exist": (F.size(unknown) == 0, F.array_join(unknown, ",")),
    })


def rename_checks(df: DataFrame, key: str, names: str, features: str) -> DataFrame:
    new, old = F.col(names), F.col(features)
    same = F.size(F.filter(F.arrays_zip(old.alias("o"), new.alias("n")), lambda x: x["o"].eqNullSafe(x["n"])))
    # A name may stay as it is, but an old name at another place means that the order changed.
    moved = F.transform(new, lambda n, i: F.coalesce(F.array_contains(old, n) & ~F.get(old, i).eqNullSafe(n), F.lit(False)))
    return checks(df, key, {
        "same length": (F.size(new) == F.size(old), F.concat_ws("/", F.size(new).cast("string"), F.size(old).cast("string"))),
        "no empty name": (F.forall(new, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), F.lit(None)),
        "names differ": (F.size(F.array_distinct(new)) == F.size(new), F.size(F.array_distinct(new))),
        "kept in place": (F.size(F.filter(moved, lambda x: x)) == 0, same),
    })


def graph_data_checks(df: DataFrame, key: str, data: str, plot_type: str, features: str, n_rows: str) -> DataFrame:
    """`n_rows` is the row count of the plotted table, counted or joined by the caller."""
    text = F.col(data)
    expected = items(member(text, "features_expected"))
    plotted = member(text, "n_rows_plotted").try_cast("bigint")
    return checks(df, key, {
        "keys": (has_exactly(text, STRUCTURED_KEYS), F.size(F.json_object_keys(text))),
        "plot type": (member(text, "plot_type") == F.col(plot_type), member(text, "plot_type")),
        "features unchanged": (expected == F.col(features), F.array_join(expected, ",")),
        "rows plotted": (plotted == F.col(n_rows), plotted),
    })


def review_checks(df: DataFrame, key: str, reply: str) -> DataFrame:
    text = F.col(reply)
    return checks(df, key, {
        "keys": (has_exactly(text, REVIEW_KEYS), F.array_join(F.json_object_keys(text), ",")),
        "feedback is string": (kind(text, "feedback") == "STRING", kind(text, "feedback")),
        "correction is boolean": (kind(text, "correction") == "BOOLEAN", kind(text, "correction")),
    })


def question_checks(df: DataFrame, key: str, reply: str) -> DataFrame:
    listed = items(F.col(reply))
    texts = F.transform(listed, lambda q: member(q, "question"))
    return checks(df, key, {
        "twenty questions": (F.size(listed) == N_QUESTIONS, F.size(listed)),
        "keys": (F.forall(listed, lambda q: has_exactly(q, QUESTION_KEYS)), F.lit(None)),
        "basis": (F.forall(listed, lambda q: member(q, "answer_basis").isin(*ANSWER_BASES)), F.lit(None)),
        "no repeats": (F.size(F.array_distinct(texts)) == F.size(texts), F.size(F.array_distinct(texts))),
    })


def label_checks(df: DataFrame, key: str, labels: str, n_questions: str) -> DataFrame:
    given = F.col(labels)
    return checks(df, key, {
        "one label per question": (F.size(given) == F.col(n_questions), F.size(given)),
        "known labels": (F.forall(given, lambda x: x.isin(*QUESTION_TYPES)), F.array_join(F.array_distinct(given), ",")),
    })


def style_or_default(style: Column, known: Sequence[str]) -> Column:
    return F.when(style.isin(*known), style).otherwise(DEFAULT_STYLE)


def grid_checks(df: DataFrame, key: str, rows: str, columns: str) -> DataFrame:
    return checks(df, key, {
        "panels per row": (F.col(columns) <= MAX_GRID, F.col(columns)),
        "panels per column": (F.col(rows) <= MAX_GRID, F.col(rows)),
    })


def description_checks(df: DataFrame, key: str, text: str, headers: Sequence[str] = DESCRIPTION_HEADERS) -> DataFrame:
    # Own projections: each is read by several rules and costs a pass over the text.
    placed = df.withColumns({
        "_places": F.array(*[F.instr(F.col(text), h) for h in headers]), "_words": F.regexp_count(F.col(text), F.lit(r"\S+")),
    })
    places, words = F.col("_places"), F.col("_words")
    return checks(placed, key, {
        "headers present": (F.forall(places, lambda p: p > 0), F.size(F.filter(places, lambda p: p > 0))),
        "headers in order": (places == F.sort_array(places), F.lit(None)),
        "length": (words <= MAX_WORDS, words),
    })

"""Find the source column behind each renamed column that a chart needs.

One row per chart carries its column names as arrays, so nothing is joined or shuffled; the
only Python is the sequence ratio, over Arrow batches.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspark.functions.text import bound, description_aliases, identifier_text, word_tokens

# Scores of the matching rules.
SURE = 10.0
LOWEST = 0.40
CONTAINED = 0.85
SAME_DIGITS = 0.2
SAME_TOKENS = 0.1
N_SUGGESTIONS = 5
N_SHOWN = 3


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def sequence_ratios(wanted: pd.Series, candidates: pd.Series) -> pd.Series:
    """Matching-block ratio of every wanted text with every candidate text of the same chart.

    Charts of one source share their column names, so each pair of a batch is compared once.
    """
    matcher = SequenceMatcher(None)
    known: dict[tuple[str, str], float] = {}

    def ratio(target: str, text: str) -> float:
        if (target, text) not in known:
            matcher.set_seqs(target, text)
            known[target, text] = matcher.ratio()
        return known[target, text]

    return pd.Series([
        [[ratio(target, text) if target else 0.0 for text in texts] for target in targets]
        for targets, texts in zip(wanted, candidates)
    ])


# Marked so that the optimizer leaves the call in its own projection: the array functions
# that read the ratios cannot hold a Python function inside.
sequence_ratios = sequence_ratios.asNondeterministic()


def _words(name: Column) -> Column:
    digits = F.regexp_replace(name, "[^0-9]", "")
    return bound(identifier_text(name), lambda text: F.struct(
        name.alias("name"), text.alias("text"), word_tokens(text).alias("tokens"), digits.alias("digits")))


def _score(target: Column, candidate: Column, raw: Column, ratio: Column) -> Column:
    shared = F.size(F.array_intersect(target["tokens"], candidate["tokens"]))
    larger = F.greatest(F.size(target["tokens"]), F.size(candidate["tokens"]))
    overlap = F.when((F.size(target["tokens"]) > 0) & (F.size(candidate["tokens"]) > 0), shared / larger).otherwise(F.lit(0.0))
    inside = F.contains(candidate["text"], target["text"]) | F.contains(target["text"], candidate["text"])
    contained = F.when(inside, F.lit(CONTAINED)).otherwise(F.lit(0.0))
    digits = F.when((raw["digits"] != "") & (raw["digits"] == target["digits"]), F.lit(SAME_DIGITS)).otherwise(F.lit(0.0))
    common = F.size(F.array_intersect(raw["tokens"], target["tokens"]))
    equal = (common > 0) & (common == F.size(raw["tokens"])) & (common == F.size(target["tokens"]))
    tokens = F.when(equal, F.lit(SAME_TOKENS)).otherwise(F.lit(0.0))
    return F.when((target["text"] == "") | (candidate["text"] == ""), F.lit(0.0)).otherwise(
        F.greatest(overlap, ratio, contained) + digits + tokens
    )


def _settled(raw: str, overrides: str | None, name: Column) -> Column:
    """Same name among the raw columns, or an override for it."""
    same = F.array_contains(F.col(raw), name)
    return same if overrides is None else same | F.coalesce(F.map_contains_key(F.col(overrides), name), F.lit(False))


def score_columns(df: DataFrame, needed: str = "needed", raw: str = "raw", description: str = "description",
                  target: str | None = None, overrides: str | None = None) -> DataFrame:
    """Add `_scores`: per needed column the raw columns with their best evidence, best first.

    Candidates of a raw column are its name and its aliases in the description; the first of
    equal scores stays. Columns found by name or by override are not scored.
    """
    aliases = description_aliases(F.col(description), None if target is None else F.col(target))
    wanted = F.transform(F.col(needed), lambda n: _words(n))

    def evidence(known: Column, name: Column, i: Column) -> Column:
        own = F.transform(F.filter(known, lambda a: a["raw"] == name), lambda a: a["alias"])
        texts = F.concat(F.array(name), own)
        return bound(_words(name), lambda words: F.transform(
            texts, lambda t: F.struct(i.alias("place"), words.alias("raw"), _words(t).alias("words"))))

    candidates = bound(aliases, lambda known: F.flatten(F.transform(F.col(raw), lambda name, i: evidence(known, name, i))))
    prepared = df.withColumns({"_wanted": wanted, "_candidates": candidates})
    open_texts = F.transform("_wanted", lambda n: F.when(_settled(raw, overrides, n["name"]), F.lit("")).otherwise(n["text"]))
    rated = prepared.withColumn("_ratios", sequence_ratios(open_texts, F.transform("_candidates", lambda c: c["words"]["text"])))

    def ranked(n: Column, i: Column) -> Column:
        row = F.get(F.col("_ratios"), i)
        scored = F.transform("_candidates", lambda c, j: F.struct(
            c["place"].alias("place"), (-_score(n, c["words"], c["raw"], F.get(row, j))).alias("minus"), j.alias("j"),
            c["raw"]["name"].alias("raw"), c["words"]["name"].alias("evidence"),
        ))
        best = bound(scored, lambda rows: F.transform(F.col(raw), lambda _, k: F.array_min(F.filter(rows, lambda s: s["place"] == k))))
        ordered = F.sort_array(F.transform(best, lambda b: F.struct(
            b["minus"].alias("minus"), b["place"].alias("place"), b["raw"].alias("raw"), b["evidence"].alias("evidence"),
        )))
        shown = F.transform(ordered, lambda b: F.struct(b["raw"].alias("raw"), (-b["minus"]).alias("score"), b["evidence"].alias("evidence")))
        return F.struct(n["name"].alias("needed"), F.when(~_settled(raw, overrides, n["name"]), shown).alias("candidates"))

    return rated.withColumn("_scores", F.transform("_wanted", ranked)).drop("_wanted", "_candidates", "_ratios")


MATCH = "struct<renamed:string,raw:string,score:double,evidence:string>"


def match_columns(df: DataFrame, needed: str = "needed", raw: str = "raw", description: str = "description",
                  target: str | None = None, overrides: str | None = None) -> DataFrame:
    """Add `matches` (array of renamed, raw, score, evidence) and `suggestions`.

    In the order of `needed`: the same name, else an override (a map renamed → raw), else the
    best unused raw column that scores at least 0.40. An override whose raw column is absent
    gives a match without raw column and the evidence "manual, absent".
    """
    scored = score_columns(df, needed, raw, description, target, overrides)
    manual = F.col(overrides) if overrides else F.lit(None).cast("map<string,string>")
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(f"array<{MATCH}>").alias("matches"))

    def match(name: Column, raw_name: Column, score: Column, evidence: Column) -> Column:
        return F.struct(name.alias("renamed"), raw_name.alias("raw"), score.alias("score"), evidence.alias("evidence")).cast(MATCH)

    def step(state: Column, entry: Column) -> Column:
        name = entry["needed"]
        forced = F.try_element_at(manual, name)
        free = F.get(F.filter(entry["candidates"], lambda c: (c["score"] >= LOWEST) & ~F.array_contains(state["used"], c["raw"])), F.lit(0))
        chosen = (
            F.when(F.array_contains(F.col(raw), name), match(name, name, F.lit(SURE), F.lit("exact")))
            .when(forced.isNotNull() & F.array_contains(F.col(raw), forced), match(name, forced, F.lit(SURE), F.lit("manual")))
            .when(forced.isNotNull(), match(name, F.lit(None), F.lit(None), F.lit("manual, absent")))
            .when(free.isNotNull(), match(name, free["raw"], free["score"], free["evidence"]))
        )
        return F.struct(
            F.array_compact(F.array_append(state["used"], chosen["raw"])).alias("used"),
            F.array_compact(F.array_append(state["matches"], chosen)).alias("matches"),
        )

    matches = F.aggregate("_scores", start, step, lambda state: state["matches"])
    open_scores = F.filter("_scores", lambda e: e["candidates"].isNotNull())
    suggestions = F.transform(open_scores, lambda e: F.struct(
        e["needed"].alias("needed"), F.slice(e["candidates"], 1, N_SUGGESTIONS).alias("candidates")))
    return scored.withColumns({"matches": matches, "suggestions": suggestions}).drop("_scores")


def suggestions_long(matched: DataFrame, key: str) -> DataFrame:
    """Best candidates per needed column, one row each."""
    entries = matched.select(key, F.explode("suggestions").alias("_e"))
    ranked = entries.select(key, F.col("_e.needed").alias("needed"), F.posexplode("_e.candidates").alias("place", "_c"))
    return ranked.select(key, "needed", "place", "_c.raw", "_c.score", "_c.evidence")


def unresolved(matched: DataFrame, key: str, needed: str = "needed") -> DataFrame:
    """Needed columns without a source, with the three best candidates."""
    resolved = F.transform(F.filter("matches", lambda m: m["raw"].isNotNull()), lambda m: m["renamed"])
    missing = matched.select(key, "suggestions", F.explode(F.array_except(F.col(needed), resolved)).alias("missing"))
    own = F.get(F.filter("suggestions", lambda e: e["needed"] == F.col("missing")), F.lit(0))["candidates"]
    shown = F.transform(F.slice(own, 1, N_SHOWN), lambda c: F.concat(c["raw"], F.lit("="), F.round(c["score"], 2).cast("string")))
    return missing.select(key, "missing", F.array_join(shown, ", ").alias("candidates"))

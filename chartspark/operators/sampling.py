"""Repeatable draws. Each is a hash of seed and key, so a lost task draws the same again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.operators.ordering import positions

HEX_DIGITS = 15
DRAW_RANGE = 16**HEX_DIGITS
SLICES = 1 << 16


def draw(seed: object, *keys: Column) -> Column:
    """A whole number in [0, 16^15) from seed and keys."""
    text = F.concat_ws("-", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.left(F.md5(text), F.lit(HEX_DIGITS)), 16, 10).cast("bigint")


def uniform(seed: object, *keys: Column) -> Column:
    return draw(seed, *keys) / F.lit(float(DRAW_RANGE))


def shuffled(df: DataFrame, key: str, seed: int | None = 42, out: str = "place") -> DataFrame:
    """Add the place of each row in a seeded order; without seed, the order of the key.

    Draws are spread evenly, so equal slices of their range balance without a look at the data.
    """
    if seed is None:
        return positions(df, [], [key], out)
    drawn = df.withColumn("_draw", draw(seed, F.col(key)))
    return positions(drawn, [], ["_draw", key], out, block=DRAW_RANGE // SLICES).drop("_draw")


def pick_one(df: DataFrame, key: str, seed: int, number: int = 0) -> DataFrame:
    """One row at random; `number` counts repeated picks under the same seed."""
    return df.orderBy(draw(f"{seed}-{number}", F.col(key)), key).limit(1)


def pick_value(seed: int, key: Column, values: Sequence[str]) -> Column:
    """One of `values` at random per key."""
    return F.element_at(F.array(*[F.lit(x) for x in values]), (draw(seed, key) % len(values) + 1).cast("int"))


def creativity(seed: int, key: Column) -> Column:
    """Beta(2, 4) draw: the second smallest of five uniform draws."""
    five = F.array(*[uniform(f"{seed}-{i}", key) for i in range(5)])
    return F.element_at(F.sort_array(five), 2)


def chart_uuid(seed: object, *keys: Column) -> Column:
    """Random-looking id in UUID form, the same again when a task is repeated."""
    text = F.md5(F.concat_ws("-", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    pieces = [F.substring(text, 1, 8), F.substring(text, 9, 4), F.concat(F.lit("4"), F.substring(text, 14, 3)),
              F.concat(F.lit("a"), F.substring(text, 18, 3)), F.substring(text, 21, 12)]
    return F.concat_ws("-", *pieces)


def sized_datasets(catalogue: DataFrame, min_rows: int = 200, max_features: int = 2000) -> DataFrame:
    """Datasets with enough rows and 1 to `max_features` features, fractions cut off; missing is 0, unreadable, NaN and infinite are out."""

    def number(name: str) -> Column:
        value = F.coalesce(F.col(name), F.lit("0")).try_cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)

    rows, features = number("NumberOfInstances"), number("NumberOfFeatures")
    # Comparisons on the double itself: no number is too large for them.
    return catalogue.where(F.col("did").try_cast("bigint").isNotNull() & (rows >= min_rows) & (features >= 1) & (features < max_features + 1))


def random_dataset(catalogue: DataFrame, seed: int, number: int = 0, **limits) -> DataFrame:
    """One dataset at random of those that `sized_datasets` keeps; fails when there is none."""
    picked = pick_one(sized_datasets(catalogue, **limits), "did", seed, number)
    if picked.isEmpty():
        raise LookupError("no dataset passes the size filter")
    return picked


def of_format(catalogue: DataFrame, kind: str = "ARFF") -> DataFrame:
    return catalogue.where(F.upper(F.coalesce("format", F.lit(""))) == kind)


def sorted_catalogue(catalogue: DataFrame) -> DataFrame:
    return catalogue.withColumn("did", F.col("did").cast("int")).orderBy("did")

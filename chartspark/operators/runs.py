"""Rows stored in numbered runs, in buckets by run: what belongs to a row is joined to it without shuffling the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.session import scratch_dir

#: Rows of a run. Values of a run are one map, searched for each of its rows.
RUN = 1 << 8


def numbered(rows: DataFrame, label: str) -> DataFrame:
    """`(doc, run, place)`: `rows` as one column, stored, with run and place of every row."""
    spark, row = rows.sparkSession, F.col("_row")
    doc = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("doc"), F.monotonically_increasing_id().alias("_row"))
    doc = doc.select("doc", F.shiftright(row, RUN.bit_length() - 1).alias("run"), row.bitwiseAND(F.lit(RUN - 1)).cast("int").alias("place"))
    buckets, name = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), f"runs_{uuid.uuid4().hex}"
    writer = doc.write.bucketBy(buckets, "run").option("path", scratch_dir(spark, label)).option("compression", "zstd")
    writer.format("parquet").saveAsTable(name)
    kept = spark.table(name)
    # The frame knows its files by now; the name is of no more use.
    spark.sql(f"DROP TABLE {name}")
    return kept


def row_number() -> Column:
    """The number of a row of `numbered`."""
    return F.col("run") * RUN + F.col("place")


def with_values(rows: DataFrame, values: DataFrame, name: str, how: str = "left") -> DataFrame:
    """Add the other columns of `values(row, …)`, one row for each number, to the rows of `numbered` as the struct `name`: null where there is none.

    Only `values` are shuffled, and gathered by run. With `how` "inner", runs without any value are left out.
    """
    place = F.col("row").bitwiseAND(F.lit(RUN - 1)).cast("int")
    pairs = F.collect_list(F.struct(place.alias("place"), F.struct(*(c for c in values.columns if c != "row")).alias("value")))
    maps = values.groupBy(F.shiftright("row", RUN.bit_length() - 1).alias("run")).agg(F.map_from_entries(pairs).alias("_of"))
    return rows.join(maps.hint("shuffle_hash"), "run", how).withColumn(name, F.try_element_at("_of", "place")).drop("_of")


def flat(rows: DataFrame) -> DataFrame:
    """The columns of the stored rows, then those of the values that were added, and `_row`, the number."""
    added = [f"{c}.*" for c in rows.columns if c not in ("doc", "run", "place")]
    return rows.select("doc.*", *added, row_number().alias("_row"))

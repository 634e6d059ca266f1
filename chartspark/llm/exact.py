"""Exact duplicates by an exchange of fingerprints: runs of rows send sorted, Golomb-coded hashes to owners and get duplicate bitmaps back."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.llm.common import RUN, numbered, row_number, stored, table
from chartspark.llm.registry import query

#: Fingerprints that an owner compares, about.
OWNED = 1 << 20
#: Bits of a fingerprint beyond those that number the rows: one row in 2 ** SPARE is a suspect by chance.
SPARE = 16


def golomb_encoded(values: np.ndarray, low: int, span: int) -> tuple[int, bytes, bytes]:
    """`(k, unary, rest)` for sorted different values in `low … low+span-1`: each gap's quotient by 2**k as so many zeros and a one, and its last k bits.

    A power of two is the Golomb parameter, near the mean gap times ln 2, so the quotients together have few more bits than there are values.
    """
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(low - 1)) - 1
    k = max(0, int(math.log2(max(1.0, span / max(1, len(values)) * math.log(2)))))
    quotients = gaps >> k
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, dtype=bool)
    unary[ends] = True
    rest = (gaps[:, None] >> np.arange(k, dtype=np.int64)) & 1
    return k, np.packbits(unary).tobytes(), np.packbits(rest.astype(bool)).tobytes()


def golomb_decoded(n: int, k: int, unary: bytes, rest: bytes, low: int) -> np.ndarray:
    """The values that `golomb_encoded` took."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, dtype=np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, dtype=np.uint8), count=n * k).reshape(n, k).astype(np.int64)
    return low + np.cumsum((quotients << k) + (bits << np.arange(k, dtype=np.int64)).sum(axis=1) + 1) - 1


def _edges(owners: int, bits: int) -> np.ndarray:
    """First fingerprint of each owner's range, and the end of the last one."""
    return np.array([(i << bits) // owners for i in range(owners + 1)], dtype=np.int64)


def _bitmap(places: np.ndarray) -> np.ndarray:
    flags = np.zeros(RUN, dtype=np.uint8)
    flags[places] = 1
    return np.packbits(flags, bitorder="little").view(np.int64)


def suspect_places(runs: DataFrame, count: int) -> DataFrame:
    """`(run, bits)`: places of each run whose fingerprint another row has too, 64 to a long; runs without any are left out."""
    spark = runs.sparkSession
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // OWNED), 1)
    bits = min(62, max(1, math.ceil(math.log2(count + 1))) + SPARE)
    shift = np.uint64(64 - bits)

    def prints(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted different fingerprints, each row's place among them, how often each occurs, and where owners' ranges begin."""
        own = (rows["h"].to_numpy().view(np.uint64) >> shift).astype(np.int64)
        values, at, times = np.unique(own, return_inverse=True, return_counts=True)
        return values, at, times, np.searchsorted(values, _edges(owners, bits))

    def send(rows: pa.Table) -> pa.Table:
        values, _, _, first = prints(rows)
        edges, out = _edges(owners, bits), {"owner": [], "run": [], "n": [], "k": [], "unary": [], "rest": []}
        for owner in np.flatnonzero(np.diff(first)).tolist():
            a, b, low = int(first[owner]), int(first[owner + 1]), int(edges[owner])
            for name, value in zip(out, (owner, rows["run"][0].as_py(), b - a, *golomb_encoded(values[a:b], low, int(edges[owner + 1]) - low)), strict=True):
                out[name].append(value)
        return pa.table(out, schema=pa.schema([("owner", pa.int32()), ("run", pa.int64()), ("n", pa.int32()), ("k", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary())]))

    def answer(codes: pa.Table) -> pa.Table:
        owner = codes["owner"][0].as_py()
        low = int(_edges(owners, bits)[owner])
        parts = [golomb_decoded(r["n"], r["k"], r["unary"], r["rest"], low) for r in codes.drop_columns(["owner", "run"]).to_pylist()]
        _, at, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        seen = np.split(times[at] > 1, np.cumsum([len(p) for p in parts])[:-1])
        some = [i for i, s in enumerate(seen) if s.any()]
        return pa.table({"run": codes["run"].combine_chunks().take(pa.array(some, type=pa.int64())), "owner": pa.array([owner] * len(some), type=pa.int32()),
                         "marks": pa.array([np.packbits(seen[i]).tobytes() for i in some], type=pa.binary())})

    def receive(rows: pa.Table, marks: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"run": pa.array([], type=pa.int64()), "bits": pa.array([], type=pa.list_(pa.int64()))})
        values, at, times, first = prints(rows)
        doubled = times > 1
        for owner, got in zip(marks["owner"].to_pylist(), marks["marks"].to_pylist(), strict=True):
            a, b = int(first[owner]), int(first[owner + 1])
            doubled[a:b] |= np.unpackbits(np.frombuffer(got, dtype=np.uint8), count=b - a).astype(bool)
        hit = doubled[at]
        some = [_bitmap(rows["place"].to_numpy()[hit])] if hit.any() else []
        return pa.table({"run": pa.array([rows["run"][0].as_py()] * len(some), type=pa.int64()), "bits": pa.array(some, type=pa.list_(pa.int64()))})

    prints_of = runs.select("run", "place", "h")
    codes = prints_of.groupBy("run").applyInArrow(send, "owner int, run long, n int, k int, unary binary, rest binary")
    marks = codes.groupBy("owner").applyInArrow(answer, "run long, owner int, marks binary")
    return prints_of.groupBy("run").cogroup(marks.groupBy("run")).applyInArrow(receive, "run long, bits array<long>")


def _grouped(docs: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, list[str]]:
    """`(rows, groups, keys)`: all rows with `suspect`, and the groups of equal texts among the suspects, to be joined on `keys`."""
    whole = F.coalesce(F.col(f"doc.`{text}`"), F.lit(""))
    runs = numbered(docs, "exact-runs", h=F.xxhash64(whole), digest=digest(whole)).withColumn("t", whole)
    marked = stored(suspect_places(runs, runs.count()), "exact-suspects")
    bit = F.getbit(F.element_at("bits", F.shiftright("place", 6) + 1), F.col("place").bitwiseAND(F.lit(63))) == 1
    rows = runs.join(marked.hint("shuffle_hash"), "run", "left").withColumn("suspect", F.col("bits").isNotNull() & F.coalesce(bit, F.lit(False))).drop("bits")
    number, own = row_number(), F.col(f"doc.`{doc_id}`").cast("long")
    # Grouping by the text itself compares bytes; equal texts of one task are one row before they are shuffled.
    groups = rows.where("suspect").groupBy("digest", "t").agg(
        F.count(F.lit(1)).alias("size"), F.max(own).alias("keep"), F.coalesce(F.max_by(number, own), F.min(number)).alias("keep_row"))
    groups = groups.where(F.col("size") > 1)
    short = stored(groups.select("digest", "size", "keep", "keep_row"), "exact-groups")
    if short.groupBy("digest").count().where(F.col("count") > 1).isEmpty():
        return rows, short, ["digest"]
    # Different texts of one digest: such a table is joined on the texts themselves.
    return rows, stored(groups, "exact-texts"), ["digest", "t"]


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = lambda t: F.sha2(t, 256)) -> DataFrame:
    """`(doc_id, keep_id, group_size, kept, digest)` for every row of `docs`; texts are equal if all bytes are.

    Of equal texts the row with the largest identifier stays. Only texts whose fingerprints occur twice are shuffled,
    and those once a task. `digest` names groups in the last join; where it is no better than a checksum, the texts themselves do.

    Null texts count as empty. Of repeated rows of one identifier one stays, of rows without an identifier one if no
    equal text has one; their `keep_id` is null. Other columns are ignored, an empty table gives an empty result.
    """
    rows, groups, keys = _grouped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", digest)
    own = F.col("doc.doc_id").cast("long").alias("doc_id")
    number = row_number()
    clean = rows.where(~F.col("suspect")).select(own, own.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    found = rows.where("suspect").join(groups, keys, "left").select(
        own, F.when(F.col("size").isNull(), own).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("size").isNull() | (F.col("keep_row") == number)).alias("kept"), "digest")
    return clean.unionByName(found)


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that `exact_duplicates` keeps, with all their columns."""
    rows, groups, keys = _grouped(docs, doc_id, text, lambda t: F.sha2(t, 256))
    number = row_number()
    found = rows.where("suspect").join(groups, keys, "left").where(F.col("size").isNull() | (F.col("keep_row") == number))
    return rows.where(~F.col("suspect")).select("doc.*").unionByName(found.select("doc.*"))


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query("op11_golomb_exchange", OP11_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return exact_duplicates(table(spark, sf, "documents")).withColumnRenamed("digest", "text_sha256")

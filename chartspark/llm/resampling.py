"""Importance resampling towards a target: hashed n-gram counts of both sides weight the documents, which are then drawn."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.llm.common import stored, table, text_bytes
from chartspark.llm.registry import query
from chartspark.operators.ordering import positions

#: Bytes of words as they are in lower case, everything else in ASCII a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
BLOCK = 1 << 18


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The text's words in lists of bounded size, cut between words."""
    flat, at = text.translate(TABLE), 0
    while at < len(flat):
        end = flat.find(b" ", at + BLOCK)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def feature_buckets(text: bytes, grams: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """`(words, buckets of features)` of each block of a text: crc32 of all runs of 1 to `grams` words, joined by blanks.

    The checksum of a run is that of the run without its last word, carried on over a blank and that word.
    """
    tail: list[bytes] = []
    for block in word_blocks(text):
        words = tail + block
        spaced = [b" " + w for w in words[1:]]
        found, sums = [], list(map(zlib.crc32, words))
        for k in range(1, grams + 1):
            if k > 1:
                sums = list(map(zlib.crc32, spaced[k - 2 :], sums))
            # Runs that end in the tail belong to the block before.
            found.append(np.array(sums[max(0, len(tail) - k + 1) :], dtype=np.int64))
        yield len(block), np.concatenate(found) % buckets
        tail = words[-(grams - 1) :] if grams > 1 else []


def bucket_counts(texts: DataFrame, grams: int, buckets: int) -> list[int]:
    """Features in each bucket, over all of `texts(_t)`. A task returns one row a bucket at most, and so does the sum."""

    def each(batches):
        total: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column("_t"):
                for _, found in feature_buckets(text.as_py(), grams, buckets):
                    total.update(found.tolist())
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(total), type=pa.int32()), "n": pa.array(list(total.values()), type=pa.int64())})

    counts = [0] * buckets
    for row in texts.select("_t").mapInArrow(each, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def bucket_gains(source: list[int], target: list[int]) -> np.ndarray:
    """A thousandth of each bucket's log likelihood ratio, rounded down; both sides are smoothed by one feature a bucket."""
    size = len(source)
    all_source, all_target = float(sum(source) + size), float(sum(target) + size)
    return np.array([math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target))) for s, t in zip(source, target, strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the identifier; a null one counts as the empty text."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, target: DataFrame, grams: int = 2, buckets: int = 10_000, seed: int = 7, doc_id: str = "doc_id", text: str = "text",
             target_text: str = "text") -> DataFrame:
    """`(row, doc_id, words, n_features, weight, score)` for every row of `docs`; `row` numbers the rows of this result's plan.

    Words are runs of ASCII letters and digits and of any other characters beyond ASCII, A-Z lower-cased; features are runs of 1 to `grams` words,
    counted in `buckets` by crc32 over all of `docs` and all of `target`. `weight` is the mean gain of a text's
    features, rounded down, and `score` adds Gumbel noise drawn from `seed` and identifier.

    Null and empty texts have no feature and weight 0. Repeated rows count and are scored each. Other columns are ignored. With an
    empty target or an empty table the counts of that side are 0.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("_t"))
    gains = bucket_gains(bucket_counts(rows, grams, buckets), bucket_counts(target.select(text_bytes(target_text).alias("_t")), grams, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def each(batches):
        gains = shared.value
        for batch in batches:
            out = []
            for one, own in zip(batch.column("_t"), batch.column("doc_id").to_pylist(), strict=True):
                words = features = total = 0
                for n, found in feature_buckets(one.as_py(), grams, buckets):
                    words, features, total = words + n, features + len(found), total + int(gains[found].sum())
                weight = total // features if features else 0
                out.append((words, features, weight, weight + noise(own, seed)))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *(pa.array(list(c), type=pa.int64()) for c in columns)],
                names=["row", "doc_id", "words", "n_features", "weight", "score"])

    return rows.mapInArrow(each, "row long, doc_id long, words long, n_features long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, **options) -> DataFrame:
    """`(doc_id, n_features, weight, score, rank)` for every row of `docs`: the drawn ones have a rank, 1 for the highest score.

    Of the texts with at least `least_words` words, `percent` of 100, rounded down, are drawn: those of the highest scores, ties to the smaller
    identifier, null identifiers last, then to the earlier of repeated rows. Ranks are positions over buckets of the score, so no
    task sorts all rows. See `weighted` for the scores and for nulls; an empty table gives an empty result.
    """
    scored = stored(weighted(docs, target, **options), "resampling-scored")
    long = scored.where(F.col("words") >= least_words)
    drawn = long.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    ordered = long.select("row", *columns, (-F.col("score")).alias("_down"), F.col("doc_id").isNull().alias("_last"))
    placed = positions(ordered, [], ["_down", "_last", "doc_id", "row"], "_at")
    ranked = placed.select(*columns, F.when(F.col("_at") < drawn, F.col("_at") + 1).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(F.col("words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


@query("op13_importance_resampling")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return resampled(table(spark, sf, "documents"), table(spark, sf, "benchmark"))

"""Toxicity classifier whose scores are tied between a sentence and its counterparts with other groups named."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspark.llm import textarrays
from chartspark.llm.common import crc_of_id, stored, table, text_bytes
from chartspark.llm.registry import query

#: Terms of one list stand for groups of people and may be swapped for one another.
IDENTITY_TERMS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["she", "he"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"], ["black", "white", "asian", "latino"],
    ["immigrants", "refugees", "locals"], ["mujeres", "hombres"], ["femmes", "hommes"], ["frauen", "männer"],
]
PREFIXES = (4, 5, 6)


class Swapper:
    """A text with every identity term replaced by the next one of its list; None if it names no group."""

    def __init__(self, terms: list[list[str]]):
        self.next = {a: b for group in terms for a, b in zip(group, group[1:] + group[:1], strict=True)}
        self.pattern = regex.compile(r"\b(?:" + "|".join(sorted(map(regex.escape, self.next), key=len, reverse=True)) + r")\b", regex.IGNORECASE) if self.next else None

    def swap(self, text: bytes) -> bytes | None:
        if self.pattern is None:
            return None
        out, n = self.pattern.subn(lambda m: self.next[m[0].lower()], text.decode())
        return out.encode() if n else None


def features(words: textarrays.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, with repeats: each word, and the beginnings of longer words, which stand for stems."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    texts, found = [text], [words.hashes]
    for n in PREFIXES:
        prefix = words.prefixes(n)
        keep = prefix != 0
        texts.append(text[keep])
        found.append(prefix[keep])
    return np.concatenate(texts), np.concatenate(found)


def _present(texts: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place in `chosen`) pairs."""
    text, found = features(textarrays.words_of(texts, textarrays.MARKS))
    if not len(chosen) or not len(found):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(chosen, found), len(chosen) - 1)
    hit = chosen[at] == found
    both = np.unique(text[hit] * len(chosen) + at[hit])
    return both // len(chosen), both % len(chosen)


def _fit(rows: list[tuple[list[int], list[int] | None, int]], size: int, counterfactual: float, sparsity: float, steps: int = 800) -> tuple[np.ndarray, float]:
    """Sparse logistic regression on presence, plus `counterfactual` x the mean squared score change of the swapped texts.

    Accelerated proximal gradient; `sparsity` weighs the sum of absolute weights, so chance
    companions of the telling words get none.
    """
    y = np.array([r[2] for r in rows], dtype=float)
    at = np.concatenate([np.full(len(r[0]), i) for i, r in enumerate(rows)]).astype(int)
    feature = np.concatenate([np.array(r[0], dtype=int) for r in rows])
    swapped = [(i, r) for i, r in enumerate(rows) if r[1] is not None]
    # A pair's score change is linear in the features that only one of its texts has.
    d_at, d_feature, d_sign = [], [], []
    for k, (_, r) in enumerate(swapped):
        for sign, only in ((1.0, set(r[0]) - set(r[1])), (-1.0, set(r[1]) - set(r[0]))):
            d_at += [k] * len(only)
            d_feature += sorted(only)
            d_sign += [sign] * len(only)
    d_at, d_feature, d_sign = np.array(d_at, dtype=int), np.array(d_feature, dtype=int), np.array(d_sign, dtype=float)
    pairs = max(1, len(swapped))

    def slope(w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        error = (1 / (1 + np.exp(-np.clip(np.bincount(at, w[feature], len(rows)) + bias, -40, 40))) - y) / len(rows)
        change = np.bincount(d_at, d_sign * w[d_feature], pairs)
        return np.bincount(feature, error[at], size) + counterfactual * 2 / pairs * np.bincount(d_feature, d_sign * change[d_at], size), float(error.sum())

    # Largest curvature, by power iteration, gives the step of the proximal gradient.
    x, curve = np.ones(size + 1), 1.0
    for _ in range(30):
        row = np.bincount(at, x[feature], len(rows)) + x[-1]
        change = np.bincount(d_at, d_sign * x[d_feature], pairs)
        grown = np.append(np.bincount(feature, row[at], size) / 4 / len(rows) + counterfactual * 2 / pairs * np.bincount(d_feature, d_sign * change[d_at], size), row.sum() / 4 / len(rows))
        curve = float(np.linalg.norm(grown))
        x = grown / max(curve, 1e-12)
    step = 1 / max(1.1 * curve, 1e-6)
    w, bias = np.zeros(size), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    seen_w, seen_bias, pace = w, bias, 1.0
    for _ in range(steps):
        grad, tilt = slope(seen_w, seen_bias)
        moved = seen_w - step * grad
        new_w, new_bias = np.sign(moved) * np.maximum(np.abs(moved) - step * sparsity, 0), seen_bias - step * tilt
        next_pace = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        seen_w, seen_bias = new_w + (pace - 1) / next_pace * (new_w - w), new_bias + (pace - 1) / next_pace * (new_bias - bias)
        w, bias, pace = new_w, new_bias, next_pace
    return w, float(bias)


class Model:
    """Sorted feature hashes, their weights and the bias."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float):
        self.chosen, self.weights, self.bias = chosen, weights, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        text, at = _present(texts, self.chosen)
        logit = np.bincount(text, self.weights[at], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, size: int = 4096, support: int = 2,
          counterfactual: float = 5.0, sparsity: float = 1e-4, terms: list[list[str]] = IDENTITY_TERMS) -> Model:
    """Fit on `docs(doc_id, text)` with `labels(doc_id, toxic)`.

    At most `sample` labelled texts are used, those whose identifiers have the smallest hashes.
    Of their words and word beginnings, the `size` that tell toxic texts best (more than
    `support` of them) become features, so the driver holds a bounded model and sample. Every
    sampled text that names a group is paired with its swapped text, and score differences of such
    pairs are penalised. Unlabelled texts, null labels and identifiers are left out; an identifier
    with several labels is toxic if one says so, and of its rows the smallest text counts. Without a labelled text all scores are 0.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = stored(docs.select("doc_id", text_bytes().alias("_t")).join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(
        F.min("_t").alias("_t"), F.max("toxic").cast("int").alias("toxic")), "toxicity-sample")

    def tally(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
            for first, part in textarrays.chunks(batch.column("_t")):
                text, found = features(textarrays.words_of(part, textarrays.MARKS))
                feature, place = np.unique(found, return_inverse=True)
                pairs = np.unique(place.astype(np.int64) * len(part) + text)
                own = toxic[first : first + len(part)][pairs % len(part)] if len(pairs) else np.zeros(0, dtype=bool)
                n = np.bincount(pairs // len(part), minlength=len(feature))
                t = np.bincount((pairs // len(part))[own], minlength=len(feature)) if len(pairs) else n
                yield pa.RecordBatch.from_pydict({"feature": feature.view(np.int64), "t": t.astype(np.int64), "n": n.astype(np.int64)})

    counts = texts.select("_t", "toxic").mapInArrow(tally, "feature long, t long, n long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    sizes = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0)).alias("t")).first()
    share = (sizes.t + 1) / (sizes.n + 2)
    gain = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
    best = counts.where(F.col("t") > support).orderBy(gain.desc(), "feature").limit(size).collect()
    chosen = np.sort(np.array([r.feature for r in best], dtype=np.int64).view(np.uint64))
    if not sizes.n:
        return Model(chosen[:0], np.zeros(0), -500.0)
    shared = spark.sparkContext.broadcast((chosen, terms))

    def lists(batches):
        chosen, terms = shared.value
        swapper = Swapper(terms)
        for batch in batches:
            for at, own in textarrays.chunks(batch.column("_t")):
                other, held = [swapper.swap(t.as_py()) for t in own], []
                for some in (own, pa.array(other, type=pa.binary())):
                    text, feature = _present(some, chosen)
                    held.append([x.tolist() for x in np.split(feature, np.searchsorted(text, np.arange(1, len(some))))])
                pairs = [x if o is not None else None for x, o in zip(held[1], other, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "own": pa.array(held[0], type=pa.list_(pa.int32())), "swapped": pa.array(pairs, type=pa.list_(pa.int32())),
                    "toxic": batch.column("toxic").slice(at, len(own))})

    fitted = texts.select("doc_id", "_t", "toxic").mapInArrow(lists, "own array<int>, swapped array<int>, toxic int").collect()
    rows = sorted(((r.own, r.swapped, int(r.toxic > 0)) for r in fitted), key=repr)
    return Model(chosen, *_fit(rows, len(chosen), counterfactual, sparsity))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a column `out` from 0 to 1. Whole texts are read; null and empty ones get the score of no word.

    All columns go through the task once; a column of `docs` that is named `out` already is an error.
    """
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"column {out} exists")
    shared, columns, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns, docs.columns.index(text)

    def each(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(place).cast(pa.binary())
            scores = np.concatenate([model.scores(part) for _, part in textarrays.chunks(texts)]) if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, type=pa.float64())], names=[*columns, out])

    return docs.mapInArrow(each, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


@query("op2_counterfactual_toxicity")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = crc_of_id() % 3 == 1
    model = train(docs.where(~held), labels.where(~held))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

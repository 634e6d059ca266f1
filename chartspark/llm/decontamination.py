"""Benchmark passages in documents, found by spaced-seed hashes that tolerate substituted words."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.llm import textarrays
from chartspark.llm.common import fresh, set_small_batches, stored, table, text_bytes
from chartspark.llm.registry import query

#: Positions that count (1) and positions whose word may differ (0). Two substitutions among any 15 words leave one mask intact.
MASKS = ["111111", "11011011", "1110100101", "1010110011", "110010000111"]
FILTER_BITS = 24


def _taken(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def short_masks(n: int, similarity: float) -> list[str]:
    """Masks over a whole item of `n` words: one of them keeps none of the words that differ, whichever those are.

    As many words may differ as `similarity` allows; the item is cut into three blocks more than that, and each mask leaves so many blocks out.
    """
    differ = min(n - 1, int((1 - similarity) * n + 1e-9))
    blocks = np.array_split(np.arange(n), min(n, differ + 3))
    return ["".join("0" if any(k in blocks[b] for b in out) else "1" for k in range(n)) for out in combinations(range(len(blocks)), differ)]


def seed_hashes(words: textarrays.Words, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash of the words that the mask keeps), for every place that lies within one text."""
    n = len(words.hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    total = np.full(n, np.uint64(number + 1))
    for i in _taken(mask):
        total = total * textarrays.FACTOR + words.hashes[i : i + n]
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    inside = np.flatnonzero(text[:n] == text[len(mask) - 1 :])
    return inside, textarrays.mixed(total[inside])


def overlap(own: np.ndarray, other: np.ndarray, shift: int, similarity: float, least: int = 1) -> tuple[int, int, int]:
    """Aligned stretch of at least `least` words, this share of them equal, with the most equal words: `(start in own, end, equal words)`, or zeros.

    Word i of `own` faces word i - shift of `other`. Equal words count 1 - similarity and others
    -similarity, so a stretch is similar enough just if its sum is 0 or more. For every end, the first
    start with such a sum leaves the most equal words. Words at the ends that differ are dropped as far as `least` allows.
    """
    low, high = max(0, shift), min(len(own), len(other) + shift)
    if high - low < least:
        return 0, 0, 0
    same = own[low:high] == other[low - shift : high - shift]
    ends = np.arange(len(same) + 1)
    # The small slope keeps rounding from losing stretches with exactly this share.
    run = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - similarity, -similarity))]) + 1e-9 * ends
    first = np.searchsorted(-np.minimum.accumulate(run), -run, side="left")
    hits = np.concatenate([[0], np.cumsum(same)])
    equal = np.where(ends - first >= least, hits - hits[first], 0)
    end = int(np.argmax(equal))
    if not equal[end]:
        return 0, 0, 0
    start = int(first[end])
    start = max(start, min(start + int(np.argmax(same[start:end])), end - least))
    return low + start, low + end, int(equal[end])


def _bench_words(batches):
    for batch in batches:
        for first, part in textarrays.chunks(batch.column("_t")):
            words = textarrays.words_of(part, textarrays.MARKS)
            held = [words.hashes[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"item_id": batch.column("item_id").slice(first, len(part)), "words": pa.array(held, type=pa.binary())})


def _as_words(data: bytes) -> textarrays.Words:
    hashes = np.frombuffer(data, dtype=np.uint64)
    none = np.zeros(0, dtype=np.int64)
    return textarrays.Words(none, hashes, none, none, np.array([0, len(hashes)]), none)


def _probes(h: np.ndarray) -> list[np.ndarray]:
    """Three places of a hash in the bit set."""
    return [((h >> np.uint64(k)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64) for k in (0, 20, 40)]


def _within(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in `h` whose hashes may be in the bit set, which is read as it is: unpacked it takes eight times as much, in every worker."""
    places = np.arange(len(h))
    for k in (0, 20, 40):
        probe = ((h[places] >> np.uint64(k)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
        places = places[(packed[probe >> 3] >> (7 - (probe & 7)).astype(np.uint8)) & 1 == 1]
    return places


def _filter(index: DataFrame) -> np.ndarray:
    """Packed bit set of all hashes in `index`: 2 MB, however many there are. A handful of tasks fill one each."""

    def fill(batches):
        flags = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            for probe in _probes(batch.column(0).to_numpy().view(np.uint64)):
                flags[probe] = True
        yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(flags).tobytes()], type=pa.binary())})

    packed = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for r in index.select("h").coalesce(8).mapInArrow(fill, "bits binary").collect():
        packed |= np.frombuffer(r.bits, dtype=np.uint8)
    return packed


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: list[str] | None = None, least: int = 13, similarity: float = 0.8) -> DataFrame:
    """`(doc_id, item_id, start, end, equal)` for every text and benchmark item that overlap.

    An overlap is an aligned stretch of at least `least` words (of the whole item, if that
    is shorter), `similarity` of them equal; start and end count the text's words. Words are
    runs of letters and digits, A-Z lower-cased. Candidates share the hash of a mask's words;
    every candidate alignment is verified on all its words. Items of fewer than `least` words have masks
    as long as they are, which miss no similar alignment. A pair has one row, the stretch with the most equal words; of items
    with equal words the smallest identifier stands for all.

    Hashes are joined, not broadcast: a bit set of fixed size keeps unmatched ones out of the
    shuffle. Null and empty texts and items match nothing. Repeated rows give a row each; null
    identifiers are kept. Other columns are ignored. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    masks = MASKS if masks is None else masks
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("_t")).mapInArrow(_bench_words, "item_id long, words binary")
    items = stored(items.groupBy("words").agg(F.min("item_id").alias("item_id")).where(F.length("words") > 0), "bench-items")
    lengths = [r.n for r in items.select((F.length("words") / 8).cast("int").alias("n")).where(F.col("n") < least).distinct().collect()]
    used = list(enumerate(masks)) + [(100 * n + i, mask) for n in sorted(lengths) for i, mask in enumerate(short_masks(n, similarity), 1)]

    def seeds(batches):
        for batch in batches:
            for item, data in zip(batch.column("item_id"), batch.column("words"), strict=True):
                words = _as_words(data.as_py())
                for number, mask in used:
                    if (len(words.hashes) < least) != (number >= 100) or number >= 100 and len(mask) != len(words.hashes):
                        continue
                    place, h = seed_hashes(words, mask, number)
                    yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "item": pa.array([item.as_py()] * len(h), type=pa.int64()), "at": place.astype(np.int32)})

    index = stored(items.mapInArrow(seeds, "h long, item long, at int"), "bench-seeds")
    shared = spark.sparkContext.broadcast(_filter(index))

    def hits(batches):
        for batch in batches:
            for first, part in textarrays.chunks(batch.column("_t")):
                words = textarrays.words_of(part, textarrays.MARKS)
                places, found = [], []
                for number, mask in used:
                    place, h = seed_hashes(words, mask, number)
                    keep = _within(shared.value, h)
                    places.append(place[keep])
                    found.append(h[keep])
                place, h = np.concatenate(places), np.concatenate(found)
                text = np.searchsorted(words.first, place, side="right") - 1
                order = np.argsort(text, kind="stable")
                text, place, h = text[order], place[order] - words.first[text[order]], h[order]
                seen = np.unique(text)
                cut = np.searchsorted(text, seen)[1:]
                tokens = [words.hashes[words.first[t] : words.first[t + 1]].tobytes() for t in seen]
                rows = pa.array(first + seen)
                yield pa.RecordBatch.from_pydict({
                    "row": batch.column("row").take(rows), "doc_id": batch.column("doc_id").take(rows), "words": pa.array(tokens, type=pa.binary()),
                    "h": pa.array(np.split(h.view(np.int64), cut) if len(seen) else [], type=pa.list_(pa.int64())),
                    "at": pa.array(np.split(place.astype(np.int32), cut) if len(seen) else [], type=pa.list_(pa.int32()))})
        # Workers are used again; what their buffers took goes back to the system.
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("_t"))
    marked_docs = stored(rows.mapInArrow(hits, "row long, doc_id long, words binary, h array<long>, at array<int>"), "bench-hits")
    each = marked_docs.select("row", F.inline(F.arrays_zip("h", "at"))).withColumnRenamed("at", "_at")
    pairs = each.join(index, "h").select("row", "item", (F.col("_at") - F.col("at")).alias("shift")).distinct()
    shifts = pairs.groupBy("row", "item").agg(F.collect_list("shift").alias("shifts"))
    both = shifts.join(items.select(F.col("item_id").alias("item"), F.col("words").alias("other")), "item").join(
        marked_docs.select("row", "doc_id", "words"), "row").select("doc_id", "item", "words", "other", "shifts")

    def verify(batches):
        for batch in batches:
            out = {"doc_id": [], "item_id": [], "start": [], "end": [], "equal": []}
            for row in range(batch.num_rows):
                own, other = (np.frombuffer(batch.column(c)[row].as_py(), dtype=np.uint64) for c in ("words", "other"))
                need = min(least, len(other))
                best = max((overlap(own, other, s, similarity, need) for s in sorted(batch.column("shifts")[row].as_py())), key=lambda x: x[2])
                if best[2]:
                    for key, value in zip(out, (batch.column("doc_id")[row].as_py(), batch.column("item")[row].as_py(), *best), strict=True):
                        out[key].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))
        pa.default_memory_pool().release_unused()

    # The pairs hold all words of both sides, and are verified when the caller writes them.
    set_small_batches(spark)
    return both.mapInArrow(verify, "doc_id long, item_id long, start long, end long, equal long")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of `docs` whose text overlaps no benchmark item; columns as they are."""
    name = fresh(docs.columns, "_row")
    keyed = stored(docs.withColumn(name, F.monotonically_increasing_id()), "bench-rows")
    found = contaminated(keyed.select(F.col(name).alias("doc_id"), "text"), benchmark)
    return keyed.join(found.select(F.col("doc_id").alias(name)).distinct(), name, "left_anti").select(*docs.columns)


@query("op4_spaced_seed_decontamination")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))

"""Near-duplicate passages across documents, found through compact windows of token min-hashes."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from fractions import Fraction
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.llm import textarrays
from chartspark.llm.common import stored, table, text_bytes
from chartspark.llm.decontamination import _filter, _probes, _within
from chartspark.llm.registry import query

#: Hash functions are told apart by this many low bits of a window's key.
FUNCTION_BITS = 4
#: Sets the keys of windows with frequent shingles last apart from the others, above those bits.
LAST = np.uint64(0x9E3779B97F4A7000)
#: Words of texts that a round of blocks may move: this many bytes, or this many times those of all texts in blocks.
ROUND_BYTES, ROUND_SHARE = 1 << 28, 4
#: Bytes of texts' words whose shingles make a bucket, of windows that make one, and at most of words on either side of a block.
BUCKET_BYTES, WINDOW_BYTES, BLOCK_BYTES = 1 << 21, 1 << 24, 1 << 24
#: Bytes of bit sets held at a time while the texts of a block meet, and runs of matches after which their stretches are looked for.
HELD_BYTES, HELD_RUNS = 1 << 26, 1 << 17
#: A window as it travels: its key, its text's row and the digest of that text's words, the words that it spans.
WINDOW = np.dtype([("key", np.int64), ("row", np.int64), ("digest", np.int64), ("first", np.int32), ("end", np.int32)])
#: A shingle's hash, and how many texts hold it.
COUNTED = np.dtype([("h", np.int64), ("n", np.int64)])
FOUND = pa.schema([(name, pa.int64()) for name in ("row", "start", "end", "other")])


def sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    if len(values) < width:
        return values[:0]
    now, size = values, 1
    while 2 * size <= width:
        now = np.minimum(now[:-size], now[size:])
        size *= 2
    count = len(values) - width + 1
    return np.minimum(now[:count], now[width - size : width - size + count])


def compact_windows(hashes: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, least): windows whose stretches of `width` items or more around the minimum share it as their min-hash.

    They are the nodes of the Cartesian tree over the hashes that span at least `width` items: in
    the sequence of sliding minima, such a node is a run of equal values. Places that are not valid
    part the texts and belong to no window.
    """
    least = sliding_minima(np.where(valid, hashes | np.uint64(1 << FUNCTION_BITS), np.uint64(0)), width)
    if not len(least):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [len(least)]]) - 1
    kept = least[first] != 0
    return first[kept], last[kept] + width, least[first][kept]


def _cut(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Bytes of so many values each."""
    offsets = (np.concatenate([[0], np.cumsum(counts)]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def window_table(docs: DataFrame, width: int, shingle: int, functions: int) -> DataFrame:
    """`(row, doc_id, words, digest, windows)` of each text that can hold a passage: its words, 16 bits a word, 16 bytes that tell those of different texts apart, and the windows of all hash functions, packed as WINDOW."""
    low = np.uint64((1 << FUNCTION_BITS) - 1)

    def each(batches):
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for at, part in textarrays.chunks(batch.column("_t")):
                words = textarrays.words_of(part)
                text = np.repeat(np.arange(len(part)), np.diff(words.first))
                hashes = textarrays.shingles(words.hashes, shingle)
                valid = text[: len(hashes)] == text[shingle - 1 :] if len(hashes) else np.zeros(0, dtype=bool)
                long = np.flatnonzero(np.diff(words.first) >= width + shingle - 1)
                short = (words.hashes >> np.uint64(48)).astype(np.uint16)
                held = [short[words.first[i] : words.first[i + 1]].tobytes() for i in long]
                digests = [blake2b(w, digest_size=16).digest() for w in held]
                number = np.zeros(len(part), dtype=np.int64)
                number[long] = np.frombuffer(b"".join(digests), dtype=np.int64)[::2]
                found = []
                for f in range(functions):
                    first, end, least = compact_windows(textarrays.with_seed(hashes, f), valid, width)
                    own, windows = text[first], np.empty(len(first), dtype=WINDOW)
                    windows["key"], windows["row"], windows["digest"] = ((least & ~low) | np.uint64(f)).view(np.int64), rows[at + own], number[own]
                    windows["first"], windows["end"] = first - words.first[own], end - words.first[own]
                    found.append((own, windows))
                own, windows = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows[at + long]), batch.column("doc_id").take(pa.array(at + long)), pa.array(held, type=pa.binary()), pa.array(digests, type=pa.binary()),
                    _cut(windows[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(part))[long])], names=["row", "doc_id", "words", "digest", "windows"])

    return docs.select("row", "doc_id", "_t").mapInArrow(each, "row long, doc_id long, words binary, digest binary, windows binary")


def _deal(items: np.ndarray, hashes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """`(bucket, data)`: the items, packed, by buckets of their hashes."""
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint32)
    n = np.bincount(bucket, minlength=buckets)
    some = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), _cut(items[np.argsort(bucket, kind="stable")], n[some])], names=["bucket", "data"])


def _packed(bucket: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), dtype=kind) for x in bucket.column("data")])


def _dealt_windows(texts: DataFrame, buckets: int) -> DataFrame:
    def each(batches):
        for batch in batches:
            for _, part in textarrays.chunks(batch.column("windows"), 8 * textarrays.CHUNK_BYTES):
                windows = np.frombuffer(b"".join(x.as_py() for x in part), dtype=WINDOW)
                yield _deal(windows, textarrays.mixed(windows["key"].view(np.uint64)), buckets)

    return texts.select("windows").mapInArrow(each, "bucket int, data binary")


def _shared_windows(bucket: pa.Table, few: int) -> pa.Table:
    """`(key, row, c, one, first, end)` of the keys of a bucket that two texts share, with the number `c` of the key's texts: their windows if those are more than `few`, and else a row a text.

    `one` is set once for each key and text. Of texts with the same digest, which share all their keys, only the smallest counts.
    """
    windows = _packed(bucket, WINDOW)
    order = np.argsort(windows["key"])
    key = windows["key"][order]
    same = key[1:] == key[:-1]
    windows = windows[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
    windows = windows[np.lexsort((windows["first"], windows["row"], windows["digest"], windows["key"]))]
    new = lambda *names: np.concatenate([[True], np.logical_or.reduce([windows[x][1:] != windows[x][:-1] for x in names])])[: len(windows)]
    text = new("key", "digest")
    windows = windows[windows["row"] == windows["row"][text][np.cumsum(text) - 1]]
    one, number = new("key", "row"), np.cumsum(new("key")) - 1
    c = np.bincount(number, weights=one).astype(np.int64)[number]
    kept = (c > few) | (one & (c > 1))
    windows = windows[kept]
    return pa.table({"key": windows["key"], "row": windows["row"], "c": c[kept], "one": one[kept], "first": windows["first"], "end": windows["end"]})


def _tagged(dealt: DataFrame, few: int, label: str) -> DataFrame:
    """`_shared_windows` of all buckets."""
    return stored(dealt.groupBy("bucket").applyInArrow(lambda bucket: _shared_windows(bucket, few), "key long, row long, c long, one boolean, first int, end int"), label)


def stretches(match: np.ndarray, least: int, similarity: float) -> list[tuple[int, int]]:
    """Disjoint stretches of at least `least` places, from match to match, with this share of matches: the longest one, then those on both sides of it."""
    out, todo = [], [(0, len(match))]
    run, held = np.concatenate([[0.0], np.cumsum(np.where(match, 1 - similarity, -similarity))]), np.concatenate([[0], np.cumsum(match)])
    while todo:
        a, b = todo.pop()
        if b - a < least or held[b] - held[a] < similarity * least - 1e-6:
            continue
        part = run[a : b + 1] + 1e-9 * np.arange(b - a + 1)
        low = np.minimum.accumulate(part)
        # For every end, the first start that leaves the share at or above the similarity.
        start = np.searchsorted(-low, -part, side="left")
        end = int(np.argmax(np.arange(len(part)) - start))
        first = int(start[end])
        if end - first < least:
            continue
        hits = np.flatnonzero(match[a + first : a + end])
        if len(hits) and hits[-1] + 1 - hits[0] >= least:
            out.append((a + first + int(hits[0]), a + first + int(hits[-1]) + 1))
        todo += [(a, a + first), (a + end, b)]
    return sorted(out)


def all_stretches(own: np.ndarray, first: np.ndarray, end: np.ndarray, size: np.ndarray, least: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, start, end): what `stretches` finds, for many lists of places at once, in any order. List `own` has `size[own]` places, and matches in the runs from `first` to `end`, sorted by list and place.

    In whole numbers: with a similarity of p / q a match adds q - p and any other place takes p. The first of the longest stretches that sum to 0 or more
    ends with a run and begins in the gap before one, or else begins where its list does and may end in a gap. So only runs are looked at, not places.
    """
    share = Fraction(similarity).limit_denominator(10_000)
    p, q = share.numerator, share.denominator
    held = np.concatenate([[0], np.cumsum(end - first)])
    low, high = q * held[:-1] - p * first, q * held[1:] - p * end
    of = np.arange(len(size))
    lo, hi = np.searchsorted(own, of, side="left"), np.searchsorted(own, of, side="right")
    a, b, out = np.zeros(len(size), dtype=np.int64), size, []
    while True:
        kept = (b - a >= least) & (q * (held[hi] - held[lo]) >= p * least)
        lo, hi, a, b, of = (x[kept] for x in (lo, hi, a, b, of))
        if not len(of):
            break
        n = hi - lo
        at, part = np.concatenate([[0], np.cumsum(n)[:-1]]), np.repeat(np.arange(len(of)), n)
        place = np.arange(len(part))
        run = place + np.repeat(lo - at, n)
        base = (low[lo] + p * (first[lo] - a))[part]
        before, after = low[run] - base, high[run] - base
        # Sums of later lists lie below those of all earlier ones, so one search serves all.
        below = part * (2 * q * int((b - a).max()) + 1)
        head = np.searchsorted(-np.minimum.accumulate(before - below), below - after)
        whole = after >= 0
        start = np.where(whole, a[part], first[run[head]] - (after - before[head]) // p)
        length = end[run] - start
        most = np.maximum.reduceat(length, at)
        best = np.minimum.reduceat(np.where(length == most[part], place, len(place)), at)
        last = np.maximum.reduceat(np.where(whole, place, -1), at)
        y = np.where(last >= 0, np.minimum(b, end[run[last]] + after[last] // p), a)
        begins = y - a >= most
        x, y = np.where(begins, a, start[best]), np.where(begins, y, end[run[best]])
        head, tail = np.where(begins | whole[best], lo, run[head[best]]), run[np.where(begins, last, best)]
        kept = y - x >= least
        lo, hi, a, b, of, x, y, head, tail = (z[kept] for z in (lo, hi, a, b, of, x, y, head, tail))
        long = end[tail] - first[head] >= least
        out.append((of[long], first[head][long], end[tail][long]))
        lo, hi, a, b, of = (np.concatenate(z) for z in ((lo, tail + 1), (head, hi), (a, y), (x, b), (of, of)))
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([none, *x]) for x in zip(*out, strict=True)) if out else (none, none, none)


def _shingles16(data: bytes, shingle: int) -> np.ndarray:
    return textarrays.shingles(np.frombuffer(data, dtype=np.uint16).astype(np.uint64), shingle)


@contextmanager
def _tidy(spark: SparkSession):
    """Shuffle files of the jobs run inside go when each job ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _distinct_keys(tagged: DataFrame) -> DataFrame:
    """`(key, kept)`: of keys with the same texts the smallest, as the pairs of all of them meet there. Texts are compared by their number and two 64-bit sums."""
    sums = [F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"s{i}") for i in range(2)]
    return tagged.groupBy("key").agg(F.min("c").alias("c"), *sums).groupBy("c", "s0", "s1").agg(F.min("key").alias("key")).select("key", F.lit(True).alias("kept"))


def _joined(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of a batch's `words`, one text after the other, whether each lies in a span of its text, its text, and where each text begins."""
    sizes = np.array([len(w) // 2 for w in (w.as_py() for w in batch.column("words"))], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    hashes = _shingles16(b"".join(w.as_py() for w in batch.column("words")), shingle)
    spans = batch.column("spans")
    n, flat = np.diff(spans.offsets.to_numpy()), spans.flatten()
    own = np.repeat(begins[:-1], n)
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, flat.field("first").to_numpy() + own, 1)
    np.add.at(edge, flat.field("end").to_numpy() + own, -1)
    text = np.repeat(np.arange(len(sizes)), sizes)
    # The last places of a text begin shingles that reach into the next one; no span holds them.
    return hashes, np.cumsum(edge[:-1]) > 0, text, begins


def _windows_by_rarity(hot: DataFrame, width: int, shingle: int, functions: int, few: int, buckets: int) -> DataFrame:
    """`(bucket, data)`: windows of the texts and spans of `hot(row, words, spans)`, with shingles of more than `few` texts last in every hash order.

    A window then has a frequent shingle as its minimum only if it has no other, so texts that share a common line
    within a passage of their own meet by that passage's own words. Frequent shingles are a bit set of fixed size; any
    order serves that is the same for all texts, so a shingle that is in the set by chance does no harm.
    """

    def parts(batches):
        for batch in batches:
            for at, part in textarrays.chunks(batch.column("words")):
                yield batch.slice(at, len(part))

    def counts(batches):
        for batch in parts(batches):
            hashes, valid, text, _ = _joined(batch, shingle)
            values, place = np.unique(hashes[valid], return_inverse=True)
            # A text counts once for each of its shingles.
            once = np.unique(place.astype(np.int64) * len(batch) + text[: len(hashes)][valid]) // max(1, len(batch))
            counted = np.empty(len(values), dtype=COUNTED)
            counted["h"], counted["n"] = values.view(np.int64), np.bincount(once, minlength=len(values))
            yield _deal(counted, values, buckets)

    def frequent(bucket):
        counted = _packed(bucket, COUNTED)
        values, place = np.unique(counted["h"], return_inverse=True)
        return pa.table({"h": values[np.bincount(place, weights=counted["n"], minlength=len(values)) > few]})

    counted = hot.select("words", "spans").mapInArrow(counts, "bucket int, data binary").groupBy("bucket").applyInArrow(frequent, "h long")
    shared = hot.sparkSession.sparkContext.broadcast(_filter(stored(counted, "passage-frequent")))
    low = np.uint64((1 << FUNCTION_BITS) - 1)

    def each(batches):
        flags = np.unpackbits(shared.value).astype(bool)
        for batch in parts(batches):
            hashes, valid, text, begins = _joined(batch, shingle)
            last, rows = np.ones(len(hashes), dtype=bool), batch.column("row").to_numpy()
            for probe in _probes(hashes):
                last &= flags[probe]
            for f in range(functions):
                order = (textarrays.with_seed(hashes, f) >> np.uint64(1)) | (last.astype(np.uint64) << np.uint64(63))
                first, _, least = compact_windows(order, valid, width)
                windows = np.zeros(len(first), dtype=WINDOW)
                windows["key"], windows["row"] = (((least & ~low) | np.uint64(f)) ^ LAST).view(np.int64), rows[text[first]]
                windows["digest"] = windows["row"]
                yield _deal(windows, textarrays.mixed(windows["key"].view(np.uint64)), buckets)

    return hot.select("row", "words", "spans").mapInArrow(each, "bucket int, data binary")


def _dealt(hot: DataFrame, shingle: int, buckets: int) -> DataFrame:
    """`(bucket, rows, hashes)`: the shingles of all texts, dealt out by their hash, in runs of eight bytes a text's row and four bytes a hash."""

    def each(batches):
        for batch in batches:
            for at, part in textarrays.chunks(batch.column("words")):
                values = [_shingles16(w.as_py(), shingle) for w in part]
                hashes, rows = np.concatenate(values), np.repeat(batch.column("row").to_numpy()[at : at + len(part)], [len(v) for v in values])
                bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint32)
                order = np.argsort(bucket, kind="stable")
                rows, hashes, ends = rows[order], hashes[order].astype(np.uint32), np.cumsum(np.bincount(bucket, minlength=buckets))
                some = np.flatnonzero(np.diff(ends, prepend=0)).tolist()
                cuts = [slice(ends[i - 1] if i else 0, ends[i]) for i in some]
                yield pa.RecordBatch.from_arrays([
                    pa.array(some, type=pa.int32()), pa.array([rows[c].tobytes() for c in cuts], type=pa.binary()), pa.array([hashes[c].tobytes() for c in cuts], type=pa.binary())],
                    names=["bucket", "rows", "hashes"])

    return hot.select("row", "words").mapInArrow(each, "bucket int, rows binary, hashes binary")


def _paired(bucket: pa.Table, most: int) -> pa.Table:
    """`(h, a, b, n, m)` of a bucket: for texts a < b that share shingles of at most `most` texts, the places of such in a and in b; and the shingles `h` of more texts."""
    number = bucket.column("bucket")[0].as_py()
    rows = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64) for x in bucket.column("rows")])
    code = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint32) for x in bucket.column("hashes")]).astype(np.uint64) << np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    texts, place = np.unique(rows[first], return_inverse=True)
    code |= np.repeat(place.astype(np.uint64), np.diff(np.append(first, len(rows))))
    code.sort()
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    places, code = np.diff(np.append(first, len(code))), code[first]
    value, text = code >> np.uint64(32), (code & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    held = np.diff(np.append(first, len(value)))
    frequent = (np.uint64(number) << np.uint64(32) | value[first[held > most]]).view(np.int64)
    use = np.repeat((held > 1) & (held <= most), held)
    rank = (np.arange(len(value)) - np.repeat(first, held))[use]
    text, places = text[use], places[use]
    pair, n, m = [], [], []
    for k in range(1, int(rank.max(initial=0)) + 1):
        at = np.flatnonzero(rank >= k)
        pair.append(text[at - k] << 32 | text[at])
        n.append(places[at - k])
        m.append(places[at])
    none = np.zeros(0, dtype=np.int64)
    pair, n, m = (np.concatenate([none, *x]) for x in (pair, n, m))
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else none
    n, m = (np.add.reduceat(x[order], first) if len(pair) else none for x in (n, m))
    empty = [pa.nulls(len(frequent), pa.int64())] * 4
    a, b = texts[pair[first] >> 32], texts[pair[first] & 0xFFFFFFFF]
    columns = [pa.concat_arrays([pa.array(x), e]) for x, e in zip((a, b, n, m), empty, strict=True)]
    return pa.table([pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(frequent)]), *columns], names=["h", "a", "b", "n", "m"])


def _needs(hot: DataFrame, frequent: DataFrame, buckets: int, width: int, shingle: int, similarity: float) -> DataFrame:
    """`(row, need)`: so many places with shingles that are not in `frequent(h)` every passage of a text has in common with its partner; 0 or less if it may do without.

    Every stretch of `width` places or more lacks that many of its share, whichever of its frequent shingles the partner holds.
    They are a bit set of fixed size; a shingle that is in it by chance lowers the need.
    """
    shared = hot.sparkSession.sparkContext.broadcast(_filter(frequent))

    def each(batches):
        for batch in batches:
            rows, needs = batch.column("row"), []
            for w in batch.column("words"):
                hashes = _shingles16(w.as_py(), shingle)
                known = ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))
                lack = np.full(len(hashes), similarity)
                lack[_within(shared.value, textarrays.mixed(known))] -= 1
                run = np.concatenate([[0.0], np.cumsum(lack)])
                needs.append(float((run[width:] - np.maximum.accumulate(run[:-width])).min()) - 1e-6)
            yield pa.RecordBatch.from_arrays([rows, pa.array(needs, type=pa.float64())], names=["row", "need"])

    return hot.select("row", "words").mapInArrow(each, "row long, need double")


def _by_shingles(hot: DataFrame, width: int, shingle: int, similarity: float, needed: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, needs): `(row, other)` of all candidates of `hot` of which one may hold a passage of the other's with a shingle of at most `most` texts, and `_needs`.

    Texts that share a frequent key seldom share more than a line, too short for a passage. So they are not compared
    key by key: the places that two texts share are counted shingle by shingle, in shuffles that grow with the texts, and few
    pairs have as many as a passage needs. Hashes that are equal by chance only add to the count.
    """
    size = hot.agg(F.sum(F.length("words"))).first()[0] or 0
    buckets = max(int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    counted = _dealt(hot, shingle, buckets).groupBy("bucket").applyInArrow(lambda bucket: _paired(bucket, most), "h long, a long, b long, n long, m long")
    counted = stored(counted, "passage-counted")

    def spread(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(textarrays.mixed(batch.column("h").to_numpy().view(np.uint64)).view(np.int64))], names=["h"])

    frequent = counted.where(F.col("h").isNotNull()).select("h").mapInArrow(spread, "h long")
    needs = stored(_needs(hot, frequent, buckets, width, shingle, similarity), "passage-needs")
    pairs = counted.where(F.col("a").isNotNull()).groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    # No text needs fewer than the least of all needs above 0; the rest of the pairs goes before the join.
    least = needs.where(F.col("need") > 0).agg(F.min("need")).first()[0] or 0.0
    pairs = pairs.where(F.greatest("n", "m") >= least)
    pairs = pairs.join(needs.select(F.col("row").alias("a"), F.col("need").alias("need_a")), "a").join(needs.select(F.col("row").alias("b"), F.col("need").alias("need_b")), "b")
    pairs = pairs.where(((F.col("need_a") > 0) & (F.col("n") >= F.col("need_a"))) | ((F.col("need_b") > 0) & (F.col("m") >= F.col("need_b")))).select("a", "b")
    ours, theirs = (hot.select(F.col("row").alias(x), F.col("keys").alias(f"keys_{x}"), F.col("heavy").alias(f"heavy_{x}")) for x in "ab")
    functions = F.expr(f"aggregate(array_intersect(keys_a, keys_b), 0, (s, k) -> s | shiftleft(1, cast(k & {(1 << FUNCTION_BITS) - 1} as int)))")
    pairs = stored(pairs, "passage-close").join(ours, "a").join(theirs, "b").where(F.arrays_overlap("heavy_a", "heavy_b") & (F.bit_count(functions) >= needed))
    return pairs.select(F.col("a").alias("row"), F.col("b").alias("other")), needs


def _blocks(hot: DataFrame, side: int) -> DataFrame:
    """`(cluster, i, j, mine, row, clusters)`: the texts of each cluster of frequent keys with `whole` set, in parts (mine), and all its texts in parts; each pair of parts is a block, so that every `whole` text meets all texts of its keys.

    The texts of one passage share many keys, each with almost the same texts. Keys are a cluster if the same text has the least hash among their
    `whole` texts, which is as likely as the texts that two keys have in common are many. A text then meets the others once, not once a key.
    Parts have about `side` texts, more where there were more than four, 16 x `side` or BLOCK_BYTES at most.
    """
    texts = hot.select("row", "whole", F.length("words").alias("n"), F.explode("heavy").alias("key"))
    leads = texts.where("whole").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("cluster"))
    texts = stored(texts.join(leads, "key").select("cluster", "row", "whole", "n").distinct(), "passage-clusters")
    parts = lambda n, size: F.least(F.ceil(n / F.lit(side)), F.greatest(F.lit(4), F.ceil(n / F.lit(16 * side)), F.ceil(size / F.lit(BLOCK_BYTES))))
    whole = F.count_if("whole")
    sides = texts.groupBy("cluster").agg(parts(whole, F.sum(F.when(F.col("whole"), F.col("n")))).alias("wholes"), parts(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    lists = texts.groupBy("row").agg(F.collect_list("cluster").alias("clusters"))
    texts = texts.join(sides, "cluster").join(lists, "row")

    def dealt(chosen: DataFrame, mine: bool) -> DataFrame:
        own, other = ("wholes", "parts") if mine else ("parts", "wholes")
        part, rest = F.pmod(F.xxhash64("row"), F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        return chosen.select("cluster", (part if mine else rest).alias("i"), "row", "clusters", "parts").select(
            "cluster", "i", (F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)) if mine else F.pmod(F.xxhash64("row"), F.col("parts"))).alias("j"), F.lit(mine).alias("mine"), "row", "clusters")

    return dealt(texts.where("whole"), True).unionByName(dealt(texts, False))


def _met_in_rounds(blocks: DataFrame, hot: DataFrame, meet: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """What `meet` makes of all blocks, a share of them at a time: a text goes to every block of its clusters, and the shuffle of one round is bounded
    by the texts' own size, however many blocks there are."""
    size = stored(hot.select("row", F.length("words").alias("n")), "passage-sizes")
    own, moved = size.agg(F.sum("n")).first()[0] or 0, blocks.join(size, "row").agg(F.sum("n")).first()[0] or 0
    rounds = max(1, -(-moved // max(ROUND_BYTES, ROUND_SHARE * own)))
    share = F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(rounds))
    done = []
    for number in range(rounds):
        part = blocks.where(share == number).join(hot, "row").groupBy("cluster", "i", "j").applyInArrow(meet, "row long, start long, end long, other long")
        done.append(stored(part, "passage-met"))
    return reduce(DataFrame.unionByName, done)


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are in `wanted`, which is sorted."""
    if not len(wanted):
        return np.zeros(len(values), dtype=bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def _smallest(row: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> pa.Table:
    """A row for each stretch, with the smallest of its partners."""
    order = np.lexsort((other, end, start, row))
    row, start, end, other = (x[order] for x in (row, start, end, other))
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return pa.table([x[new] for x in (row, start, end, other)], schema=FOUND)


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The items of all lists, and the list of each."""
    return pc.list_flatten(lists).to_numpy(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())


def _bit_sets(item: np.ndarray, column: np.ndarray, wanted: np.ndarray, columns: int) -> np.ndarray:
    """For each of the `wanted` items, which are sorted, a packed bit set of the columns that have it, and an empty set after them. Pairs of item and column are sorted, and each comes once."""
    out = np.zeros((len(wanted) + 1, -(-columns // 8)), dtype=np.uint8)
    chosen = _among(item, wanted)
    item, column = np.searchsorted(wanted, item[chosen]), column[chosen]
    if len(item):
        cell = item * out.shape[1] + (column >> 3)
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        out.reshape(-1)[cell[first]] = np.add.reduceat((128 >> (column & 7)).astype(np.uint8), first)
    return out


class _Stretches:
    """Stretches of texts in their partners, from runs of matches that come bit by bit."""

    def __init__(self, width: int, shingle: int, similarity: float):
        self.width, self.shingle, self.similarity = width, shingle, similarity
        self.done, self.lists, self.runs, self.count, self.held = [], [], [], 0, 0

    def add(self, row: int, others: np.ndarray, size: int, own: np.ndarray, first: np.ndarray, end: np.ndarray) -> None:
        """Runs of places from `first` to `end` that text `row`, of `size` places, shares with the partner at `own` in `others`, sorted."""
        self.lists.append((np.full(len(others), row), others, np.full(len(others), size)))
        self.runs.append((own + self.count, first, end))
        self.count, self.held = self.count + len(others), self.held + len(own)
        if self.held > HELD_RUNS:
            self._look()

    def _look(self) -> None:
        if self.lists:
            row, other, size = (np.concatenate(x) for x in zip(*self.lists, strict=True))
            own, start, end = all_stretches(*(np.concatenate(x) for x in zip(*self.runs, strict=True)), size, self.width, self.similarity)
            self.done.append(_smallest(row[own], start, end + self.shingle - 1, other[own]))
            self.lists, self.runs, self.count, self.held = [], [], 0, 0

    def found(self) -> pa.Table:
        self._look()
        return pa.concat_tables([FOUND.empty_table(), *self.done])


def _met(block: pa.Table, width: int, shingle: int, similarity: float, needed: int) -> pa.Table:
    """`(row, start, end, other)` of a block: stretches of its texts with `mine` set that another one of the rest holds, with the smallest of the texts that hold the same places of it.

    A pair is verified in the blocks of its smallest cluster only, if it shares a frequent key and keys of `needed` functions, and if it shares as many places as a passage needs.
    Which texts hold a shingle or a key is a bit set; all partners of a text are compared at once.
    """
    out, need, cluster = _Stretches(width, shingle, similarity), int(np.ceil(similarity * width - 1e-6)), block.column("cluster")[0].as_py()
    row, mine = block.column("row").to_numpy(), block.column("mine").to_numpy()
    rows, at = np.unique(row, return_index=True)
    ours, theirs, block = np.isin(rows, row[mine]), np.isin(rows, row[~mine]), block.take(pa.array(at))
    words, total = block.column("words"), len(rows)
    sizes = pc.binary_length(words).to_numpy().astype(np.int64) // 2
    hashes, text = _shingles16(b"".join(w.as_py() for w in words), shingle), np.repeat(np.arange(total), sizes)
    inside = text[: len(hashes)] == text[shingle - 1 :]
    # Most shingles of one text alone, or of none of ours, go by a few bits of their hashes.
    bits = max(16, min(22, len(hashes).bit_length() + 1))
    low = (hashes >> np.uint64(64 - bits)).astype(np.int32)
    own = np.zeros(1 << bits, dtype=bool)
    own[low[inside & ours[text[: len(hashes)]]]] = True
    inside &= own[low]
    inside &= (np.bincount(low[inside], minlength=1 << bits) > 1)[low]
    at = np.flatnonzero(inside)
    del low, inside
    hashes, text = hashes[at], text[at]
    place = at - (np.cumsum(sizes) - sizes)[text]
    # Places of shingles that one text alone holds match nothing.
    order = np.argsort(hashes)
    new = np.concatenate([[True], hashes[order[1:]] != hashes[order[:-1]]])[: len(hashes)]
    item = np.empty(len(hashes), dtype=np.int64)
    item[order] = np.cumsum(new) - 1
    at = np.flatnonzero(np.bincount(item)[item] > 1)
    item, text, place = item[at], text[at], place[at]
    held, places = np.unique(item * total + text, return_counts=True)
    held_item, held_text = held // total, held % total
    several = np.bincount(held_item, minlength=int(new.sum())) > 1
    at = np.flatnonzero(several[item])
    item, text, place = item[at], text[at], place[at]
    ours &= np.bincount(text, minlength=total) >= need
    # As many places as another text has at most in common with one of ours.
    most = np.zeros(len(several), dtype=np.int64)
    chosen = ours[held_text] & several[held_item]
    np.maximum.at(most, held_item[chosen], places[chosen])
    theirs &= np.bincount(held_text, weights=most[held_item], minlength=total) >= need
    others, columns = np.flatnonzero(theirs), int(theirs.sum())
    if not columns or not ours.any():
        return out.found()
    number = np.cumsum(theirs) - 1
    chosen = theirs[held_text] & (most[held_item] > 0)
    held_item, held_column = held_item[chosen], number[held_text[chosen]]
    # A place without a shingle follows each run of places, so that runs of matches end there.
    ends = np.concatenate([(text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1), [True]])
    again = np.cumsum(1 + ends)[ends] - 1
    item, text, place = (np.repeat(x, 1 + ends) for x in (item, text, place))
    item[again] = -1
    place[again] += 1
    first, last = np.searchsorted(text, np.arange(total), side="left"), np.searchsorted(text, np.arange(total), side="right")

    def listed(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Items by text, where each text's begin, and the columns of each item, sorted."""
        values, owner = _flat(block.column(name))
        order = np.lexsort((owner, values))
        order = order[theirs[owner[order]]]
        return values, np.searchsorted(owner, np.arange(total + 1)), values[order], number[owner[order]], owner

    keys, key_at, by_key, key_column, _ = listed("keys")
    heavy, heavy_at, *_ = listed("heavy")
    clusters, cluster_at, by_cluster, cluster_column, owner = listed("clusters")
    sooner = np.unique(clusters[(clusters < cluster) & ours[owner]])
    cluster_sets = _bit_sets(by_cluster, cluster_column, sooner, columns)
    queue, weight = np.flatnonzero(ours), -(-columns // 8)
    load = np.cumsum((last - first + np.diff(key_at))[queue] * weight) // HELD_BYTES
    for some in np.split(queue, np.flatnonzero(np.diff(load)) + 1):
        own = np.zeros(total, dtype=bool)
        own[some] = True
        wanted_items, wanted_keys = np.unique(item[own[text] & (item >= 0)]), np.unique(keys[np.repeat(own, np.diff(key_at))])
        item_sets, key_sets = _bit_sets(held_item, held_column, wanted_items, columns), _bit_sets(by_key, key_column, wanted_keys, columns)
        for d in some.tolist():
            own_keys, own_heavy, own_clusters = keys[key_at[d] : key_at[d + 1]], heavy[heavy_at[d] : heavy_at[d + 1]], clusters[cluster_at[d] : cluster_at[d + 1]]
            function = own_keys & ((1 << FUNCTION_BITS) - 1)
            by_function = np.argsort(function)
            edges = np.flatnonzero(np.concatenate([[True], np.diff(function[by_function]) != 0]))
            functions = np.bitwise_or.reduceat(key_sets[np.searchsorted(wanted_keys, own_keys[by_function])], edges, axis=0)
            able = np.bitwise_or.reduce(key_sets[np.searchsorted(wanted_keys, own_heavy)], axis=0)
            able &= ~np.bitwise_or.reduce(cluster_sets[np.searchsorted(sooner, own_clusters[own_clusters < cluster])], axis=0)
            able = np.unpackbits(able, count=columns).astype(bool) & (np.unpackbits(functions, axis=1, count=columns).sum(axis=0) >= needed)
            if theirs[d]:
                able[number[d]] = False
            partners = np.flatnonzero(able)
            if not len(partners):
                continue
            own_items, own_place = item[first[d] : last[d]], place[first[d] : last[d]]
            sets = item_sets[np.where(own_items < 0, len(wanted_items), np.searchsorted(wanted_items, own_items))]
            match = np.unpackbits(sets, axis=1, count=columns)[:, partners]
            chosen = match.sum(axis=0) >= need
            if not chosen.any():
                continue
            match, length = np.ascontiguousarray(match[:, chosen].T), len(own_place)
            match[:, 1:] ^= match[:, :-1].copy()
            edges = np.flatnonzero(match)
            of, edge = edges[0::2] // length, own_place[edges % length]
            out.add(int(rows[d]), rows[others[partners[chosen]]], int(max(0, sizes[d] - shingle + 1)), of, edge[0::2], edge[1::2])
    return out.found()


def repeated_passages(docs: DataFrame, least_words: int = 50, shingle: int = 5, similarity: float = 0.8, functions: int = 4, needed: int = 2, few: int = 8, side: int = 256) -> DataFrame:
    """`(doc_id, start, end, partner)`: passages of at least `least_words` words that another text holds too.

    A passage is a stretch of words, `similarity` of whose `shingle`-word shingles occur in the partner's text. `start`
    and `end` count words; words are lower-cased (A-Z) and end at white space. Texts with compact windows of the same
    min-hash under `needed` of the `functions` hash functions are candidates; each pair is verified on all
    its words (by 16 bits of each word's hash). All texts that share a key meet: pair by pair, or
    where more than `few` do, those that share as many places as a passage needs. These are found by counting the shingles that they share; texts that may
    hold a passage wholly of shingles of more than `side` / 4 texts meet all texts of their keys, in blocks of about 2 x `side`. Texts with such a key have windows of a second order besides, with frequent
    shingles last, so that a common line within a passage does not stand for all of it. Of equal texts one meets the others, for all of them. Passages repeated
    within one text only do not count. `partner` is the identifier of the text it was verified with.

    Null, empty and shorter texts have none. Repeated rows are texts of their own and so repeat each other; null
    identifiers are kept. Other columns are ignored; an empty table gives an empty result.
    """
    if functions > 1 << FUNCTION_BITS:
        raise ValueError("too many hash functions")
    width = least_words - shingle + 1
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("_t"))
    texts = stored(window_table(rows, width, shingle, functions), "passage-windows")
    names, words = texts.select("row", "doc_id"), texts.select("row", "words")
    # Of equal texts the smallest one meets the others' texts; the rest repeat it whole and share what it has.
    firsts = texts.groupBy("digest").agg(F.min("row").alias("rep"))
    members = stored(texts.select("row", "doc_id", "digest", (F.length("words") / 2).cast("long").alias("n")).join(firsts, "digest").select("row", "doc_id", "rep", "n"), "passage-members")
    size = texts.agg(F.sum(F.length("windows"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // WINDOW_BYTES))
    shared = _tagged(_dealt_windows(texts, buckets), few, "passage-shared")
    spans = shared.where(F.col("c") > few).groupBy("row").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    rare = _tagged(_windows_by_rarity(stored(spans.join(words, "row"), "passage-spans"), width, shingle, functions, few, buckets), few, "passage-rare")
    tagged = shared.unionByName(rare).where("one").select("key", "row", "c")
    bit = F.expr(f"shiftleft(1, cast(key & {(1 << FUNCTION_BITS) - 1} as int))").alias("f")
    rare = tagged.where(F.col("c") <= few)
    hits = rare.select("key", F.col("row").alias("a")).join(rare.select("key", F.col("row").alias("b")), "key").where(F.col("a") > F.col("b")).select("a", "b", bit)
    frequent = F.when(F.col("kept"), F.col("key"))
    hot = tagged.join(_distinct_keys(tagged.where(F.col("c") > few)), "key", "left").groupBy("row").agg(F.collect_set("key").alias("keys"), F.collect_set(frequent).alias("heavy")).where(F.size("heavy") > 0)
    hot = stored(hot.join(words, "row"), "passage-hot")
    close, needs = _by_shingles(hot, width, shingle, similarity, needed, max(2, side // 4))
    whole = hot.select("row", "heavy", "words").join(needs.select("row", (F.col("need") <= 0).alias("whole")), "row")
    met = _met_in_rounds(stored(_blocks(whole, side), "passage-blocks"), hot, lambda block: _met(block, width, shingle, similarity, needed))
    pairs = hits.groupBy("a", "b").agg(F.bit_or("f").alias("f")).where(F.bit_count("f") >= needed)
    pairs = stored(pairs.select(F.col("a").alias("row"), F.col("b").alias("other")).unionByName(close).distinct(), "passage-pairs")
    joined = pairs.join(words, "row").join(words.select(F.col("row").alias("other"), F.col("words").alias("theirs")), "other")

    def verify(batches):
        for batch in batches:
            out = _Stretches(width, shingle, similarity)
            for at, part in textarrays.chunks(batch.column("words")):
                pairs = batch.slice(at, len(part))
                rows, others, hashes, ends = pairs.column("row").to_numpy(), pairs.column("other").to_numpy(), [], []
                for name in ("words", "theirs"):
                    words = [w.as_py() for w in pairs.column(name)]
                    hashes.append(_shingles16(b"".join(words), shingle))
                    ends.append(np.cumsum([0] + [len(w) // 2 for w in words]).tolist())
                for i in range(len(rows)):
                    # The last places of a text begin shingles that reach into the next one.
                    own, their = (h[end[i] : end[i + 1] - shingle + 1] for h, end in zip(hashes, ends, strict=True))
                    match = _among(own, np.sort(their))
                    back = _among(their, np.sort(own[match]))
                    for row, other, held in ((rows[i], others[i : i + 1], match), (others[i], rows[i : i + 1], back)):
                        edges = np.flatnonzero(held[1:] != held[:-1]) + 1
                        edges = np.concatenate([np.zeros(int(held[0]), dtype=np.int64), edges, np.full(int(held[-1]), len(held))])
                        out.add(row, other, len(held), np.zeros(len(edges) // 2, dtype=np.int64), edges[0::2], edges[1::2])
            yield from out.found().to_batches()

    found = joined.select("row", "other", "words", "theirs").mapInArrow(verify, "row long, start long, end long, other long")
    nothing = F.lit(None).cast("long")
    twins = members.where(F.col("row") != F.col("rep")).groupBy("rep").agg(F.min("n").alias("end"), F.min("row").alias("twin"))
    twins = twins.select(F.col("rep").alias("row"), F.lit(0).cast("long").alias("start"), "end", nothing.alias("other"), "twin")
    # Many texts may name the same stretch of the same partner: one stays, with the smallest of them. Rows are dealt by text, and so stay where they are until their partners' identifiers join.
    best = found.unionByName(met).withColumn("twin", nothing).unionByName(twins).repartition("row").groupBy("row", "start", "end").agg(F.min("other").alias("other"), F.min("twin").alias("twin"))
    other = F.when(F.col("twin").isNull(), F.col("other")).otherwise(F.least("other", F.when(F.col("row") == F.col("rep"), F.col("twin")).otherwise(F.col("rep"))))
    once = stored(best.withColumnRenamed("row", "rep").join(members.select("row", "doc_id", "rep"), "rep").select("doc_id", "start", "end", other.alias("other")), "passage-found")
    return once.join(names.select(F.col("row").alias("other"), F.col("doc_id").alias("partner")), "other").select(
        "doc_id", "start", "end", "partner")


@query("op3_compact_windows")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    with _tidy(spark):
        return repeated_passages(table(spark, sf, "documents"))

"""Packing tokenized documents into sequences: a configuration linear program over the histogram of lengths."""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartspark.llm.common import map_rows, stored, table
from chartspark.llm.registry import query

#: Pieces of text between white space, and their words, that a tokenizer remembers.
HELD = 400_000
#: No fill of the program is worth less than the best one by more than twice this share.
NEAR = 0.1
#: Places in configurations that the program may hand out; their table, 40 bytes for each, is sent to all tasks. Best-fit takes over beyond that.
PLACES = 1 << 20


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Identifiers of whole texts as little-endian 32-bit bytes, with the words met so far remembered.

    Pieces of a text between white space are tokenized on their own by this vocabulary, and its
    words hold letters only, single digits only, or other signs only. Texts in plain Latin
    characters are therefore cut into such pieces here, new pieces into words, and each new word goes to the vocabulary's
    merges; any other text, and one that spells a special token, goes through the tokenizer as it is.
    """

    #: Characters up to U+024F are their own normal form; U+0130 grows in lower case.
    PLAIN = regex.compile("[\t\n\r -~¡-įı-ɏ]*+")
    #: The pattern of words that the vocabulary file states.
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        letters = sorted(pre_tokenizers.ByteLevel.alphabet())
        plain = [b for b in range(256) if chr(b) in letters and (33 <= b <= 126 or 161 <= b != 173)]
        others = iter(c for c in letters if ord(c) > 255)
        self.spell = {b: chr(b) if b in plain else next(others) for b in range(256)}
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """The text's identifiers; no special ones are added, those that the text spells stay."""
        if not self.PLAIN.fullmatch(text) or self.special and self.special.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        # No word holds white space, and the only one among plain characters is what `split` cuts at.
        known, parts = self.known, text.lower().split()
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            if len(known) > HELD:
                known.clear()
            for p in parts:
                if p not in known:
                    known[p] = self.word(p) if p.isalpha() else b"".join([known[w] if w in known else self.word(w) for w in self.WORDS.findall(p)])
            return b"".join([known[p] for p in parts])

    def word(self, word: str) -> bytes:
        """Identifiers of one lower-case word in plain characters, remembered like a piece that is no more than the word."""
        # Plain ASCII characters spell themselves.
        merged = [x.id for x in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.spell))]
        self.known[word] = ids = struct.pack(f"<{len(merged)}I", *merged)
        return ids


@lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this worker: its tasks share the vocabulary and the words met so far."""
    return WordTokenizer(path)


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most `capacity` tokens, `(part, place, doc_id, piece, start, length, ids_crc32)`.

    `place` counts the pieces of equal length within `part`, the task that made them.
    """

    def convert(rows: Iterator[dict]) -> Iterator[dict]:
        tokenizer, part = worker_tokenizer(path), TaskContext.get().partitionId()
        places: dict[int, int] = defaultdict(int)
        last, size = np.array([end], dtype="<u4").tobytes(), 4 * capacity
        for row in rows:
            ids = tokenizer.ids(row["_t"]) + last
            for piece, at in enumerate(range(0, len(ids), size)):
                own = ids[at : at + size]
                length = len(own) // 4
                yield {"part": part, "place": places[length], "doc_id": row["doc_id"], "piece": piece, "start": at // 4, "length": length, "ids_crc32": zlib.crc32(own)}
                places[length] += 1

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return map_rows(rows, convert, "part int, place long, doc_id long, piece int, start long, length long, ids_crc32 long", rows=10_000)


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to `capacity` the largest value of a fill, and the position in `lengths` of one of its items, -1 if that room adds nothing."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        top, item = best[room - 1], -1
        if k := upto[room]:
            gains = best[room - lengths[:k]] + values[:k]
            if gains[i := int(gains.argmax())] > top * (1 + 1e-12):
                top, item = gains[i], i
        best[room], choice[room] = top, item
    return best, choice


def _fill(room: int, choice: list[int], lengths: list[int]) -> list[int]:
    taken = []
    while room > 0:
        if (i := choice[room]) < 0:
            room -= 1
        else:
            taken.append(i)
            room -= lengths[i]
    return taken


def solve_configurations(histogram: dict[int, int], capacity: int, rounds: int = 500,
                         near: float = 0.01, share: float = 0.1, rate: float = 0.3) -> tuple[list[tuple[tuple[int, ...], int]], float]:
    """`(uses, bound)`: configurations (multisets of lengths that fit together) with how often to use each, in order, and a lower bound of what any cover takes.

    Multiplicative weights: a length's price is its weight times its length. In each round the knapsack finds the fill worth
    most; what all items of the open lengths are worth over that is a bound, since no configuration is worth more. The best fill through
    each length, if within `near` of it, is used for `share` of its scarcest length's items, rounded down to whole uses and once at least, and the
    weights of the lengths it covers fall by exp(-`rate` x the part covered). A fill that asks for more than there is takes the longest
    items that fit instead, if that fills it. Lengths without items leave. The rounds end when all items are covered or no fill near the best one can be
    had; `near` is widened before that. What is left then is for the caller.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[int(x)] for x in lengths], dtype=float)
    left, weight, listed = need.astype(np.int64), np.ones(len(lengths)), lengths.tolist()
    uses, bound, places = [], 0.0, 0
    for _ in range(rounds):
        open_ = np.flatnonzero(left)
        if not len(open_) or places > PLACES:
            break
        price, own = lengths * weight, lengths[open_]
        best, choice = knapsack(price[open_], own, capacity)
        top, picks, short = best[capacity], choice.tolist(), own.tolist()
        bound = max(bound, float(price[open_] @ need[open_] / top))
        able = np.flatnonzero(price[open_] + best[capacity - own] >= (1 - near) * top)
        before = len(uses)
        for first in able[np.argsort(-left[open_][able] / need[open_][able], kind="stable")].tolist():
            held = Counter(open_[[first, *_fill(capacity - short[first], picks, short)]].tolist())
            if any(left[k] < n for k, n in held.items()):
                held = Counter({k: min(n, int(left[k])) for k, n in held.items() if left[k]})
                room = capacity - sum(listed[k] * n for k, n in held.items())
                at = bisect_right(listed, room) - 1
                while at >= 0 and room > 0:
                    if (more := min(room // listed[at], int(left[at]) - held[at])) > 0:
                        held[at] += more
                        room -= more * listed[at]
                    at = min(at - 1, bisect_right(listed, room) - 1)
                if room:
                    continue
            used, times = np.array(sorted(held), dtype=np.int64), np.array([held[k] for k in sorted(held)], dtype=np.int64)
            # Weights have fallen since the prices were taken.
            if not len(used) or float((lengths * weight)[used] @ times) < (1 - 2 * near) * top:
                continue
            count = max(1, int(share * int((left[used] // times).min())))
            uses.append((tuple(listed[k] for k in used.tolist() for _ in range(held[k])), count))
            places += len(uses[-1][0])
            left[used] -= times * count
            weight[used] *= np.exp(-rate * times * count / need[used])
        if len(uses) == before:
            near *= 1.5
            if near > NEAR:
                break
    return uses, bound


def _best_fit(left: dict[int, int], gaps: dict[int, list[tuple[int, int]]], next_item: dict[int, int], sequence: int, capacity: int) -> tuple[list[tuple], int]:
    """Slots of the items that are `left`, longest first, each into the smallest gap that holds it or a new sequence; and how many sequences there are then."""
    slots, rooms = [], sorted(g for g, held in gaps.items() if held)

    def add(room: int, first: int, count: int) -> None:
        if not gaps[room]:
            insort(rooms, room)
        gaps[room].append((first, count))

    for length in sorted(left, reverse=True):
        while left[length]:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = min(capacity // length, left[length])
                count, at = left[length] // each, 0
                for _ in range(each):
                    slots.append((length, next_item[length], count, sequence, at))
                    next_item[length] += count
                    left[length] -= count
                    at += length
                add(capacity - at, sequence, count)
                sequence += count
                continue
            room = rooms[k]
            first, count = gaps[room].pop()
            if not gaps[room]:
                rooms.pop(k)
            use = min(count, left[length])
            slots.append((length, next_item[length], use, first, capacity - room))
            next_item[length] += use
            left[length] -= use
            if use < count:
                add(room, first + use, count - use)
            add(room - length, first, use)
    return slots, sequence


def pack_histogram(histogram: dict[int, int], capacity: int, rounds: int = 500) -> list[tuple[int, int, int, int, int]]:
    """Slots `(length, first, count, sequence, offset)` for every item of a histogram of lengths.

    Items `first … first+count-1` of a length go to sequences `sequence …`, one each, at the
    same offset. Items that the configuration program leaves are placed best-fit, longest first, into the gaps
    and then into new sequences. Should best-fit alone need fewer sequences, its packing is taken. The number of slots depends on
    the capacity and the rounds, not on the number of items.
    """
    plain, fewest = _best_fit(dict(histogram), defaultdict(list), dict.fromkeys(histogram, 0), 0, capacity)
    next_item: dict[int, int] = dict.fromkeys(histogram, 0)
    left, slots, sequence = dict(histogram), [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, how many)
    for configuration, count in solve_configurations(histogram, capacity, rounds)[0]:
        offset = 0
        for length in configuration:
            slots.append((length, next_item[length], count, sequence, offset))
            next_item[length] += count
            left[length] -= count
            offset += length
        gaps[capacity - offset].append((sequence, count))
        sequence += count
    rest, sequence = _best_fit(left, gaps, next_item, sequence, capacity)
    return plain if fewest < sequence else slots + rest


def pack(docs: DataFrame, path: str, capacity: int = 2048, rounds: int = 500, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Assign all tokens of `docs` to sequences: `doc_id, piece, start, length, ids_crc32, sequence_id, offset`.

    Every text is tokenized with one end token; only texts longer than `capacity` are cut.
    The driver sees the histogram of lengths, at most `capacity` numbers. Null and empty texts
    are the end token alone. Repeated rows and null identifiers are packed like any other row, other columns are
    ignored, and an empty table gives an empty result.
    """
    pieces = stored(tokenized_pieces(docs, path, capacity, 0, doc_id, text), "packing-pieces")
    counts = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = sorted(pack_histogram(histogram, capacity, rounds))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "length", "_before")
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("_rank", F.col("_before") + F.col("place"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    shared = docs.sparkSession.sparkContext.broadcast(np.array(slots, dtype=np.int64).reshape(-1, 5))

    def place(batches):
        import pyarrow as pa

        slots = shared.value
        base = np.searchsorted(slots[:, 0], np.arange(capacity + 2))
        stride = int(slots[:, 1].max(initial=0)) + int(slots[:, 2].max(initial=0)) + 1
        keys = slots[:, 0] * stride + slots[:, 1] if stride * (capacity + 1) < 1 << 62 else None
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            if keys is not None:
                at = np.searchsorted(keys, length * stride + rank, side="right") - 1
            else:
                at = np.array([base[x] + np.searchsorted(slots[base[x] : base[x + 1], 1], r, side="right") - 1 for x, r in zip(length, rank, strict=True)], dtype=np.int64)
            own = slots[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4])], names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "_rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: all tokens, and every item longer than half a sequence needs its own."""
    return max(-(-sum(x * n for x, n in histogram.items()) // capacity), sum(n for x, n in histogram.items() if 2 * x > capacity))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), vocabulary_path())

import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from chartspark.llm import packing

SCHEMA = "doc_id long, text string, piece string, length long, part string"
TEXTS = ["It's A test, don't!", "Ünïcode ñandú ª²½ №5", "İstanbul ́e é", "a\x1cb\x85c d e", "<|endoftext|> <|startoftext|>x", "", " \n",
         "日本語 text", "Σίσυφος ΣΑΣ", "AĐĞƀɏ ǅ ŉ", "12345 6,7", "İ", "x" * 5000, "­ soft", "\x7f del"]


def test_words_give_the_tokenizer_s_own_identifiers():
    plain = Tokenizer.from_file(packing.vocabulary_path())
    own = packing.WordTokenizer(packing.vocabulary_path())
    every = ["".join(chr(c) for c in range(a, a + 16)) + " x" + "".join("a" + chr(c) for c in range(a, a + 16)) for a in range(32, 0x260, 16)]
    for text in TEXTS + every + [t.upper() for t in every] + TEXTS:
        assert np.frombuffer(own.ids(text), dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_token_once_and_no_overlap(spark):
    rng = random.Random(2)
    words = ["the", "quick", "brown", "fox", "jumps", "13", "ñu", ","]
    texts = TEXTS + [None] + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(300)] + ["the " * 1000]
    data = [(i if i % 50 else None, t, None, 1, "p") for i, t in enumerate(texts)] + [(7, texts[7], "x", None, None)] * 3
    for capacity in (64, 2048):
        got = packing.pack(spark.createDataFrame(data, SCHEMA), packing.vocabulary_path(), capacity).collect()
        plain = Tokenizer.from_file(packing.vocabulary_path())
        want = []
        for d, t, *_ in data:
            ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
            want += [(str(d), p, at, len(ids[at : at + capacity]), zlib.crc32(np.array(ids[at : at + capacity], dtype="<u4").tobytes())) for p, at in enumerate(range(0, len(ids), capacity))]
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
        rows = defaultdict(list)
        for r in got:
            rows[r.sequence_id].append((r.offset, r.length))
        for held in rows.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= capacity
        histogram = defaultdict(int)
        for r in got:
            histogram[r.length] += 1
        assert len(rows) <= 1.1 * packing.lower_bound(histogram, capacity) + 1


def test_knapsack_against_all_fills():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 12, 4))
        values, capacity = rng.random(len(lengths)), int(rng.integers(1, 25))
        best = [0.0] * (capacity + 1)
        for room in range(1, capacity + 1):
            best[room] = max([best[room - 1]] + [best[room - x] + v for x, v in zip(lengths, values, strict=True) if x <= room])
        found, choice = packing.knapsack(values, lengths, capacity)
        taken = packing._fill(capacity, choice.tolist(), lengths.tolist())
        assert np.allclose(found, best) and sum(lengths[taken]) <= capacity and abs(sum(values[taken]) - best[capacity]) < 1e-9


def fewest(histogram, capacity):
    """Fewest sequences of a small histogram, by trying all ways to fill the next one with the longest item in it."""
    from functools import cache

    lengths = sorted(histogram, reverse=True)

    def fills(left, at, room):
        if at == len(lengths):
            yield ()
            return
        for n in range(min(left[at], room // lengths[at]), -1, -1):
            for rest in fills(left, at + 1, room - n * lengths[at]):
                yield (n, *rest)

    @cache
    def least(left):
        if not any(left):
            return 0
        longest = next(i for i, n in enumerate(left) if n)
        return 1 + min(least(tuple(a - b for a, b in zip(left, f, strict=True))) for f in fills(left, 0, capacity) if f[longest])

    return least(tuple(histogram[x] for x in lengths))


def count_of(slots):
    return max((s[2] + s[3] for s in slots), default=0)


def test_small_histograms_against_the_optimum():
    rng, over = random.Random(7), 0
    for _ in range(60):
        capacity = rng.randint(5, 14)
        histogram = {x: rng.randint(1, 4) for x in rng.sample(range(1, capacity + 1), rng.randint(1, 4))}
        want, got = fewest(histogram, capacity), count_of(packing.pack_histogram(histogram, capacity))
        bound = packing.solve_configurations(histogram, capacity)[1]
        assert bound <= want + 1e-9 and want <= got <= want + 1
        over += got > want
    assert over <= 2


def test_configurations_place_nearly_all_items_and_beat_best_fit():
    """Lengths whose best-fit packing wastes room: the program comes within a thousandth of its bound."""
    rng = random.Random(5)
    histogram = {rng.randint(150, 900): rng.randint(100, 3000) for _ in range(150)}
    uses, bound = packing.solve_configurations(histogram, 2048)
    placed = sum(len(c) * n for c, n in uses)
    alone = packing._best_fit(dict(histogram), defaultdict(list), dict.fromkeys(histogram, 0), 0, 2048)[1]
    got = count_of(packing.pack_histogram(histogram, 2048))
    assert placed >= 0.99 * sum(histogram.values()) and all(sum(c) <= 2048 for c, _ in uses)
    assert bound <= got <= min(alone, 1.002 * bound + 2)


def test_slots_cover_each_item_once():
    rng = random.Random(4)
    for _ in range(20):
        histogram = {rng.randint(1, 100): rng.randint(1, 500) for _ in range(rng.randint(0, 60))}
        slots = packing.pack_histogram(histogram, 100, 50)
        seen, filled = defaultdict(set), defaultdict(int)
        for length, first, count, sequence, _ in slots:
            for k in range(count):
                assert first + k not in seen[length]
                seen[length].add(first + k)
                filled[sequence + k] += length
        assert {x: set(range(n)) for x, n in histogram.items()} == dict(seen) and max(filled.values(), default=0) <= 100


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), packing.vocabulary_path()).count() == 0


def test_a_worker_merges_a_word_once(monkeypatch):
    """Pieces between white space are remembered, by all tasks of a worker, and forgotten when there are too many."""
    path = packing.vocabulary_path()
    plain, asked = Tokenizer.from_file(path), []
    packing.worker_tokenizer.cache_clear()
    own = packing.worker_tokenizer(path)

    class Model:
        def tokenize(self, word, merge=own.model.tokenize):
            asked.append(word)
            return merge(word)

    monkeypatch.setattr(own, "model", Model())
    text = "walking, Walking walking's «walking» 12"
    for _ in range(2):
        task = packing.worker_tokenizer(path)
        assert np.frombuffer(task.ids(text), dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == sorted(set(asked)) and len(asked) == 7
    monkeypatch.setattr(packing, "HELD", 3)
    for more in ("other words, more", text, "walking, on", text):
        assert np.frombuffer(own.ids(more), dtype="<u4").tolist() == plain.encode(more, add_special_tokens=False).ids
    packing.worker_tokenizer.cache_clear()

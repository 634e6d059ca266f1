import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartspark.llm import decontamination as D

DOCS, BENCH = "doc_id long, text string, item_id string, row string, words string", "item_id long, text string, doc_id string"


def words(text):
    return re.findall(r"[^\x00-\x2f:-@\[-`{-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_pairs(docs, bench, least=13, similarity=0.8):
    """All alignments of all pairs, every stretch of each; of longer items, alignments that share no seed are left out, as the operator leaves them."""
    items = {}
    for i, t, *_ in bench:
        w = tuple(words(t))
        if w:
            items[w] = min(items.get(w, i), i)
    out = []
    for d, t, *_ in docs:
        own = words(t)
        for other, i in items.items():
            most = 0
            for shift in range(-len(other) + 1, len(own)):
                same = [own[p] == other[p - shift] if 0 <= p - shift < len(other) else False for p in range(len(own))]
                seeded = len(other) < least or any(
                    all(same[p + k] for k in D._taken(m)) and max(0, shift) <= p and p + len(m) <= min(len(own), len(other) + shift)
                    for m in D.MASKS for p in range(len(own) - len(m) + 1))
                if seeded:
                    most = max(most, every_stretch(own, other, shift, min(least, len(other)), similarity))
            if most:
                out.append((str(d), i, most))
    return sorted(out)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    bench = [(i, " ".join(rng.choice(vocabulary) for _ in range(n)), "d") for i, n in enumerate([30, 15, 15, 20, 8, 3, 1])]
    bench += [(20, bench[0][1], None), (21, None, None), (22, "", "x"), (23, " - ", "x")]
    docs = []
    for i in range(40):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]
        if i % 2:
            item = words(bench[rng.randrange(6)][1])
            for _ in range(rng.choice([0, 1, 2, 3])):
                item[rng.randrange(len(item))] = "zz"
            own[3:3] = item[: rng.choice([100, 14, 9])]
        docs.append((i, " ".join(own).title() if i % 4 == 1 else ", ".join(own), "i", None, "w"))
    return docs + [(100, None, "", "", ""), (101, "", None, None, None), (1, docs[1][1], None, None, None), (None, bench[0][1], None, None, None), (102, "w1 " * 30_000, "", "", "")], bench


def test_pairs_against_all_alignments(spark, data):
    docs, bench = data
    got = D.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH)).collect()
    # Single words and triples match in the long text too; brute force takes the shorter texts.
    assert sorted((str(r.doc_id), r.item_id, r.equal) for r in got if r.doc_id != 102) == plain_pairs([d for d in docs if d[0] != 102], bench)


def test_two_substitutions_in_fifteen_words_are_found():
    for a in range(15):
        for b in range(a, 15):
            same = [k not in (a, b) for k in range(15)]
            assert any(all(same[p + k] for k in D._taken(m)) for m in D.MASKS for p in range(15 - len(m) + 1)), (a, b)


def test_clean_documents_stay(spark, data):
    docs, bench = data
    frame = spark.createDataFrame(docs, DOCS)
    kept = D.keep_clean(frame, spark.createDataFrame(bench[:4], BENCH))
    bad = {d for d, _, _ in plain_pairs([d for d in docs if d[0] != 102], bench[:4])}
    assert kept.columns == frame.columns
    clash = frame.withColumn("_row", F.lit("mine"))
    assert {r._row for r in D.keep_clean(clash, spark.createDataFrame(bench[:4], BENCH)).collect()} == {"mine"}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in docs if str(d[0]) not in bad)


@pytest.mark.parametrize("n", range(1, 13))
def test_short_items_are_found_whatever_words_differ(spark, n):
    rng = random.Random(n)
    bench = [(i, " ".join(f"q{i}x{k}" for k in range(n)), None) for i in range(20)]
    docs = []
    for i in range(20):
        item = bench[i][1].split()
        for k in rng.sample(range(n), int(0.2 * n + 1e-9)):
            item[k] = "zz"
        docs.append((i, " ".join(["before", *item, "after"]), None, None, None))
    got = D.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(20)]


def test_empty_tables(spark, data):
    docs, bench = (spark.createDataFrame(x, s) for x, s in zip(data, (DOCS, BENCH), strict=True))
    assert D.contaminated(docs.limit(0), bench).count() == 0 and D.contaminated(docs, bench.limit(0)).count() == 0


def every_stretch(own, other, shift, least, similarity):
    """Most equal words of any aligned stretch of `least` words or more, by trying all of them; 0 if there is none."""
    low, high = max(0, shift), min(len(own), len(other) + shift)
    same = [own[p] == other[p - shift] for p in range(low, high)]
    return max((sum(same[a:b]) for a in range(len(same)) for b in range(a + least, len(same) + 1) if sum(same[a:b]) >= similarity * (b - a) - 1e-9), default=0)


def test_overlap_against_every_stretch():
    rng = random.Random(4)
    for _ in range(1500):
        n, extra = rng.randint(1, 40), rng.randint(0, 6)
        other = np.array([rng.randrange(1000) for _ in range(n)], dtype=np.uint64)
        inner = other.copy()
        for k in rng.sample(range(n), rng.randint(0, n // 3)):
            inner[k] = 5000
        own = np.concatenate([np.array([rng.randrange(2000, 3000) for _ in range(extra)], dtype=np.uint64), inner[rng.randint(0, 3) :]])
        shift, least = extra - rng.randint(0, 3), min(13, n)
        start, end, equal = D.overlap(own, other, shift, 0.8, least)
        assert equal == every_stretch(own, other, shift, least, 0.8)
        if equal:
            assert end - start >= least and equal >= 0.8 * (end - start) - 1e-9
            assert equal == sum(own[p] == other[p - shift] for p in range(start, end))


def test_substitutions_spread_over_the_passage_are_found(spark):
    item = [f"q{i}" for i in range(30)]
    docs = []
    for i, (n, places) in enumerate([(13, [6]), (13, [4, 9]), (15, [4, 9, 14]), (20, [3, 8, 13, 18]), (30, [4, 9, 14, 19, 24, 29]), (20, [2, 5, 8, 11, 14, 17]), (10, [])]):
        docs.append((i, " ".join(["before"] * 7 + ["zz" if k in places else w for k, w in enumerate(item[:n])] + ["after"] * 7), None, None, None))
    got = D.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, " ".join(item), None)], BENCH)).collect()
    assert sorted((r.doc_id, r.equal) for r in got) == [(0, 12), (1, 11), (2, 12), (3, 16), (4, 24)]


def test_pairs_against_every_stretch(spark, data):
    """Items of 13 words or more: no seed is asked for, as a fifth of substituted words always leaves one."""
    docs, bench = data
    got = D.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH)).collect()
    want = []
    for d, t, *_ in docs:
        own = words(t)
        for i, b, *_ in bench[:4] if d != 102 else []:
            other = words(b)
            if most := max((every_stretch(own, other, s, 13, 0.8) for s in range(-len(other) + 1, len(own))), default=0):
                want.append((str(d), i, most))
    assert sorted((str(r.doc_id), r.item_id, r.equal) for r in got if r.doc_id != 102 and r.item_id < 4) == sorted(want)


def test_bit_set_is_read_packed():
    rng = np.random.default_rng(5)
    held, other = (rng.integers(0, 1 << 63, 2000).astype(np.uint64) for _ in range(2))
    flags = np.zeros(1 << D.FILTER_BITS, dtype=bool)
    for probe in D._probes(held):
        flags[probe] = True
    both = np.concatenate([other, held])
    want = np.ones(len(both), dtype=bool)
    for probe in D._probes(both):
        want &= flags[probe]
    assert (D._within(np.packbits(flags), both) == np.flatnonzero(want)).all() and want[2000:].all()
    assert len(D._within(np.packbits(flags), both[:0])) == 0

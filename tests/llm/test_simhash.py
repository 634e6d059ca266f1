import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chartspark.llm import simhash

SCHEMA = "doc_id long, text string, fp string, leaf string, component_id string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, radius):
    """items: (doc_id, fingerprint). Smallest reachable identifier of each, by comparing all pairs."""
    best = {f: f for _, f in items}
    fps = sorted(best)
    group = {f: i for i, f in enumerate(fps)}
    changed = True
    while changed:
        changed = False
        for x in fps:
            for y in fps:
                if bin(x ^ y).count("1") <= radius and group[x] != group[y]:
                    group[x] = group[y] = min(group[x], group[y])
                    changed = True
    least = {}
    for d, f in items:
        if d is not None:
            least[group[f]] = min(d, least.get(group[f], d))
    return {(d, f): least.get(group[f]) for d, f in items}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(120)]
    near = [t + " " + rng.choice(words) for t in texts[:50] if len(t) > 300]
    odd = [None, "", " \n\t", "One", "one", "two words", "A\x0bb c d", "x " * 50_000]
    return [(i, t, "f", None, "c") for i, t in enumerate(texts + near + odd + texts[:9])] + [(3, texts[3], "f", "l", None), (None, texts[4], None, "l", "c")]


def test_whole_result_matches_all_pairs(spark, rows):
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in rows], 2)
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1), r.component_id) for r in got) == sorted(
        (str(d), f, want[d, f]) for d, f in ((r[0], plain_fingerprint(r[1])) for r in rows))


def test_tree_with_many_levels_and_cells_loses_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    flips = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 4), replace=False))) for b in base[:60] for _ in range(4)]
    fps = sorted({int(x) for x in [*base, *flips, 0, 1, 3, 7, 2**64 - 1]})
    points = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for leaf, cell in ((8, 16 * 16), (10_000, 20 * 20), (10_000, 1 << 30)):
        edges = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.linked_fingerprints(points, leaf=leaf, cell=cell).collect()]
        assert all(bin(a ^ b).count("1") <= 2 * 2 * len(fps) and a != b for a, b in edges)
        group = {f: f for f in fps}

        def find(x):
            while group[x] != x:
                x = group[x]
            return x

        for a, b in edges:
            group[max(find(a), find(b))] = min(find(a), find(b))
        want = plain_components([(f, f) for f in fps], 2)
        assert {f: find(f) for f in fps} == {f: want[f, f] for f in fps}


@pytest.mark.parametrize("leaf", [4, 100_000])
def test_the_tree_of_a_cell_finds_all_pairs(leaf):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    points = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 6)]))
    queries = np.concatenate([base, points[::3]])
    got = {(int(i), int(j)) for a, b in simhash.pairs_within(points, queries, 2, leaf) for i, j in zip(a, b, strict=True)}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.bitwise_count(queries[:, None] ^ points[None, :]) <= 2), strict=True)}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_native_hash_is_the_same(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("the quick fox")).alias("h")).first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest(b"the quick fox", 42)

import random

import pytest
from pyspark.sql import functions as F

from chartspark.llm import copies

SCHEMA = "row long, text string"


def plain_set(text, width=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_roots(rows, similarity=0.8):
    """Smallest row reachable over links, by comparing all pairs."""
    sets = [(r, plain_set(t)) for r, t in rows]
    root = {r: r for r, _ in sets}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if root[a] != root[b] and (x == y or len(x & y) >= similarity * len(x | y) - 1e-9):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    line = " ".join(f"c{i}" for i in range(12))
    texts = [None, "", " \n", "One", "one", "two words", "two words more than four"]
    for i in range(40):
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(5, 150))]
        base = (line.split() if i % 3 == 0 else []) + own
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            near = list(base)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = f"z{rng.randrange(99)}"
            texts.append(" ".join(near).upper() if rng.random() < 0.3 else "  ".join(near))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return list(zip(order, texts, strict=True))


@pytest.mark.parametrize("block,pivots", [(1024, 3), (3, 0), (1024, 1)])
def test_components_are_those_of_all_pairs(spark, rows, block, pivots):
    got = {r.row: r.root for r in copies.near_copies(spark.createDataFrame(rows, SCHEMA), block=block, pivots=pivots).collect()}
    groups, want = {}, {}
    for found, out in ((got, groups), (plain_roots(rows), want)):
        for r, root in found.items():
            out.setdefault(root, set()).add(r)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert 40 < len(want) < len(rows)


def test_the_stage_removes_copies_more_than_two_bits_away(spark):
    import corpus_pipeline
    from chartspark.llm import simhash

    rng = random.Random(8)
    texts = []
    for _ in range(20):
        own = [f"w{rng.randrange(5000)}" for _ in range(100)]
        # One word in the middle changes five shingles of 96.
        texts += [" ".join(own), " ".join([*own[:50], "other", *own[51:]])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = corpus_pipeline.without_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))
    assert simhash.keep_first(docs).count() > 20


def test_rows_without_identifier_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "A b  c"), (None, "x"), (None, "x"), (7, None), (8, "")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in copies.keep_first(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()) in (
        [("5", "A b  c"), ("7", ""), ("None", "x")], [("5", "a b c"), ("7", ""), ("None", "x")])
    assert copies.keep_first(docs.limit(0)).count() == 0


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs of a similarity just over 0.8, each of texts of its own: nearly all are found."""
    rng, texts = random.Random(6), []
    for _ in range(400):
        own = [f"w{rng.randrange(100_000)}" for _ in range(100)]
        # Two words apart from each other change ten shingles of 96: 86 / 106 are equal.
        texts += [" ".join(own), " ".join([*own[:30], "other", *own[31:60], "more", *own[61:]])]
    got = copies.near_copies(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert sum(r.root != r.row for r in got) >= 396

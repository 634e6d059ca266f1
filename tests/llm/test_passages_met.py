"""How the texts of a frequent key meet, and how the stretches of many pairs are found at once."""

import random

import numpy as np
import pytest

from chartspark.llm import passages

SCHEMA = "doc_id long, text string, row string, words string, partner string"


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.85, 1.0])
def test_stretches_of_many_lists_are_those_of_each(similarity):
    rng = np.random.default_rng(4)
    for _ in range(60):
        least, lists = int(rng.integers(1, 50)), []
        for k in range(20):
            match = rng.random(int(rng.integers(0, 300))) < rng.random()
            if k % 2:
                match = np.repeat(match, rng.integers(1, 12, len(match)))
            lists.append(match)
        edges = [np.flatnonzero(np.diff(match, prepend=False, append=False)) for match in lists]
        own, edge = np.repeat(np.arange(len(lists)), [len(e) // 2 for e in edges]), np.concatenate(edges)
        got = passages.all_stretches(own, edge[0::2], edge[1::2], np.array([len(match) for match in lists]), least, similarity)
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted((k, a, b) for k, match in enumerate(lists) for a, b in passages.stretches(match, least, similarity))


def shingle_set(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_copies(rng, texts, copies, length, edits):
    new = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    docs = []
    for _ in range(texts):
        whole = new(length)
        for _ in range(copies):
            words = [*new(5), *whole, *new(5)]
            for at in rng.sample(range(len(words)), edits):
                words[at] = new(1)[0]
            docs.append(words)
    return docs


def test_texts_of_many_frequent_keys_meet_once_a_cluster_not_once_a_key(spark, monkeypatch):
    """Near copies share dozens of frequent keys: each text travels to a few blocks, and every two of them are compared all the same."""
    docs, store, seen = near_copies(random.Random(3), 2, 45, 300, 6), passages.stored, {}

    def counted(df, label):
        out = store(df, label)
        seen[label] = out.count()
        return out

    monkeypatch.setattr(passages, "stored", counted)
    rows = spark.createDataFrame([(i, " ".join(w), None, None, None) for i, w in enumerate(docs)], SCHEMA).coalesce(1)
    sets, want = [shingle_set(w) for w in docs], {}
    for d, w in enumerate(docs):
        for e in range(len(docs)):
            if d != e:
                match = np.array([tuple(w[i : i + 5]) in sets[e] for i in range(len(w) - 4)])
                for a, b in passages.stretches(match, 46, 0.8):
                    want[d, a, b + 4] = min(e, want.get((d, a, b + 4), e))
    # With side = 64 shingles of more than 16 texts are frequent, and all texts may hold a passage wholly of such.
    got = [tuple(r) for r in passages.repeated_passages(rows, side=64).select("doc_id", "start", "end", "partner").collect()]
    assert len(got) == len(want) > 400 and {g[:3]: g[3] for g in got} == want
    assert 0 < seen["passage-blocks"] < 12 * len(docs)


@pytest.mark.parametrize(("name", "value"), [("HELD_BYTES", 1), ("HELD_RUNS", 1), ("WINDOW_BYTES", 1 << 12), ("BLOCK_BYTES", 1 << 12)])
def test_rows_do_not_depend_on_the_bounds_of_memory(spark, monkeypatch, name, value):
    docs = near_copies(random.Random(8), 2, 24, 120, 2)
    docs += docs[:3]
    rows = spark.createDataFrame([(i, " ".join(w), None, None, None) for i, w in enumerate(docs)], SCHEMA).coalesce(1)
    want = sorted(map(str, passages.repeated_passages(rows, side=16).collect()))
    monkeypatch.setattr(passages, name, value)
    assert sorted(map(str, passages.repeated_passages(rows, side=16).collect())) == want and len(want) > 48

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartspark.llm import exact

SCHEMA = "doc_id long, text string, run string, T int"


def plain(rows):
    """One row for each input row: largest identifier, size of the group, and whether the row is the one that stays."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    out = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = max(named) if named else None
        taken = False
        for i in ids:
            kept = i == keep and not taken
            taken |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(repr, out))


def rows_of(n, seed):
    rng = random.Random(seed)
    texts = ["", None, "hot"] + ["é" * k for k in range(4)] + [f"text {i} " * rng.randint(1, 30) for i in range(n // 4)] + ["long " * 100_000]
    out = []
    for i in range(n):
        text = "hot" if i % 3 == 0 else rng.choice(texts)
        out.append((rng.choice([i, i, i, i // 2, None]), text, rng.choice(["a", None]), i))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_every_row_against_plain_groups(spark, parts):
    rows = rows_of(400, parts)
    got = exact.exact_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(rows)


def test_fingerprints_that_collide_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact, "SPARE", 0)  # half of the rows are suspects by chance
    rows = rows_of(300, 5)
    got = exact.exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(rows)


def test_a_weak_digest_is_replaced_by_the_texts(spark):
    rows = [(i, t, None, 0) for i, t in enumerate(["aa", "bb", "aa", "bb", "cc", "d", None, ""])]
    got = exact.exact_duplicates(spark.createDataFrame(rows, SCHEMA), digest=lambda t: F.length(t).cast("string")).collect()
    assert sorted(tuple(r)[:4] for r in got) == [
        (0, 2, 2, False), (1, 3, 2, False), (2, 2, 2, True), (3, 3, 2, True), (4, 4, 1, True), (5, 5, 1, True), (6, 7, 2, False), (7, 7, 2, True)]


def test_kept_rows_have_all_their_columns(spark):
    rows = rows_of(200, 9)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = exact.without_copies(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert {r.text or "" for r in kept} == {r[1] or "" for r in rows} and len({r.text or "" for r in kept}) == len(kept)
    assert {tuple(r) for r in kept} <= set(rows)


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact.exact_duplicates(docs).collect() == [] and exact.without_copies(docs).collect() == []


def test_texts_are_not_shuffled_by_the_run(spark):
    docs = spark.createDataFrame([(i, f"t{i}", None, 0) for i in range(100)], SCHEMA)
    plan = exact.exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(run") == 2


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 1 << 40), st.integers(1, 1 << 62), st.lists(st.floats(0, 0.999999), max_size=60))
def test_golomb_codes_round_trip(low, span, shares):
    values = np.array(sorted({low + int(s * span) for s in shares}), dtype=np.int64)
    k, unary, rest = exact.golomb_encoded(values, low, span)
    assert exact.golomb_decoded(len(values), k, unary, rest, low).tolist() == values.tolist()


def test_codes_are_shorter_than_the_fingerprints():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 10_000))
    _, unary, rest = exact.golomb_encoded(values, 0, 1 << 40)
    assert 8 * (len(unary) + len(rest)) < len(values) * (40 - np.log2(len(values)) + 2.5)


def test_the_query_against_plain_groups(spark):
    from chartspark.llm.common import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = exact.op11(spark, "/root/testdata/sf0.001").select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(repr(tuple(r)) for r in got) == plain([(r.doc_id, r.text) for r in docs.collect()])

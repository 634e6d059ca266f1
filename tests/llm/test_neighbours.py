import numpy as np
import pytest
from pyspark.sql import functions as F

from chartspark.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, pid string, v string, n string"


def plain(rows, threshold=0.9):
    """All pairs of equal length: number of links and smallest reachable identifier of every row."""
    out = [(d, 0, d) for d, _ in rows]
    usable = [i for i, (_, e) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    for dimension in {len(rows[i][1]) for i in usable}:
        good = [i for i in usable if len(rows[i][1]) == dimension]
        x = np.array([rows[i][1] for i in good], dtype=np.float32).astype(float)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        link = x @ x.T >= threshold
        np.fill_diagonal(link, False)
        group = np.arange(len(good))
        while True:
            new = np.array([min([group[i], *group[link[i]]]) for i in range(len(good))], dtype=int)
            if (new == group).all():
                break
            group = new
        for k, i in enumerate(good):
            out[i] = (rows[i][0], int(link[k].sum()), min(rows[good[j]][0] for j in np.flatnonzero(group == group[k])))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((900, 32))
    pairs = base[:120] + 0.25 * rng.standard_normal((120, 32))
    cluster = base[200] + 0.2 * rng.standard_normal((260, 32))
    chain = [base[300] + i * 0.35 * base[301] for i in range(8)]
    every = [*base, *pairs, *cluster, *chain, *base[:30], *([base[7]] * 40)]
    out = [(i, np.float32(e).tolist()) for i, e in enumerate(every)]
    n = len(out)
    bad = [None, [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1.0] * 31, [], [1e30] * 32, [2e30] * 32]
    return out + [(n + i, e) for i, e in enumerate(bad)]


def found(spark, rows, **options):
    frame = spark.createDataFrame([(d, e, "p", None, "n") for d, e in rows], SCHEMA)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in neighbours.near_duplicates(frame, **options).collect())


def test_links_and_components_against_all_pairs(spark, rows):
    assert found(spark, rows, recall=1.0) == plain(rows)


def test_dense_groups_with_links_between_them(spark):
    """Two groups of 100 vectors whose centres are at a cosine of 0.925, and one of 60 beyond any link: full lists hide the links across."""
    rng = np.random.default_rng(0)
    a, other, far = (x / np.linalg.norm(x) for x in rng.standard_normal((3, 64)))
    side = other - (other @ a) * a
    b = 0.925 * a + np.sqrt(1 - 0.925**2) * side / np.linalg.norm(side)
    every = [c + 0.1 * rng.standard_normal(64) / 8 for c, n in ((a, 100), (b, 100), (far, 60)) for _ in range(n)]
    rows = [(i, np.float32(e).tolist()) for i, e in enumerate(every)]
    got, want = found(spark, rows, recall=1.0), plain(rows)
    assert got == want and len({c for _, _, c in want}) == 2 and sum(n for _, n, _ in want) > 39_000


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, np.float32(rng.standard_normal(d) * 0.2 + 1).tolist()) for i, d in enumerate([3] * 20 + [5] * 30 + [1] * 4)]
    assert found(spark, rows, recall=1.0) == plain(rows)


def test_too_few_links_found_is_an_error(spark, monkeypatch):
    rows = [(i, np.float32(e).tolist()) for i, e in enumerate(1 + 0.05 * np.random.default_rng(1).standard_normal((40, 8)))]
    monkeypatch.setattr(neighbours, "completed", lambda points, *_: points.select("pid", F.lit(0).cast("long").alias("n")))
    with pytest.raises(RuntimeError, match="audited links"):
        found(spark, rows, rounds=1)


def test_repeated_rows_and_null_identifiers(spark):
    data = [(5, [1.0, 2.0], "", "", "")] * 3 + [(None, [1.0, 2.0], None, None, None), (9, [-1.0, 2.0], "", "", ""), (None, None, None, None, None)]
    got = sorted(map(str, ((r.vec_id, r.n_links, r.component_id) for r in neighbours.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect())))
    assert got == sorted(map(str, [(5, 3, 5)] * 3 + [(None, 3, 5), (9, 0, 9), (None, 0, None)]))


def test_empty_table(spark):
    assert neighbours.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0

import random

import numpy as np
import pytest

from chartspark.llm import passages

SCHEMA = "doc_id long, text string, row string, words string, partner string"


def test_windows_are_the_cartesian_tree_s():
    rng = np.random.default_rng(1)
    for _ in range(60):
        values = rng.integers(1, 50, rng.integers(1, 80)).astype(np.uint64) << np.uint64(8)
        valid = rng.random(len(values)) > 0.05
        width = int(rng.integers(1, 12))
        first, end, least = passages.compact_windows(values, valid, width)
        got = {}
        for a, b, v in zip(first, end, least, strict=True):
            for i in range(a, b - width + 1):
                got[i] = v
        want = {i: values[i : i + width].min() | np.uint64(16) for i in range(len(values) - width + 1) if valid[i : i + width].all()}
        assert got == want
        spans = sorted(zip(first, end, strict=True))
        assert all(b1 - width < a2 for (_, b1), (a2, _) in zip(spans, spans[1:], strict=False))


def test_stretches_against_all_stretches():
    rng = np.random.default_rng(2)
    for _ in range(200):
        match = rng.random(40) < rng.random()
        for a, b in passages.stretches(match, 8, 0.8):
            assert b - a >= 8 and match[a] and match[b - 1]
        long = [(a, b) for a in range(40) for b in range(a + 8, 41) if match[a:b].mean() >= 0.8 - 1e-12]
        if any(match[a] and match[b - 1] and (b - a) == max(y - x for x, y in long) for a, b in long):
            assert passages.stretches(match, 8, 0.8)


def shingle_set(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    fresh = iter(range(10**9))
    new = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    common = new(60)
    line = new(20)
    edited = [w if i % 40 else "edit" for i, w in enumerate(common * 2)]
    docs = {0: new(30) + common + new(10), 1: new(200), 2: common + new(90), 3: new(100) + common, 4: new(49), 5: line + new(70), 6: new(70) + line,
            7: new(10) + edited[:60] + new(5), 8: new(3) * 100}
    copy = new(120)
    docs |= {20 + i: copy for i in range(6)} | {30 + i: [*copy[:50], f"z{i}", *copy[51:]] for i in range(6)}
    rows = [(d, " ".join(w).upper() if d % 2 else "\n".join(w), "r", None, "p") for d, w in docs.items()]
    rng.shuffle(rows)
    return docs, rows + [(40, None, "", "", ""), (41, "", None, None, None), (42, "x " * 30_000, "", "", ""), (None, " ".join(docs[1]), None, None, None)]


def test_planted_passages_and_nothing_else(spark, data):
    docs, rows = data
    got = passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in got} == {None, 0, 1, 2, 3, 7, *range(20, 26), *range(30, 36)}
    for r in got:
        if r.doc_id is not None and r.partner is not None:
            part = shingle_set(docs[r.doc_id][r.start : r.end])
            assert r.end - r.start >= 50 and len(part & shingle_set(docs[r.partner])) >= 0.8 * len(part)
    assert (30, 90) in {(r.start, r.end) for r in got if r.doc_id == 0} and (100, 160) in {(r.start, r.end) for r in got if r.doc_id == 3}


@pytest.mark.parametrize("common", [25, 35, 40, 50])
def test_passages_around_a_line_that_all_texts_hold(spark, common):
    """1000 texts, 500 pairs, each with a passage of 60 words of its own around a line common to all."""
    fresh = iter(range(10**9))
    new = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    line, docs = new(common), []
    for _ in range(500):
        side = (60 - common) // 2
        passage = [*new(side), *line, *new(60 - common - side)]
        docs += [[*new(40), *passage, *new(30)], [*new(10), *passage, *new(70)]]
    rows = [(i, " ".join(w), None, None, None) for i, w in enumerate(docs)]
    got = passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    starts = {i: 40 if i % 2 == 0 else 10 for i in range(1000)}
    whole = {r.doc_id for r in got if r.start <= starts[r.doc_id] and r.end >= starts[r.doc_id] + 60 and r.partner == r.doc_id ^ 1}
    assert len(whole) == 1000


def brute(docs, least=50, similarity=0.8):
    """Words of each text that lie in a stretch of `least` words, this share of whose shingles another text holds, by all pairs and stretches."""
    out = {}
    sets = {d: shingle_set(w) for d, w in docs.items()}
    for d, w in docs.items():
        covered = set()
        for e in docs:
            if d != e:
                match = np.array([tuple(w[i : i + 5]) in sets[e] for i in range(len(w) - 4)], dtype=bool)
                for a, b in passages.stretches(match, least - 4, similarity):
                    covered |= set(range(a, b + 4))
        out[d] = covered
    return out


def test_texts_against_all_pairs(spark):
    """Exact passages, passages with a few other words, near and exact copies and common lines in every combination: who holds one, and where."""
    rng, docs = random.Random(12), {}
    new = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    lines, pool = [new(n) for n in (15, 30, 45, 60)], [new(n) for n in (50, 52, 70, 90, 120)]
    for i in range(160):
        parts = [new(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            part = list(rng.choice(pool + lines))
            if rng.random() < 0.4 and len(part) > 60:
                part[rng.randrange(20, 40)] = "other"
            parts += [part, new(rng.randint(0, 40))]
        docs[i] = sum(parts, [])
    docs[160], docs[161] = docs[3], docs[3]
    got = passages.repeated_passages(spark.createDataFrame([(d, " ".join(w), None, None, None) for d, w in docs.items()], SCHEMA)).collect()
    want, sets = brute(docs), {d: shingle_set(w) for d, w in docs.items()}
    found = {d: set() for d in docs}
    for r in got:
        part = docs[r.doc_id][r.start : r.end]
        held = [tuple(part[i : i + 5]) in sets[r.partner] for i in range(len(part) - 4)]
        assert len(part) >= 50 and sum(held) >= 0.8 * len(held) - 1e-9
        found[r.doc_id] |= set(range(r.start, r.end))
    assert {d for d in docs if found[d]} == {d for d in docs if want[d]} and 60 < sum(map(bool, want.values())) < 162
    assert sum(len(found[d] & want[d]) for d in docs) >= 0.98 * sum(map(len, want.values()))


def test_every_two_texts_of_a_frequent_key_meet(spark):
    """60 texts hold one passage, and every two of them two or three words more after it; exact copies of some change nothing for the others."""
    fresh = iter(range(10**9))
    new = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    passage, docs = new(70), {}
    for i in range(30):
        more = new(2 + i % 2)
        docs[2 * i], docs[2 * i + 1] = [*new(9), *passage, *more, *new(20)], [*new(3), *passage, *more, *new(31)]
    for i in range(0, 24, 3):
        docs[100 + i] = docs[i]
    sets, want = {d: shingle_set(w) for d, w in docs.items()}, {}
    for d, w in docs.items():
        for e in docs:
            if d != e:
                match = np.array([tuple(w[i : i + 5]) in sets[e] for i in range(len(w) - 4)], dtype=bool)
                for a, b in passages.stretches(match, 46, 0.8):
                    want[d, a, b + 4] = min(e, want.get((d, a, b + 4), e))
    rows = spark.createDataFrame([(d, " ".join(w), None, None, None) for d, w in docs.items()], SCHEMA).coalesce(1)
    for side in (256, 16):
        got = [tuple(r) for r in passages.repeated_passages(rows, side=side).select("doc_id", "start", "end", "partner").collect()]
        assert len(got) == len(want) and {g[:3]: g[3] for g in got} == want


def test_blocks_in_rounds_move_no_more_than_their_share(spark, monkeypatch):
    """Texts with two lines that many hold meet in the blocks of several keys: one round or many, the rows are the same, and the setting of the session stays."""
    rng = random.Random(5)
    new = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    lines = [new(56) for _ in range(4)]
    rows = spark.createDataFrame([(i, " ".join([*new(9), *lines[i % 4], *new(30), *lines[(i + 1 + i % 3) % 4], *new(3)]), None, None, None) for i in range(120)], SCHEMA)
    rounds, store = [], passages.stored

    def seen(df, label):
        rounds.append(label)
        return store(df, label)

    monkeypatch.setattr(passages, "stored", seen)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, want = spark.conf.get(key), sorted(map(str, passages.repeated_passages(rows, side=16).collect()))
    assert rounds.count("passage-met") == 1 and len(want) >= 120
    monkeypatch.setattr(passages, "ROUND_BYTES", 1)
    monkeypatch.setattr(passages, "ROUND_SHARE", 2)
    rounds.clear()
    assert sorted(map(str, passages.repeated_passages(rows, side=16).collect())) == want
    assert rounds.count("passage-met") > 3 and spark.conf.get(key) == before


def test_texts_that_share_a_line_only_are_not_compared(spark, monkeypatch):
    """300 texts hold a line too short for a passage, two of them a passage around it: no blocks, and the one pair that shares enough shingles is verified."""
    rng, store, seen = random.Random(9), passages.stored, {}
    new = lambda n: [f"q{rng.randrange(10**9)}" for _ in range(n)]
    line = new(13)
    passage = [*new(30), *line, *new(30)]
    rows = [(i, " ".join([*new(40), *(passage if i in (7, 200) else line), *new(40)]), None, None, None) for i in range(300)]

    def counted(df, label):
        out = store(df, label)
        seen[label] = out.count()
        return out

    monkeypatch.setattr(passages, "stored", counted)
    got = passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in got} == {(7, 40, 113, 200), (200, 40, 113, 7)}
    assert seen["passage-blocks"] == 0 and seen["passage-pairs"] == 1


def test_empty_table(spark):
    assert passages.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0

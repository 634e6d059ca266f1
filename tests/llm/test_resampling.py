import hashlib
import math
import random
import re
import zlib

import pytest

from chartspark.llm import resampling
from chartspark.llm.common import table

SCHEMA = "doc_id long, text string, weight string, row int"
TARGET = "item_id long, text string"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]


def grams(text, n):
    w = words(text)
    return [zlib.crc32(b" ".join(w[i : i + k])) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, percent=25, n=2, buckets=10_000, least=20):
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in grams(text, n):
                counts[f % buckets] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for d in docs:
        found = grams(d[1], n)
        weight = sum(gain[f % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        rows.append([d[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(d[1]))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = k
    return sorted(repr(tuple(r[:5])) for r in rows)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(60)] + ["Été", "naïve", "日本", "x1", "Über"]
    text = lambda n: rng.choice([" ", "\n", ", ", "\u0085 ", "--"]).join(rng.choice(pool) for _ in range(n))
    docs = [(0, "", "a", 1), (1, None, None, 2), (2, "!!! ...", None, 3), (3, "one", None, 3), (3, text(30), None, 4), (None, text(25), None, 5)]
    docs += [(i, text(rng.randint(1, 80)), None, None) for i in range(10, 200)]
    docs += [(i, "same words " * 15, None, None) for i in range(300, 400)] + [(400, text(150_000), None, None)] + [docs[20]] * 3
    return docs, [text(30).upper() for _ in range(12)] + [None, ""]


@pytest.mark.parametrize("n,buckets,percent", [(2, 10_000, 25), (3, 101, 60), (1, 7, 100)])
def test_rows_against_plain_python(spark, data, n, buckets, percent):
    docs, target = data
    got = resampling.resampled(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(list(enumerate(target)), TARGET), percent, grams=n, buckets=buckets)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain(docs, target, percent, n, buckets)


def test_words_that_span_no_block_edge_are_kept(monkeypatch, data):
    text = data[0][20][1].encode()
    want = [f.tolist() for _, f in resampling.feature_buckets(text, 3, 1 << 31)]
    monkeypatch.setattr(resampling, "BLOCK", 3)
    got = sorted(x for _, f in resampling.feature_buckets(text, 3, 1 << 31) for x in f.tolist())
    assert got == sorted(sum(want, [])) and sum(n for n, _ in resampling.feature_buckets(text, 3, 9)) == len(words(text.decode()))


def test_drawn_documents_resemble_the_target(spark):
    rng = random.Random(2)
    old, new = [f"o{i}" for i in range(300)], [f"n{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(old if i % 4 else new) for _ in range(60)), None, None) for i in range(400)]
    target = [(i, " ".join(rng.choice(new) for _ in range(60))) for i in range(40)]
    got = resampling.resampled(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(target, TARGET)).where("rank is not null").collect()
    # A quarter of the documents are like the target; their gain of about 1.5 makes them some four times as likely.
    assert len(got) == 100 and 45 < sum(r.doc_id % 4 == 0 for r in got) < 80


def test_empty_tables(spark):
    none, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], TARGET)
    assert resampling.resampled(none, target).collect() == []
    docs = [(1, "a b " * 12, None, None), (2, None, None, None)]
    assert sorted(repr(tuple(r)) for r in resampling.resampled(spark.createDataFrame(docs, SCHEMA), target, 100).collect()) == plain(docs, [], 100)


def test_the_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = resampling.op13(spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(docs, [r.text for r in table(spark, sf, "benchmark").collect()])

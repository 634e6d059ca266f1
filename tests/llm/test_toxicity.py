import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chartspark.llm import textarrays, toxicity

SF = "/root/testdata/sf0.01"


def test_words_of_against_plain_split():
    texts = [b"The  Cat\tsat\x0bX", None, b"", b"  ", "ñandú Ünï".encode(), b"end", b"start of next", b"x" * 70_000 + b" y"]
    found = textarrays.words_of(pa.array(texts, type=pa.binary()))
    plain = [(t or b"").lower().split() for t in texts]
    assert [bytes(found.data[a:b]) for a, b in zip(found.starts, found.ends, strict=True)] == sum(plain, [])
    assert np.diff(found.first).tolist() == [len(p) for p in plain]
    assert [textarrays.hash_word(w) for p in plain for w in p] == found.hashes.tolist()
    again = textarrays.words_of(pa.array([b"the cat sat zzzz"], type=pa.binary()).slice(0, 1))
    assert again.hashes[0] == found.hashes[0] and again.prefixes(3)[3] != 0 and again.prefixes(3)[0] == 0
    assert [first for first, _ in textarrays.chunks(pa.array(texts, type=pa.binary()), 10)][:2] == [0, 1]


def labelled(spark, rng):
    neutral = ["the", "people", "went", "home", "today", "and", "ate", "bread", "with", "friends"]
    rows = []
    for i in range(600):
        words = [rng.choice(neutral) for _ in range(12)]
        bad = i % 3 == 0
        # In the sample one group is named mostly in toxic texts: a plain classifier would blame the name.
        if rng.random() < (0.8 if bad else 0.05):
            words.append("muslims")
        elif rng.random() < 0.3:
            words.append("christians")
        if bad:
            words.append(rng.choice(["idiot", "scum", "vequta", "vequmo"]))
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows], "doc_id long, text string, score string, toxic double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (10_000, 1)], "doc_id long, toxic int")
    return docs, labels


def test_swapped_groups_change_scores_less(spark):
    docs, labels = labelled(spark, random.Random(1))
    texts = pa.array([b"muslims went home", b"christians went home", b"you idiot muslims", "vequxyz".encode(), b"", None], type=pa.binary())
    plain = toxicity.train(docs, labels, counterfactual=0.0).scores(texts)
    tied = toxicity.train(docs, labels, counterfactual=50.0).scores(texts)
    gap = lambda p: abs(np.log(p[0] / (1 - p[0])) - np.log(p[1] / (1 - p[1])))
    assert gap(tied) < 0.1 * gap(plain) and gap(plain) > 1
    assert tied[0] < 0.5 and tied[2] > 0.7 and tied[3] > 0.5 and tied[4] == tied[5] < 0.5


def test_score_keeps_rows_and_columns(spark):
    docs, labels = labelled(spark, random.Random(2))
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(1, None, None), (1, "", "a"), (None, "scum " * 20_000, "b"), (None, "scum " * 20_000, "b")], "doc_id long, text string, _x string")
    got = toxicity.score(odd, model)
    assert got.columns == ["doc_id", "text", "_x", "score"] and got.count() == 4 and got.where("score > 0.7").count() == 2
    assert toxicity.score(odd.limit(0), model).count() == 0
    empty = toxicity.train(docs.limit(0), labels)
    assert toxicity.score(odd, empty).agg(F.max("score")).first()[0] < 1e-9


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in toxicity.op2(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out}
    # The smallest table has some 30 toxic texts to learn from, and words that none of them holds.
    right = sum(got[d].predicted == y for d, y in labels.items())
    assert right / len(labels) > 0.9 and not any(got[d].predicted and not y for d, y in labels.items())


def test_swapper():
    swap = toxicity.Swapper(toxicity.IDENTITY_TERMS).swap
    assert swap(b"Women and men") == b"men and women" and swap(b"nobody here") is None and swap(b"") is None


def test_fit_against_plain_descent():
    """The fitted weights reach the objective that slow, plain proximal descent on dense rows reaches."""
    rng, size, tied, sparsity = np.random.default_rng(4), 6, 2.0, 0.02
    rows = []
    for i in range(60):
        own = sorted(rng.choice(size, rng.integers(1, 4), replace=False).tolist())
        swapped = sorted(rng.choice(size, 2, replace=False).tolist()) if i % 3 == 0 else None
        rows.append((own, swapped, int(rng.random() < (0.8 if 0 in own else 0.2))))
    dense = lambda lists: np.array([[float(j in x) for j in range(size)] for x in lists])
    x, y = dense([r[0] for r in rows]), np.array([r[2] for r in rows])
    change = dense([r[0] for r in rows if r[1] is not None]) - dense([r[1] for r in rows if r[1] is not None])

    def objective(w, bias):
        z = x @ w + bias
        return np.mean(np.log1p(np.exp(z)) - y * z) + tied * np.mean((change @ w) ** 2) + sparsity * abs(w).sum()

    w, bias, step = np.zeros(size), 0.0, 0.05
    for _ in range(20_000):
        error = (1 / (1 + np.exp(-(x @ w + bias))) - y) / len(y)
        moved = w - step * (x.T @ error + 2 * tied * change.T @ (change @ w) / len(change))
        w, bias = np.sign(moved) * np.maximum(abs(moved) - step * sparsity, 0), bias - step * error.sum()
    got, tilt = toxicity._fit(rows, size, tied, sparsity)
    assert abs(objective(got, tilt) - objective(w, bias)) < 1e-6
    assert np.abs(got - w).max() < 1e-2 and ((got == 0) == (w == 0)).all() and (got == 0).any()

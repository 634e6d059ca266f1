import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartspark.llm import middle

SCHEMA = "doc_id long, text string, output string, n string"


def plain(doc_id, text, rate=90, spm=20, words=True):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text) if words else list(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < spm:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = ["", None, " ", "a", "Z", "é", "\U0001f600", "a<P>b", "<S>", "x<M>", "<P", "<", "S>", "<<S", "日本語 text", "\n\t\r\n", "áb", "n\x00ul"]
    texts += ["".join(rng.choice("abcXYZ  ,.1é日\U0001f600<>PSM\n") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += ["word " * 200_000 + "é" + "tail" * 100_000, "日" * 100_000]
    return [(rng.choice([i, i, i, 3, None]), t, "clash", None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("units", ["words", "characters"])
def test_rows_against_plain_python(spark, rows, units):
    got = middle.fill_in_middle(spark.createDataFrame(rows, SCHEMA), units=units).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr(plain(r[0], r[1], words=units == "words")) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_texts_are_rebuilt_from_output_and_form(spark, rows):
    made = middle.fill_in_middle(spark.createDataFrame(rows, SCHEMA), rate=100, spm=50)
    back = made.select(middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(r.t for r in back) == sorted(r[1] or "" for r in rows)


def test_an_empty_table_and_unknown_units(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert middle.fill_in_middle(docs).collect() == []
    with pytest.raises(ValueError):
        middle.fill_in_middle(docs, units="lines")


@settings(deadline=None, max_examples=200)
@given(st.text())
def test_the_index_converts_both_ways(text):
    index = middle.Exceptions(np.frombuffer(text.encode(), dtype=np.uint8))
    characters = np.arange(len(text) + 1)
    at = np.array([len(text[:i].encode()) for i in characters])
    assert index.bytes(characters).tolist() == at.tolist() and index.characters(at).tolist() == characters.tolist()
    assert len(index.bytes_at) == sum(ord(c) > 127 for c in text)

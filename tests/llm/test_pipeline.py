import re
import sys
from pathlib import Path

import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
from chartspark.llm import packing, personal
from test_copies import plain_roots
from test_decontamination import plain_pairs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        assert k == len(corpus_pipeline.STAGES) - 1 or made.columns == docs.columns and made.dtypes == docs.dtypes
        made.write.parquet(str(top / str(k)))
        before, docs = docs, spark.read.parquet(str(top / str(k)))
        out.append(([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()]))
    return out


def test_toxic_documents_go(stages):
    before, after = stages[0]
    assert 0 < len(after) < len(before) and {r["doc_id"] for r in after} < {r["doc_id"] for r in before}
    # The smallest table has a dozen toxic labels; none of the clean ones may go.
    import pyarrow.parquet as pq

    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert not any(labels.get(d) == 0 for d in gone) and any(labels.get(d) == 1 for d in gone)


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    root = plain_roots([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(set(root.values()))


def test_contaminated_documents_go(stages, spark):
    before, after = stages[2]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    short = [r for r in before if len(r["text"] or "") < 1500]
    bad = {int(d) for d, _, _ in plain_pairs([(r["doc_id"], r["text"]) for r in short[:40]], bench[:15])}
    kept = {r["doc_id"] for r in after}
    assert not bad & kept and len(kept) < len(before)
    known = [re.findall(r"[^\W_]+", t.lower()) for _, t in bench]
    for r in before:
        text = " ".join(re.findall(r"[^\W_]+", r["text"].lower()))
        if any(" ".join(w) in text for w in known):
            assert r["doc_id"] not in kept


def test_personal_data_is_masked(stages):
    before, after = stages[3]
    texts = {r["doc_id"]: r for r in after}
    assert len(before) == len(after)
    for r in before:
        got = texts[r["doc_id"]]
        spans = [(a, b, k) for a, k, b in personal.base_spans(r["text"])]
        assert got["text"] == personal.masked_text(r["text"], spans) and got["n_chars"] == len(got["text"])


def test_all_tokens_are_packed(stages):
    before, after = stages[4]
    plain = Tokenizer.from_file(packing.vocabulary_path())
    want = sum(len(plain.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r["length"] for r in after) == want


def test_run_gives_the_last_stage_s_rows(stages, spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() == len(stages[-1][1])


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows_and_clashing_columns(spark, stage):
    """Null and empty texts, repeated rows, null identifiers and columns named like the stages' own stay as they are."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(5000, None), (5001, ""), (None, "alone here"), (5002, " \n"), (5003, "twice said"), (5003, "twice said")], "doc_id long, text string")
    docs = docs.unionByName(odd.select("doc_id", "text", *(F.lit(None).cast(t).alias(c) for c, t in docs.dtypes[2:])))
    names = ["_row", "score", "_t", "row", "root", "key", "_spans", "_score", "length"]
    docs = docs.withColumns({n: F.lit(7.0) for n in names})
    got = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    if stage < 4:
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        rows = got.collect()
        assert all(r[n] == 7.0 for r in rows for n in names)
        assert 0 < len(rows) <= docs.count() and None in {r.doc_id for r in rows}
        assert 5003 in {r.doc_id for r in rows} and (stage == 1 or len(rows) > 50)
    else:
        assert got.where("doc_id in (5000, 5001) and length = 1").count() == 2 and got.where("doc_id = 5003").count() == 2
    empty = corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), SF)
    assert empty.count() == 0 and empty.columns == got.columns

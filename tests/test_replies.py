import json
import os
import time

import pytest
from pyspark.sql import functions as F

from chartspark.operators import replies as rp
from chartspark.operators import scoring as sc


def logged_model(log, dies=None):
    """Writes every prompt that it answers to `log`; a prompt of `dies` is a dead server."""

    def factory():
        def reply(prompts):
            if dies and any(p in dies for p in prompts):
                time.sleep(2)  # other tasks end meanwhile
                raise ConnectionError("no server")
            with open(f"{log}/{os.getpid()}-{time.time_ns()}", "w") as out:
                json.dump(prompts, out)
            return [p.upper() for p in prompts]

        return reply

    return factory


def calls(log):
    return sorted(p for name in os.listdir(log) for p in json.load(open(f"{log}/{name}")))


def test_a_job_that_died_asks_only_what_is_open(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    df = spark.createDataFrame([(i, f"prompt {i % 80}") for i in range(200)], "id long, p string")
    options = {"sleep": 0.0, "tries": 1, "batch_size": 2, "store": store, "model": "m", "per_task": 4}
    with pytest.raises(Exception, match="no server"):
        sc.score(df, F.col("p"), logged_model(str(log), {"prompt 7", "prompt 33"}), strict=True, **options).collect()
    kept = spark.read.schema(rp.SCHEMA).parquet(store).count()
    assert 0 < kept < 80
    answered = len(set(calls(log)))
    rows = sc.score(df, F.col("p"), logged_model(str(log)), **options).collect()
    assert sorted((r.id, r.reply.text) for r in rows) == [(i, f"PROMPT {i % 80}") for i in range(200)]
    # What was stored is not asked again; tasks that the failure broke off are.
    assert spark.read.schema(rp.SCHEMA).parquet(store).groupBy("key").count().where("count > 1").isEmpty()
    before = len(calls(log))
    assert answered <= 80 and before <= answered + 80 - kept
    again = sc.score(df, F.col("p"), logged_model(str(log)), **options).collect()
    assert len(calls(log)) == before and sorted(r.reply.text for r in again) == sorted(r.reply.text for r in rows)


def test_errors_are_shown_and_asked_again(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "p string")
    options = {"sleep": 0.0, "tries": 1, "batch_size": 1, "store": store}
    model = lambda dies: logged_model(str(log), dies)
    first = sc.score(df.where("p is not null"), F.col("p"), model({"b"}), **options).collect()
    assert sorted((r.p, r.reply.text, r.reply.error) for r in first) == [("a", "A", None), ("b", None, "no server"), ("b", None, "no server")]
    second = sc.score(df.where("p is not null"), F.col("p"), model(None), **options).collect()
    assert sorted((r.p, r.reply.text, r.reply.error) for r in second) == [("a", "A", None), ("b", "B", None), ("b", "B", None)]
    assert calls(log) == ["a", "b"]
    # Another model has replies of its own; an empty table asks nothing.
    sc.score(df.where("p = 'a'"), F.col("p"), model(None), model="other", **options).collect()
    assert calls(log) == ["a", "a", "b"] and sc.score(df.limit(0), F.col("p"), model(None), **options).collect() == []
    rp.compact(spark, store, str(tmp_path / "small"), 1)
    assert spark.read.parquet(str(tmp_path / "small")).count() == 3


def test_keys_tell_models_and_null_prompts_apart(spark):
    df = spark.createDataFrame([("a",), (None,), ("",)], "p string")
    keys = [r[0] for m in ("m", "n") for r in df.select(rp.request_key(F.col("p"), m)).collect()]
    assert len(set(keys)) == 6


def test_each_prefix_is_cold_once(spark, tmp_path):
    """A server that notes each prefix it sees: whoever creates the note found it cold."""
    notes = str(tmp_path)

    def factory():
        def reply(prompts):
            out = []
            for p in prompts:
                time.sleep(0.002)
                warm = os.path.exists(f"{notes}/{p.split('|')[0]}")
                time.sleep(0.01)
                open(f"{notes}/{p.split('|')[0]}", "a").close()
                out.append("warm" if warm else "cold")
            return out

        return reply

    rows = spark.createDataFrame([(f"x{i % 12}" if i % 3 else "hot", i, f"t{i}") for i in range(240)], "prefix string, n long, t string").repartition(8)

    def ask(part):
        return sc.score(part.repartition(8), F.concat_ws("|", "prefix", "t"), factory, sleep=0.0, batch_size=1)

    got = rp.in_waves(rows, F.col("prefix"), ["n"], ask, sc.stored).collect()
    assert len(got) == 240 and {r.prefix: 1 for r in got} == {p: sum(r.reply.text == "cold" for r in got if r.prefix == p) for p in {r.prefix for r in got}}
    assert all((r.reply.text == "cold") == (r.wave == 0) for r in got)


def test_waves_with_null_prefixes_and_no_rows(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "prefix string, n long")
    ask = lambda part: part.withColumn("done", F.lit(True))
    got = rp.in_waves(rows, F.col("prefix"), ["n"], ask, sc.stored)
    assert sorted((str(r.prefix), r.n, r.wave) for r in got.collect()) == [("None", 1, 0), ("None", 2, 1), ("a", 1, 0)]
    assert rp.in_waves(rows.limit(0), F.col("prefix"), ["n"], ask, sc.stored).collect() == []

"""Edge cases of chart records, texts, families and summaries on literal rows."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chartspark.functions import images as im
from chartspark.functions import text as tx
from chartspark.functions.taxonomy import family_by_rules, family_by_spelling
from chartspark.operators import bundle as bu
from chartspark.operators import evaluation as ev
from chartspark.operators import sampling as sa
from chartspark.operators.charts.profile import numeric_profile
from chartspark.operators.validate import rename_checks
from chartspark.sources import changes as ch
from chartspark.sources import readers as rd
from chartspark.sources import writers as wr


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize("path, n", [
    ("images/a_it3.png", 3), ("a_it7", 7), ("x_it.png", 0), ("b.png", 0), ("a_it1_it12.png", 12), ("a_it1_it12.tar.png", 0),
])
def test_iteration(spark, path, n):
    assert one(spark, path, im.iteration) == n


@pytest.mark.parametrize("raw, rules, spelling", [
    ("Grouped Bar Chart", "Bar Chart", "Bar Chart"), ("Scatter-Plot", "Scatter Plot", "Scatter-Plot"),
    ("pie chart", "Pie / Donut", "Pie Chart"), ("Correlation_Heatmap", "Heatmap", "Correlation_Heatmap"),
    ("KDE Plot", "Density Plot", "Density Plot"), ("Line Chart", "Line / Area", "Line Plot"),
    ("Q-Q Plot", "Distribution Summary", "ECDF / Q-Q"), ("Sunburst chart", "Set / Composition", "Sunburst chart"),
    ("Sankey diagram", "Sankey diagram", "Sankey diagram"), ("", "Unknown", "Unknown"), (None, "Unknown", "Unknown"),
    ("3D Surface Plot", "3D Surface", "3D Surface"), ("hist", "Histogram", "hist"), ("pair", "Scatter Matrix", "pair"),
    ("Box-and-whisker", "Box / Violin", "Box-and-whisker"), ("  odd kind ", "odd kind", "odd kind"),
])
def test_families(spark, raw, rules, spelling):
    assert one(spark, raw, family_by_rules) == rules
    assert one(spark, raw, family_by_spelling) == spelling


@pytest.mark.parametrize("text, thought, answer", [
    ("<think>r</think> Yes ", "r", "Yes"), ("r</think>Yes", "r", "Yes"), (" Yes ", None, " Yes "),
])
def test_split_reasoning(spark, text, thought, answer):
    assert tuple(one(spark, text, tx.split_reasoning)) == (thought, answer)


@pytest.mark.parametrize("text, thought, answer, failed", [
    ("<think>r</think>Yes", "<think>r", "Yes", False), ("r</think>Yes", None, "r</think>Yes", False), ("<think>r", None, None, True),
])
def test_after_reasoning(spark, text, thought, answer, failed):
    assert tuple(one(spark, text, tx.after_reasoning)) == (thought, answer, failed)


@pytest.mark.parametrize("text, verdict", [(" TRUE ", True), ("false", False), ("true.", None), (" true\n", True), (None, None)])
def test_verdict(spark, text, verdict):
    assert one(spark, text, tx.verdict) is verdict


def test_labels(spark):
    long = "x" * 80 + ". tail"
    assert one(spark, long, tx.label_120) == "x" * 80
    assert one(spark, long, tx.label_short) == "x" * 67 + "..."
    assert one(spark, "a.b. c", tx.label_short) == "a.b"
    assert one(spark, "a.b. c", tx.label_sentence) == "a"
    assert one(spark, " ", tx.label_120) == "(no description)"
    assert one(spark, None, tx.label_sentence) == "(no description)"


def test_texts(spark):
    assert one(spark, 'pre [{"q":1}] post', tx.array_slice) == '[{"q":1}]'
    assert one(spark, "```json\n{}\n```", tx.strip_fences) == "{}"
    assert one(spark, "petalWidth_of the rose's-leaf", tx.identifier_text) == "petal width of the rose leaf"
    assert one(spark, "a=b=c", tx.override_pair) == ("a", "b=c", True)
    assert one(spark, " =x", tx.override_pair) == (None, None, False)
    assert one(spark, "p.PNG", tx.mime_type) == "image/png"
    assert one(spark, "p.tiff", tx.mime_type) == "image/jpeg"
    aliases = one(spark, "mcg (McGeoch score), the target attribute is a class Representing site; x", lambda c: tx.description_aliases(c, F.lit("t")))
    assert [tuple(a) for a in aliases] == [("mcg", "McGeoch score"), ("t", "site")]


LINES = [
    '{"id": 12, "dataset": {"id": 7, "description": "d"}, "images": ["bare.png", {"path": "p_it1.png"}]}',
    "", "{bad",
    '{"id": "list", "images": [{"path": "p_it3.png", "feedback": ["x", " "]}]}',
    '{"id": "blank", "images": [{"path": "p_it3.png", "feedback": "  "}]}',
    '{"id": "early", "images": [{"path": "p_it2.png", "feedback": "fix"}]}',
    '{"id": "none", "images": []}',
    '{"id": "tie", "images": [{"path": "a_it3.png", "feedback": "f"}, {"path": "b_it3.png"}]}',
    '{"id": "x", "graph": {"structured_data": {"plot_type": "bar", "x": ["q", "r"], "y": "q", "n_rows_input": 4}}, "images": []}',
]


@pytest.fixture
def stored(tmp_path):
    path = tmp_path / "metadata.jsonl"
    path.write_text("\n".join(LINES) + "\n", encoding="utf-8")
    return str(path)


def test_lenient_records(spark, stored):
    got = {r.id: r for r in rd.read_records(spark, stored, strict=False).select(
        "id", "dataset.id", im.final_image(F.col("images"))["path"].alias("final"), im.quality(F.col("images")).alias("quality"),
        F.size(im.valid_images(F.col("images"))).alias("n"),
    ).toDF("id", "dataset_id", "final", "quality", "n").collect()}
    assert len(got) == 7
    assert (got["12"].dataset_id, got["12"].final, got["12"].n) == ("7", "p_it1.png", 1)
    assert {k: got[k].quality for k in ("list", "blank", "early", "none", "tie")} == {
        "list": "bad", "blank": "good", "early": "good", "none": "good", "tie": "bad"}
    assert got["tie"].final == "a_it3.png" and got["none"].final is None


def test_strict_records_name_file_and_line(spark, stored):
    with pytest.raises(PySparkException, match=r"metadata\.jsonl: \{bad"):
        rd.read_records(spark, stored).select("id").collect()


def test_structured_data(spark, stored):
    data = rd.read_records(spark, stored, strict=False).where("id = 'x'").select(
        rd.structured_data(F.col("graph.structured_data")).alias("d")).first().d
    assert (data.x, data.y, data.hue, data.plot_type, data.n_rows_input) == (["q", "r"], ["q"], None, "bar", 4)


def test_row_index_and_lookup(spark, stored):
    lines = {r.row_index: r.value for r in rd.read_lines(spark, stored).collect()}
    assert lines == dict(enumerate(LINES))
    # The file holds an undecodable line: an error when strict, so it is read leniently here.
    with pytest.raises(PySparkException, match="Invalid JSON"):
        rd.read_indexed_records(spark, stored).collect()
    records = rd.read_indexed_records(spark, stored, strict=False)
    assert rd.find_record(records, index=7).first().id == "tie"
    assert rd.find_record(records, chart_id="list").first().row_index == 3
    with pytest.raises(LookupError):
        rd.find_record(records, chart_id="absent")


def test_result_files_named_by_model(spark, tmp_path):
    (tmp_path / "m-1.jsonl").write_text('{"graph_id": "g", "correct": true}\n{"chart_id": "", "correct": true}\n')
    (tmp_path / "m 2.jsonl").write_text('{"chart_id": "c", "graph_id": "g", "correct": null}\n')
    rows = {(r.model, r.chart_id, r.correct) for r in rd.read_results(spark, str(tmp_path)).collect()}
    assert rows == {("m-1", "g", True), ("m 2", "c", None)}


def test_tables_by_suffix(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n2\ty\n")
    assert rd.read_table(spark, str(tmp_path / "t.json")).count() == 2
    assert rd.read_table(spark, str(tmp_path / "t.tsv")).dtypes == [("a", "int"), ("b", "string")]
    with pytest.raises(ValueError):
        rd.read_table(spark, str(tmp_path / "t.pkl"))


def test_listing_and_changes(spark, tmp_path):
    from chartspark.sources.changes import changed_files, gone_files

    for name in ("a", "b"):
        (tmp_path / name).write_text(name)
    before = spark.createDataFrame(rd.read_listing(spark, str(tmp_path)).toPandas())
    (tmp_path / "b").write_text("longer")
    (tmp_path / "c").write_text("new")
    now = rd.read_listing(spark, str(tmp_path))
    assert {r.name for r in changed_files(now, before).collect()} == {"b", "c"}
    assert {r.name for r in gone_files(now, before).collect()} == {"b"}


def test_rewrite_keeps_the_old_data_when_the_change_fails(spark, tmp_path):
    path = str(tmp_path / "d")
    wr.overwrite_jsonl(spark.range(5), path)
    read = lambda p: rd.read_jsonl(spark, p, "id bigint")
    with pytest.raises(PySparkException):
        wr.rewrite(spark, path, lambda df: df.select(F.raise_error(F.lit("no")).alias("id")), read, wr.overwrite_jsonl)
    assert read(path).count() == 5


SUMMARY = [("m", "metadata", True), ("m", "metadata", False), ("m", "other", True), ("m", None, False), ("m", "trends", None)]


def test_accuracy_summary(spark):
    df = spark.createDataFrame(SUMMARY, "model string, qtype string, correct boolean").withColumn("chart_id", F.lit(1))
    got = {r.type: (r.correct, r.incorrect, r.accuracy) for r in ev.accuracy_by_type(df).collect()}
    assert got == {
        "metadata": (1, 1, 0.5), "value extraction": (0, 0, None), "comparison": (0, 0, None), "trends": (0, 0, None),
        "reasoning": (0, 0, None), "full": (2, 2, 0.5)}
    assert tuple(ev.chart_answer_counts(df).first()) == (1, 2, 3)
    assert ev.model_accuracy_per_chart(df).first().accuracy == 0.4


def test_published_totals(spark):
    sizes = {"metadata": 16578, "value extraction": 11572, "comparison": 4651, "trends": 3762, "reasoning": 7962, "other": 40}
    graded = None
    for name, n in sizes.items():
        part = spark.range(n).select(F.lit("m").alias("model"), F.lit(name).alias("qtype"), (F.col("id") % 3 > 0).alias("correct"))
        graded = part if graded is None else graded.union(part)
    got = {r.type: r.correct + r.incorrect for r in ev.accuracy_by_type(graded).collect()}
    assert got.pop("full") == 44565 and sum(got.values()) == 44525
    assert got == {k: n for k, n in sizes.items() if k != "other"}


def test_last_answer_wins(spark):
    rows = [(1, "q", "m", 1, True), (1, "q", "m", 5, None), (1, "q", "n", 2, True), (1, "", "m", 9, True)]
    results = spark.createDataFrame(rows, "chart_id long, question string, model string, row_id long, correct boolean")
    asked = spark.createDataFrame([(1, "q"), (1, "open"), (2, "q")], "chart_id long, question string")
    got = {(r.chart_id, r.question): (r.answers, r.right_answers, r.accuracy) for r in ev.question_accuracy(asked, results).collect()}
    assert got == {(1, "q"): (2, 1, 0.5), (1, "open"): (0, 0, None), (2, "q"): (0, 0, None)}


def test_a_question_typed_full_counts_on_both_sides_of_the_full_line(spark):
    df = spark.createDataFrame([("m", "full", True), ("m", "trends", False)], "model string, qtype string, correct boolean")
    got = {r.type: (r.correct, r.incorrect) for r in ev.accuracy_by_type(df).collect()}
    assert got["full"] == (2, 1) and got["trends"] == (0, 1)


def test_bad_lines_fail_or_are_skipped_in_shards_and_indexed_records(spark, tmp_path):
    (tmp_path / "part_3.jsonl").write_text('{"id": "a"}\n\n{bad\n{"id": "b"}\n')
    (tmp_path / "part_1.jsonl").write_text("{never read\n")
    lenient = rd.read_shards(spark, str(tmp_path), r"part_([0-9]+)\.jsonl", 2, "id string", strict=False)
    assert sorted((r.id, r.shard) for r in lenient.collect()) == [("a", "part_3.jsonl"), ("b", "part_3.jsonl")]
    with pytest.raises(PySparkException, match="Invalid JSON"):
        rd.read_shards(spark, str(tmp_path), r"part_([0-9]+)\.jsonl", 2, "id string").collect()
    path = str(tmp_path / "part_3.jsonl")
    kept = rd.read_indexed_records(spark, path, strict=False).collect()
    assert sorted((r.row_index, r.id) for r in kept) == [(0, "a"), (3, "b")]
    with pytest.raises(PySparkException, match="line 3: "):
        rd.read_indexed_records(spark, path).collect()


def test_size_filter_takes_odd_numbers(spark):
    rows = [(1, "NaN", "5"), (2, "Infinity", "5"), (3, "1e30", "5"), (4, "200", "NaN"), (5, "200.9", "2000.9"), (6, "199.9", "5"), (7, "500", "2001"), (8, "500", "0.9"), (9, None, "5"), (10, "abc", "5"), (11, "200", "1")]
    df = spark.createDataFrame(rows, "did int, NumberOfInstances string, NumberOfFeatures string")
    assert sorted(r.did for r in sa.sized_datasets(df).collect()) == [3, 5, 11]


LINE = ('{"id":"x","n":null,"f":1.5,"big":12345678901234567890123,"images":["old/b.png",5,null,{"path":"old/a.png","w":[1,{"q":null}]},'
        '{"path":7},{"w":2},{"path":"b.png"}]}')


def test_rewritten_lines_keep_everything_but_the_prefix(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join([LINE, "", '{"id":5}', '{"images":"odd"}', "{}"]))
    cut = rd.read_objects(spark, str(path)).withColumn("record", im.stored_without_prefix(F.col("record"), "old/"))
    wr.overwrite_objects(cut, str(tmp_path / "out"))
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert got == [json.loads(LINE.replace("old/a", "a")), {"id": 5}, {"images": "odd"}, {}]
    path.write_text("{}\n[1]\n")
    assert rd.read_objects(spark, str(path), strict=False).count() == 1
    with pytest.raises(PySparkException, match="Invalid JSON"):
        rd.read_objects(spark, str(path)).collect()


def test_bundled_records_keep_objects_without_a_path(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join([LINE, '{"id":5,"k":1}']))
    resolved = spark.createDataFrame([("x", "old/a.png", "disk/a.png"), ("y", "b.png", "disk/b.png")], "chart_id string, path string, source string")
    rows = bu.rewritten_records(rd.read_objects(spark, str(path)), resolved).select(F.to_json("record", {"ignoreNullFields": "false"}).alias("j")).collect()
    got = {str(r["id"]): r for r in (json.loads(r.j) for r in rows)}
    assert got["x"] == json.loads(LINE) | {"images": [{"path": "images/a.jpg", "w": [1, {"q": None}]}, {"path": 7}, {"w": 2}, {"path": "images/b.png"}]}
    assert got["5"] == {"id": 5, "k": 1, "images": []}


def test_only_changed_files_are_read_again(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def count(paths):
        rows = rd.read_jsonl(spark, paths, "chart_id bigint, correct boolean", keep_file=True).withColumnRenamed("_file", "file")
        return rows.groupBy("file", "chart_id").agg(F.count_if("correct").alias("correct"), F.count_if(~F.col("correct")).alias("incorrect"))

    def totals(state):
        return {r.chart_id: (r.correct, r.incorrect) for r in ch.totals(spark.read.parquet(f"{state}/counts")).collect()}

    for name in ("a b.jsonl", "c[1].jsonl", "gone.jsonl"):
        (folder / name).write_text('{"chart_id": 1, "correct": true}\n{"chart_id": 2, "correct": false}\n')
    states = [str(tmp_path / f"s{i}") for i in range(3)]
    assert len(ch.refresh_folder(spark, str(folder), None, states[0], count)) == 3
    assert totals(states[0]) == {1: (3, 0), 2: (0, 3)}
    (folder / "c[1].jsonl").write_text('{"chart_id": 1, "correct": false}\n')
    (folder / "gone.jsonl").unlink()
    (folder / "new.jsonl").write_text('{"chart_id": 9, "correct": true}\n')
    assert len(ch.refresh_folder(spark, str(folder), states[0], states[1], count)) == 2
    assert totals(states[1]) == {1: (1, 1), 2: (0, 1), 9: (1, 0)}
    assert ch.refresh_folder(spark, str(folder), states[1], states[2], count) == []
    assert totals(states[2]) == totals(states[1])


def test_no_dataset_of_the_wanted_size_fails(spark):
    df = spark.createDataFrame([(1, "10", "5")], "did int, NumberOfInstances string, NumberOfFeatures string")
    with pytest.raises(LookupError):
        sa.random_dataset(df, 1)
    assert sa.random_dataset(df, 1, min_rows=5).first().did == 1


def test_nan_is_no_extreme(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    r = numeric_profile(df).first()
    assert (r.rows, r.missing, r.min, r.max, r.mean, r.median) == (4, 1, 1.0, 3.0, 2.0, 2.0)


def test_moved_names_are_noticed(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a", "new"]), (2, ["a", "b"], ["b", "x"]), (3, ["a"], [None])], "k int, old array<string>, new array<string>")
    got = {r.key: r.ok for r in rename_checks(df, "k", "new", "old").where("rule = 'kept in place'").collect()}
    assert got == {1: True, 2: False, 3: True}

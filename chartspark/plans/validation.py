"""Queries: checks of model output. The JSON texts are built from table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark.operators import validate as va
from chartspark.plans import views as v
from chartspark.plans.registry import register


def slim(checked):
    return checked.select("key", "rule", "ok", "detail")


def texts(*pieces):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces])


def doc():
    return F.col("doc_id")


def lang():
    return F.col("lang")


def source():
    return F.col("source")


def rows_sql(rules: dict[str, tuple[str, str]], base: str) -> str:
    parts = [f"select key, '{name}' as rule, coalesce({ok}, false) as ok, cast({detail} as varchar) as detail from b" for name, (ok, detail) in rules.items()]
    return f"with b as ({base}) " + " union all ".join(parts)


@register("val1_verdict", rows_sql({
    "keys": ("m in (0, 1)", "case m when 0 then 'useful,description' when 1 then 'useful,description' when 2 then 'useful' end"),
    "useful is boolean": ("m in (0, 2)", "case m when 0 then 'BOOLEAN' when 1 then 'STRING' when 2 then 'BOOLEAN' end"),
    "description is string": ("m in (0, 1)", "case when m in (0, 1) then 'STRING' end"),
}, "select doc_id as key, doc_id % 4 as m from documents"))
def verdicts(spark, sf):
    m = doc() % 4
    reply = (
        F.when(m == 0, texts('{"useful": true, "description": ', F.to_json(F.struct("text")), "}"))
        .when(m == 1, texts('{"useful": "yes", "description": "', lang(), '"}'))
        .when(m == 2, texts('{"useful": false}'))
        .otherwise(F.lit("no json"))
    )
    # The nested text of the first case is a JSON object, so it is replaced by its string member.
    first = texts('{"useful": true, "description": ', F.regexp_extract(F.to_json(F.struct("text")), r"(?s)^\{\"text\":(.*)\}$", 1), "}")
    docs = v.table(spark, sf, "documents").withColumn("reply", F.when(m == 0, first).otherwise(reply))
    return slim(va.verdict_checks(docs, "doc_id", "reply"))


@register("val2_specs", rows_sql({
    "ten specs": ("n = 10", "n"),
    "keys": ("key % 3 <> 1", "null"),
    "types differ": ("key % 5 <> 0", "case when key % 5 = 0 then 1 else n end"),
    "features exist": ("key % 7 <> 0", "case when key % 7 = 0 then 'lost' else '' end"),
}, "select doc_id as key, 9 + doc_id % 2 as n from documents"))
def specs(spark, sf):
    extra = F.when(doc() % 3 == 1, ', "more": 1').otherwise("")
    feature = F.when(doc() % 7 == 0, "lost").otherwise("n_chars")

    def one(i):
        kind = F.when(doc() % 5 == 0, F.lit("bar")).otherwise(texts("bar", i))
        return texts('{"type": "', kind, '", "features": ["', feature, '", "', source(), '"], "description": "d"', extra, "}")

    reply = texts("[", F.array_join(F.transform(F.sequence(F.lit(1), (9 + doc() % 2).cast("int")), one), ", "), "]")
    docs = v.table(spark, sf, "documents").select("doc_id", reply.alias("reply"), F.array(F.lit("n_chars"), source()).alias("features"))
    return slim(va.spec_checks(docs, "doc_id", "reply", "features"))


@register("val3_renames", rows_sql({
    "same length": ("key % 3 <> 0", "case when key % 3 = 0 then '1/2' else '2/2' end"),
    "no empty name": ("key % 3 = 0 or key % 4 <> 0", "null"),
    "names differ": ("key % 3 = 0 or key % 4 = 0 or source || 'x' <> lang", "case when key % 3 = 0 then 1 else 2 end"),
    "kept in place": ("key % 3 = 0 or key % 4 = 0 or key % 5 <> 1", "case when key % 3 = 0 or key % 4 = 0 or key % 5 = 1 then 0 else 1 end"),
}, "select doc_id as key, source, lang from documents"))
def renames(spark, sf):
    names = F.when(doc() % 3 == 0, F.array(F.concat(source(), F.lit("x")))).when(doc() % 4 == 0, F.array(F.concat(source(), F.lit("x")), F.lit(" "))).when(
        doc() % 5 == 1, F.array(lang(), source()))
    docs = v.table(spark, sf, "documents").select(
        "doc_id", F.array(source(), lang()).alias("features"), names.otherwise(F.array(F.concat(source(), F.lit("x")), lang())).alias("names"))
    return slim(va.rename_checks(docs, "doc_id", "names", "features"))


@register("val4_graph_data", rows_sql({
    "keys": ("key % 4 <> 0", "case when key % 4 = 0 then 14 else 15 end"),
    "plot type": ("key % 3 <> 0", "case when key % 3 = 0 then 'other' else lang end"),
    "features unchanged": ("true", "source || ',n'"),
    "rows plotted": ("key % 2 = 0", "n_chars + key % 2"),
}, "select doc_id as key, lang, source, n_chars from documents"))
def graph_data(spark, sf):
    title = F.when(doc() % 4 == 0, "").otherwise(', "title": "t"')
    kind = F.when(doc() % 3 == 0, "other").otherwise(lang())
    data = texts(
        '{"plot_type": "', kind, '", "features_expected": ["', source(), '", "n"], "features_used": [], "derived_features": [], "x": "a", "y": null, '
        '"hue": ["p", "q"], "facet": null, "aggregation": null, "binning": null, "transformations": [], "filters": [], "n_rows_input": 9, '
        '"n_rows_plotted": ', F.col("n_chars") + doc() % 2, title, "}")
    docs = v.table(spark, sf, "documents").select("doc_id", "lang", "n_chars", data.alias("data"), F.array(source(), F.lit("n")).alias("features"))
    return slim(va.graph_data_checks(docs, "doc_id", "data", "lang", "features", "n_chars"))


@register("val5_reviews", rows_sql({
    "keys": ("key % 3 <> 2", "case key % 3 when 2 then 'feedback' else 'feedback,correction' end"),
    "feedback is string": ("key % 3 <> 1", "case key % 3 when 1 then 'ARRAY<STRING>' else 'STRING' end"),
    "correction is boolean": ("key % 3 <> 2", "case key % 3 when 2 then null else 'BOOLEAN' end"),
}, "select doc_id as key from documents"))
def reviews(spark, sf):
    m = doc() % 3
    reply = (
        F.when(m == 0, texts('{"feedback": "', lang(), '", "correction": true}'))
        .when(m == 1, texts('{"feedback": ["', lang(), '"], "correction": false}'))
        .otherwise(texts('{"feedback": "', lang(), '"}'))
    )
    return slim(va.review_checks(v.table(spark, sf, "documents").withColumn("reply", reply), "doc_id", "reply"))


@register("val6_questions", rows_sql({
    "twenty questions": ("n = 20", "n"),
    "keys": ("key % 4 <> 0", "null"),
    "basis": ("key % 5 <> 0", "null"),
    "no repeats": ("key % 6 <> 0", "case when key % 6 = 0 then 1 else n end"),
}, "select doc_id as key, 18 + doc_id % 3 as n from documents"))
def questions(spark, sf):
    answer_key = F.when(doc() % 4 == 0, "reply").otherwise("answer")
    basis = F.when(doc() % 5 == 0, "data").otherwise("both")

    def one(i):
        number = F.when(doc() % 6 == 0, F.lit(0)).otherwise(i)
        return texts('{"question": "q', number, '", "', answer_key, '": "', lang(), '", "answer_basis": "', basis, '"}')

    reply = texts("[", F.array_join(F.transform(F.sequence(F.lit(1), (18 + doc() % 3).cast("int")), one), ","), "]")
    return slim(va.question_checks(v.table(spark, sf, "documents").select("doc_id", reply.alias("reply")), "doc_id", "reply"))


@register("val7_labels", rows_sql({
    "one label per question": ("key % 4 + 1 = 3", "3"),
    "known labels": ("key % 2 = 0", "case when key % 2 = 0 then 'metadata,trends' else 'metadata,' || lang end"),
}, "select doc_id as key, lang from documents"))
def labels(spark, sf):
    given = F.array(F.lit("metadata"), F.when(doc() % 2 == 0, "trends").otherwise(lang()), F.lit("metadata"))
    docs = v.table(spark, sf, "documents").select("doc_id", given.alias("labels"), (doc() % 4 + 1).alias("n"))
    return slim(va.label_checks(docs, "doc_id", "labels", "n"))


@register("val9_styles", """
select doc_id, case when lang in ('en', 'fr') then lang else 'default' end as style from documents""")
def styles(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", va.style_or_default(lang(), ["en", "fr"]).alias("style"))


@register("val10_grids", rows_sql({
    "panels per row": ("key % 9 <= 5", "key % 9"), "panels per column": ("key % 7 <= 5", "key % 7"),
}, "select doc_id as key from documents"))
def grids(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", (doc() % 7).alias("r"), (doc() % 9).alias("c"))
    return slim(va.grid_checks(docs, "doc_id", "r", "c"))


@register("val11_descriptions", rows_sql({
    "headers present": ("key % 3 <> 0", "case when key % 3 = 0 then 5 else 6 end"),
    "headers in order": ("key % 3 = 1", "null"),
    "length": ("words <= 2500", "words"),
}, """select doc_id as key, len(list_filter(regexp_split_to_array(text, '[\\t-\\r ]+'), lambda w: w <> '')) * 2
             + case when doc_id % 3 = 0 then 30 else 34 end as words from documents"""))
def descriptions(spark, sf):
    h = list(va.DESCRIPTION_HEADERS)
    m = doc() % 3

    def written(headers):
        pieces = []
        for i, head in enumerate(headers):
            pieces += [f"\n{head}\n", F.col("text") if i in (0, 3) else F.lit("")]
        return texts(*pieces)

    text = F.when(m == 0, written(h[:5])).when(m == 1, written(h)).otherwise(written(h[1:] + h[:1]))
    docs = v.table(spark, sf, "documents").select("doc_id", text.alias("description"))
    return slim(va.description_checks(docs, "doc_id", "description"))

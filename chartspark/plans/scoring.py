"""Queries: batch scoring with stand-in models whose replies follow from the prompt."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from chartspark.functions import prompts as pr
from chartspark.operators import evaluation as ev
from chartspark.operators import replies as rp
from chartspark.operators import scoring as sc
from chartspark.operators.columns import evaluation_rows
from chartspark.plans import views as v
from chartspark.plans.registry import register
from chartspark.session import scratch_dir

FAST = {"sleep": 0.0, "tries": 2}


def section(prompt: str, heading: str, following: str | None = None) -> str:
    text = prompt.split(f"\n\n{heading}:\n", 1)[1]
    return text.split(f"\n\n{following}:\n", 1)[0] if following else text


def length_model():
    """Replies with the length of the prompt; refuses lengths that 7 divides."""

    def reply(prompts):
        if any(len(p) % 7 == 0 for p in prompts):
            raise ValueError("refused")
        return [{"text": str(len(p)), "input_tokens": len(p) // 4, "output_tokens": 1, "cost": len(p) / 1000} for p in prompts]

    return reply


@register("score0_batch", """
select conv_id, turn, case when length(text) % 7 <> 0 then cast(length(text) as varchar) end as reply,
       case when length(text) % 7 = 0 then 'refused' end as error,
       case when length(text) % 7 = 0 then 0 else length(text) // 4 end as input_tokens,
       case when length(text) % 7 = 0 then 0 else 1 end::bigint as output_tokens, 0::bigint as cached_tokens,
       round(case when length(text) % 7 = 0 then 0 else length(text) / 1000 end, 6) as cost
from conversations""")
def batch(spark, sf):
    rows = v.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    out = sc.score(rows, F.col("text"), length_model, **FAST)
    return out.select("conv_id", "turn", F.col("reply.text").alias("reply"), "reply.error", "reply.input_tokens", "reply.output_tokens",
                      "reply.cached_tokens", F.round("reply.cost", 6).alias("cost"))


def verdict_model():
    def one(prompt):
        data = json.loads(section(prompt, "METADATA"))
        return "<think>hm</think>```json\n" + json.dumps({"useful": data["n_chars"] % 2 == 0, "description": data["lang"]}) + "\n```"

    return lambda prompts: [one(p) for p in prompts]


def judged(spark, sf):
    docs = v.table(spark, sf, "documents")
    rows = docs.select("doc_id", F.to_json(F.struct("source", "lang", "n_chars")).alias("metadata"))
    return sc.useful_datasets(rows, "metadata", verdict_model, **FAST)


@register("score1_useful_datasets", "select doc_id, n_chars % 2 = 0 as useful, lang as clean_description from documents")
def useful_datasets(spark, sf):
    return judged(spark, sf).select("doc_id", "useful", "clean_description")


@register("flt5_keep_useful", "select doc_id, lang as clean_description from documents where n_chars % 2 = 0")
def keep_useful(spark, sf):
    return sc.keep_useful(judged(spark, sf)).select("doc_id", "clean_description")


def specs_model():
    def one(prompt):
        feature = section(prompt, "FEATURES", "DESCRIPTION")
        level = section(prompt, "CREATIVITY", "FEATURES")
        specs = [{"type": f"kind {i}", "features": [feature], "description": level} for i in range(10)]
        return "Here you are: " + json.dumps(specs) + " Done."

    return lambda prompts: [one(p) for p in prompts]


@register("score2_plot_specs", """
with u as (select doc_id, source, list_sort([""" + ", ".join(
    f"('0x' || left(md5('42-{i}-' || doc_id), 15))::bigint / 1152921504606846976.0::double" for i in range(5)) + """])[2] as c from documents)
select doc_id, printf('%.2f', c) as level, i as place, 'kind ' || i as type, source as feature from u, range(0, 10) r(i)""")
def plot_specs(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "source", "lang")
    out = sc.plot_specs(docs, "doc_id", "source", "lang", specs_model, **FAST)
    rows = out.select("doc_id", F.posexplode("specs").alias("place", "s"))
    return rows.select("doc_id", F.col("s.description").alias("level"), F.col("place").cast("long").alias("place"), "s.type", F.col("s.features")[0].alias("feature"))


def names_model():
    def one(prompt):
        names = json.loads(section(prompt, "FEATURES"))
        if section(prompt, "DESCRIPTION", "FEATURES") == "en":
            names = names[:1]
        return json.dumps([f"The {n}" for n in names])

    return lambda prompts: [one(p) for p in prompts]


@register("score3_renamed_features", """
select doc_id, case when lang = 'en' then source || ',' || lang else 'The ' || source || ',The ' || lang end as names from documents""")
def renamed_features(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "lang", F.array("source", "lang").alias("features"))
    out = sc.renamed_features(docs, "features", "lang", names_model, **FAST)
    return out.select("doc_id", F.array_join("new_names", ",").alias("names"))


def code_model():
    """Notes for a plan prompt; code that repeats the notes otherwise."""

    def one(prompt):
        spec = section(prompt, "CHART")
        if "\n\nPLAN:\n" not in prompt:
            return f"```json\nwatch {spec}\n```"
        return f"<think>a</think>```python\n# {section(prompt, 'PLAN', 'CHART')}\nplot({spec!r})\n```"

    return lambda prompts: [one(p) for p in prompts]


@register("score4_chart_code", """
select doc_id, 'watch ' || lang as plan, '# watch ' || lang || chr(10) || 'plot(''' || lang || ''')' as code from documents""")
def chart_code(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("string").alias("head"))
    return sc.chart_code(docs, "lang", "source", "head", code_model, **FAST).select("doc_id", "plan", "code")


def review_model():
    """Feedback on every code; a correction while the code is shorter than its limit."""

    def one(prompt):
        code = section(prompt, "CODE")
        limit = int(code.split(" ")[0])
        if limit == 0:
            return "no json"
        return json.dumps({"feedback": f"length {len(code)}", "correction": code.count("!") < limit - 1})

    return lambda prompts: [one(p) for p in prompts]


def recode_model():
    """One more mark per correction; refuses codes of limit 4."""

    def one(prompt):
        code = section(prompt, "CODE")
        if code.startswith("4"):
            raise ValueError("cannot")
        return code + "!"

    return lambda prompts: [one(p) for p in prompts]


def drafts(spark, sf):
    docs = v.table(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("chart_id"), F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit("_it0.png")).alias("image"),
        F.concat((F.col("doc_id") % 7).cast("string"), F.lit(" "), "lang").alias("code"),
        F.col("lang").alias("spec"), F.col("source").alias("features"), F.lit("[]").alias("head"),
    )


@register("score5_review", """
select doc_id as chart_id, case when doc_id % 7 > 0 then 'length ' || (length(lang) + 2) end as feedback,
       case when doc_id % 7 > 0 then doc_id % 7 > 1 end as correction from documents""")
def review(spark, sf):
    return sc.reviewed(drafts(spark, sf), "image", "code", review_model, **FAST).select("chart_id", "feedback", "correction")


@register("score6_recode", """
select doc_id as chart_id, case when doc_id % 7 <> 4 then (doc_id % 7) || ' ' || lang || '!' end as new_code,
       case when doc_id % 7 = 4 then 'cannot' end as error from documents""")
def recode(spark, sf):
    rows = drafts(spark, sf).withColumn("feedback", F.lit("shorter"))
    out = sc.recoded(rows, "spec", "code", "feedback", "features", "head", recode_model, **FAST)
    return out.select("chart_id", "new_code", F.col("reply.error").alias("error"))


@register("score13_refinement", """
with c as (select doc_id as chart_id, doc_id % 7 as m, lang from documents),
r as (select *, unnest(range(0, case when m <= 1 then 1 when m = 4 then 4 else least(m, 4) end)) as round from c)
select chart_id, cast(round as integer) as round, 'images/' || chart_id || '_it' || round || '.png' as image,
       m || ' ' || lang || case when m = 4 then '' else repeat('!', round) end as code,
       case when m > 0 then 'length ' || (length(lang) + 2 + case when m = 4 then 0 else round end) end as feedback,
       case when m > 0 then case when m = 4 then true else round < m - 1 end end as correction, null::varchar as error from r""")
def refinement(spark, sf):
    return sc.refined(drafts(spark, sf), review_model, recode_model, **FAST)


def echo_model():
    """Replies with the last section of the prompt."""
    return lambda prompts: [p.rsplit("\n\nCHART:\n", 1)[1] for p in prompts]


@register("score7_descriptions", "select doc_id, text as full_description from documents")
def descriptions(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "lang", "source", "text", F.lit("{}").alias("data"))
    return sc.described(docs, ["lang", "source", "data", "data", "lang", "text"], echo_model, **FAST).select("doc_id", "full_description")


def question_model():
    def one(prompt):
        subject = section(prompt, "DATASET", "DESCRIPTION")
        return json.dumps([{"question": f"q{i} {subject}", "answer": str(i), "answer_basis": "both" if i % 2 else "image"} for i in range(20)])

    return lambda prompts: [one(p) for p in prompts]


@register("score8_questions", """
select doc_id, i as pos, 'q' || i || ' ' || source as question, cast(i as varchar) as answer, case when i % 2 = 1 then 'both' else 'image' end as answer_basis
from documents, range(0, 20) r(i)""")
def questions(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "lang", "source", F.lit("{}").alias("data"))
    out = sc.asked(docs, "lang", "source", "lang", "data", question_model, **FAST).select("doc_id", F.posexplode("questions").alias("pos", "q"))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "q.*")


def label_model():
    """The first time one label too few for odd lists; the retry asks for the right length."""

    def one(prompt):
        listed = json.loads(section(prompt, "QUESTIONS"))
        n = len(listed)
        if "\n\nLENGTH:\n" not in prompt and n % 2 == 1:
            n -= 1
        if n == 4:
            n = 5
        return json.dumps(["trends"] * n)

    return lambda prompts: [one(p) for p in prompts]


@register("score9_question_types", """
select doc_id, case when doc_id % 4 = 3 then null else doc_id % 4 + 1 end as labels,
       cast(case when doc_id % 4 in (0, 2, 3) then 2 else 1 end as integer) as rounds from documents""")
def question_types(spark, sf):
    records = v.records_v(spark, sf).select(F.col("id").cast("long").alias("doc_id"), F.col("graph.questions.question").alias("questions"))
    out = sc.typed_questions(records, "questions", label_model, rounds=2, **FAST)
    return out.select("doc_id", F.nullif(F.size("labels"), F.lit(-1)).cast("long").alias("labels"), "rounds")


def answer_model():
    """The last word of the data set text, with its usage; refuses question q3."""

    def one(prompt):
        question = section(prompt, "QUESTION")
        if question == "q3":
            raise ValueError("refused")
        known = section(prompt, "IMAGE", "QUESTION") if "\n\nIMAGE:\n" in prompt else ""
        return {"text": f"<think>x</think> {question} {known}", "input_tokens": len(prompt) // 4, "output_tokens": 2, "cached_tokens": 1, "cost": 0.5}

    return lambda prompts: [one(p) for p in prompts]


def grade_model():
    """true for an answer to q0, false for q1, something else otherwise."""

    def one(prompt):
        answer = section(prompt, "GIVEN ANSWER")
        return {"text": {"q0": " TRUE", "q1": "false\n"}.get(answer[:2], "maybe"), "input_tokens": 4, "output_tokens": 1, "cost": 0.25}

    return lambda prompts: [one(p) for p in prompts]


def question_rows(spark, sf):
    return evaluation_rows(v.records_v(spark, sf))


@register("score10_answers_offline", v.ctes(v.REC_QUESTIONS) + """
select cast(chart_id as varchar) as graph_id, cast(pos as integer) as pos, case when question <> 'q3' then question end as test_answer,
       case when question = 'q3' then 'refused' end as answer_error from rec_questions""")
def answers_offline(spark, sf):
    out = sc.answered(question_rows(spark, sf), answer_model, **FAST)
    return out.select("graph_id", "pos", "test_answer", "answer_error")


ONLINE = v.ctes(v.REC_QUESTIONS) + """, a as (
  select cast(chart_id as varchar) as graph_id, cast(pos as integer) as pos, question, dataset_id,
         case when chart_id % 5 > 0 then 'images/' || chart_id || '_it' || (chart_id % 5 - 1) || '.png' end as image from rec_questions),
e as (select *, case when question <> 'q3' then trim(question || ' ' || coalesce(image, '')) end as test_answer,
             case when question = 'q3' then 'refused' end as answer_error,
             case question when 'q0' then true when 'q1' then false end as correct from a)
"""


@register("score12_evaluation", ONLINE + "select graph_id, pos, test_answer, answer_error, correct, null::varchar as check_error from e")
def evaluation(spark, sf):
    out = sc.evaluated(question_rows(spark, sf), answer_model, grade_model, online=True, order=["pos"], **FAST)
    return out.select("graph_id", "pos", "test_answer", "answer_error", "correct", "check_error")


@register("score12_accuracy", ONLINE + """
select 'stub' as model, t.type, count(*) filter (where e.correct and (t.type = 'full' or t.pos = e.pos)) as correct,
       count(*) filter (where not e.correct and (t.type = 'full' or t.pos = e.pos)) as incorrect
from e cross join (values (0, 'metadata'), (1, 'value extraction'), (2, 'comparison'), (3, 'trends'), (4, 'reasoning'), (9, 'full')) t(pos, type) group by 2""")
def accuracy(spark, sf):
    out = sc.evaluated(question_rows(spark, sf), answer_model, grade_model, online=True, order=["pos"], **FAST)
    rows = out.select(F.lit("stub").alias("model"), F.col("question.type").alias("qtype"), "correct")
    return ev.accuracy_by_type(rows).drop("accuracy")


@register("score12_usage", ONLINE + """
select 'answer' as phase, cast(2 * count(*) filter (where question <> 'q3') as bigint) as output_tokens_total,
       cast(count(*) filter (where question <> 'q3') as bigint) as cached_tokens_total, 0.5::double * count(*) filter (where question <> 'q3') as cost_total from e
union all select 'check', count(*), 0, 0.25::double * count(*) from e""")
def usage(spark, sf):
    out = sc.evaluated(question_rows(spark, sf), answer_model, grade_model, online=True, order=["pos"], **FAST)
    return ev.usage_totals(sc.usage_rows(out), ["phase"], ["output_tokens", "cached_tokens", "cost"])


@register("score11_grading_prompts", """
select doc_id, lang = source as same, length(text) + length(lang) + length(source) as chars from documents""")
def grading_prompts(spark, sf):
    empty = pr.grade(F.lit(""), F.lit(""), F.lit(""), F.lit(""))
    prompt = pr.grade(F.col("text"), F.lit(""), F.col("lang"), F.col("source"))
    return v.table(spark, sf, "documents").select(
        "doc_id", (F.col("lang") == F.col("source")).alias("same"), (F.length(prompt) - F.length(empty)).cast("long").alias("chars"))


def stubborn_model():
    """Succeeds from the try on that the prompt names."""
    return lambda prompts: ["good" if int(p.split(" ")[0]) <= int(p.split(" ")[1]) else "bad" for p in prompts]


@register("score14_retries", """
select doc_id, 'good' as outcome, cast(doc_id % 5 + 1 as integer) as attempt from documents where doc_id % 5 < 3""")
def retries(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 5 + 1).alias("needs"))

    def attempt(rows, number):
        prompt = F.concat_ws(" ", F.col("needs").cast("string"), F.lit(str(number)))
        return sc.score(rows, prompt, stubborn_model, **FAST).select("doc_id", "needs", F.col("reply.text").alias("outcome"))

    return sc.with_retries(docs, "doc_id", attempt, F.col("outcome") == "good").select("doc_id", "outcome", "attempt")


def run_model(run: int, fails: int):
    """A model that names its run, and that refuses texts whose length `fails` divides."""

    def factory():
        def reply(prompts):
            if any(fails and len(p) % fails == 0 for p in prompts):
                raise ValueError("refused")
            return [{"text": f"{run}:{len(p)}", "input_tokens": 1} for p in prompts]

        return reply

    return factory


@register("score15_resumed", """
select conv_id, turn, case when length(text) % 3 = 0 then '2:' else '1:' end || length(text) as reply, cast(1 as bigint) as answers, true as only_open_asked
from conversations""")
def resumed(spark, sf):
    """A run whose model fails for a third of the prompts, then a second run over the same store: `answers` counts the stored replies of a prompt."""
    rows = v.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    path = scratch_dir(spark, "replies")
    first = sc.stored(sc.score(rows, F.col("text"), run_model(1, 3), store=path, model="m", **FAST), "first")
    answered = first.where(F.col("reply.error").isNull()).select(rp.request_key(F.col("text"), "m").alias("key")).distinct()
    out = sc.stored(sc.score(rows, F.col("text"), run_model(2, 0), store=path, model="m", **FAST), "second")
    kept = spark.read.parquet(path).where(F.col("reply.error").isNull())
    counts = kept.groupBy("key").agg(F.count(F.lit(1)).alias("answers"), F.bool_or(F.col("reply.text").startswith("2:")).alias("asked_again"))
    counts = counts.join(answered.withColumn("old", F.lit(True)), "key", "left")
    checked = out.withColumn("key", rp.request_key(F.col("text"), "m")).join(counts, "key")
    return checked.select("conv_id", "turn", F.col("reply.text").alias("reply"), "answers",
                          (F.col("asked_again") != F.coalesce("old", F.lit(False))).alias("only_open_asked"))


@register("score16_two_waves", ONLINE + """
select graph_id, pos, test_answer, answer_error, cast(case when pos = 0 then 0 else 1 end as integer) as wave from e""")
def two_waves(spark, sf):
    """Every chart is a prefix of its own: its first question is asked in the first wave, the others when all of those are stored."""
    rows = question_rows(spark, sf).withColumn("dataset_id", F.concat_ws("-", "dataset_id", "graph_id"))
    return sc.answered(rows, answer_model, online=True, order=["pos"], **FAST).select("graph_id", "pos", "test_answer", "answer_error", "wave")


@register("score16_prefixes", ONLINE + """
select dataset_id, image, cast(least(count(*), 1) as bigint) as cold, cast(count(*) - 1 as bigint) as warm from e group by 1, 2""")
def prefixes(spark, sf):
    """One cold question for each data set and image, however many charts share them."""
    out = sc.answered(question_rows(spark, sf), answer_model, online=True, order=["pos", "graph_id"], **FAST)
    return out.groupBy("dataset_id", "image").agg(F.count_if(F.col("wave") == 0).alias("cold"), F.count_if(F.col("wave") == 1).alias("warm"))


@register("score12_resumed_evaluation", ONLINE + "select graph_id, pos, test_answer, answer_error, correct from e")
def resumed_evaluation(spark, sf):
    """Both phases over a store: the second run reads all its replies there, as its models would answer otherwise."""
    path = scratch_dir(spark, "evaluation")
    rows = question_rows(spark, sf)
    options = FAST | {"online": True, "order": ["pos", "graph_id"], "store": path}
    sc.stored(sc.evaluated(rows, answer_model, grade_model, **options), "evaluated")
    out = sc.evaluated(rows, other_model, other_model, **options)
    return out.select("graph_id", "pos", "test_answer", "answer_error", "correct")


def other_model():
    """Refuses q3 like `answer_model`; any other prompt fails the query."""

    def reply(prompts):
        if any(p.rstrip().endswith("QUESTION:\nq3") for p in prompts):
            raise ValueError("refused")
        raise RuntimeError("asked twice")

    return reply

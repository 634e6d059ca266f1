"""Score a prompt column with a user's model, and the jobs built on it.

`factory()` is called once per task and returns the model: a function from a list of prompts
to a list of replies. A reply is a text, or a dict with `text` and any of input_tokens,
output_tokens, cached_tokens, cost.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from chartspark.functions import prompts as pr
from chartspark.functions.text import prompt_key, verdict
from chartspark.operators.replies import REPLY, ask_once, in_waves, replies_of_rows
from chartspark.operators.runs import flat, numbered, with_values
from chartspark.operators.sampling import creativity
from chartspark.operators.validate import LABEL_TRIES
from chartspark.session import scratch_dir, set_small_batches

Model = Callable[[list[str]], list]

COUNTS = ("input_tokens", "output_tokens", "cached_tokens")

# Batch size, tries, seconds of back-off, rounds of refinement, tries per spec.
BATCH = 32
TRIES = 3
SLEEP = 2.0
MAX_ROUNDS = 3
SPEC_TRIES = 3


def _ask(model: Model, batch: list[str], tries: int, sleep: float) -> list:
    for attempt in range(tries):
        try:
            replies = list(model(batch))
            if len(replies) != len(batch):
                raise ValueError(f"{len(replies)} replies to {len(batch)} prompts")
            return replies
        except Exception:
            if attempt == tries - 1:
                raise
            time.sleep(sleep * (attempt + 1))
    raise ValueError("no tries")


def _row(reply) -> dict:
    given = reply if isinstance(reply, dict) else {"text": reply}
    row = {"text": given.get("text"), "error": None, "cost": float(given.get("cost") or 0.0)}
    return row | {c: int(given.get(c) or 0) for c in COUNTS}


def _failed(error: Exception) -> dict:
    return {"text": None, "error": str(error), "cost": 0.0} | {c: 0 for c in COUNTS}


def replies_udf(factory: Callable[[], Model], batch_size: int = BATCH, tries: int = TRIES, sleep: float = SLEEP, strict: bool = False):
    """Batches keep their order. A batch that fails to the end gets null texts and its error.

    Only a ValueError, which blames a prompt (refused input, a wrong number of replies), makes each
    prompt of the batch be tried alone; a dead server is not asked again for every prompt. With
    `strict`, a dead server fails the task instead.
    """

    def run(chunks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for chunk in chunks:
            rows = []
            prompts = list(chunk)
            for start in range(0, len(prompts), batch_size):
                batch = prompts[start:start + batch_size]
                try:
                    rows += [_row(r) for r in _ask(model, batch, tries, sleep)]
                except Exception as whole:
                    if not isinstance(whole, ValueError):
                        if strict:
                            raise
                        rows += [_failed(whole)] * len(batch)
                        continue
                    for prompt in batch:
                        try:
                            rows.append(_row(_ask(model, [prompt], tries, sleep)[0]))
                        except Exception as error:
                            rows.append(_failed(error))
            yield pd.DataFrame(rows, columns=["text", "error", *COUNTS, "cost"])

    return pandas_udf(run, REPLY).asNondeterministic()


def score(df: DataFrame, prompt: Column, factory: Callable[[], Model], out: str = "reply", tasks: int | None = None,
          store: str | None = None, model: str = "", per_task: int = 1000, **options) -> DataFrame:
    """Add `out`: struct(text, error, tokens, cost). Only the prompt travels to Python.

    `tasks` spreads the rows over that many tasks first, for models slower than the scan. With `store`, a shared folder, replies of
    `model` are kept there task by task and looked up first: a job that died goes on where it was, and equal prompts are asked once.
    Prompts may be long and come in batches by rows, so batches are cut by bytes as well, for the whole session: the caller runs the plan.
    """
    set_small_batches(df.sparkSession)
    if store:
        return ask_once(df, prompt, model, store, _asks(factory, **options), out, per_task)
    rows = df.repartition(tasks) if tasks else df
    return rows.withColumn(out, replies_udf(factory, **options)(prompt))


def _asks(factory: Callable[[], Model], **options) -> Callable[[DataFrame], DataFrame]:
    def ask(prompts: DataFrame) -> DataFrame:
        return prompts.select("key", replies_udf(factory, **options)(F.col("prompt")).alias("reply"))

    return ask


def _kept_replies(rows: DataFrame, prompt: Column, factory: Callable[[], Model], store: str, model: str = "", per_task: int = 1000, tasks: int | None = None,
                  prefix: Column | None = None, order: Sequence[str] = (), **options) -> DataFrame:
    """`(row, wave, reply)` of `numbered` rows, as `score` with a store asks for them."""
    set_small_batches(rows.sparkSession)
    return replies_of_rows(rows, prompt, model, store, _asks(factory, **options), per_task, prefix, order)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a scored table to the shared folder and read it back.

    A lost executor then costs no second model call, and later stages start from files.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def useful_datasets(df: DataFrame, metadata: str, factory, **options) -> DataFrame:
    """Add `useful` and `clean_description` from the model's verdict on the dataset."""
    scored = score(df, pr.usefulness(F.col(metadata)), factory, **options)
    parsed = scored.withColumn("_p", pr.parsed_object(F.col("reply.text")))
    return parsed.withColumns({
        "useful": F.try_variant_get("_p", "$.useful", "boolean"),
        "clean_description": F.try_variant_get("_p", "$.description", "string"),
    }).drop("_p")


def keep_useful(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("useful", F.lit(False)))


def plot_specs(df: DataFrame, key: str, features: str, description: str, factory, seed: int = 42, **options) -> DataFrame:
    """Add `creativity` and `specs`: array<struct(type, features, description)>, null when unreadable."""
    drawn = df.withColumn("creativity", creativity(seed, F.col(key)))
    prompt = pr.plot_specs(F.col(features), F.col(description), F.col("creativity"))
    scored = score(drawn, prompt, factory, **options)
    kind = "struct<type:string,features:array<string>,description:string>"
    return scored.withColumn("specs", pr.parsed_array(F.col("reply.text"), kind))


def renamed_features(df: DataFrame, features: str, description: str, factory, **options) -> DataFrame:
    """Add `new_names`; the old names where the reply has another length."""
    scored = score(df, pr.new_names(F.to_json(F.col(features)), F.col(description)), factory, **options)
    names = pr.parsed_array(F.col("reply.text"), "string")
    fits = F.coalesce(F.size(names) == F.size(features), F.lit(False))
    return scored.withColumn("new_names", F.when(fits, names).otherwise(F.col(features)))


def chart_code(df: DataFrame, spec: str, features: str, head: str, factory, **options) -> DataFrame:
    """Two chained calls: notes on the chart, then its code."""
    cols = [F.col(spec), F.col(features), F.col(head)]
    planned = score(df, pr.chart_plan(*cols), factory, "plan_reply", **options)
    planned = planned.withColumn("plan", pr.parsed_code(F.col("plan_reply.text"))).drop("plan_reply")
    coded = score(planned, pr.chart_code(*cols, F.col("plan")), factory, **options)
    return coded.withColumn("code", pr.parsed_code(F.col("reply.text")))


def reviewed(df: DataFrame, image: str, code: str, factory, **options) -> DataFrame:
    """Add `feedback` and `correction`; both null when the reply is unreadable."""
    scored = score(df, pr.review(F.col(image), F.col(code)), factory, **options)
    parsed = scored.withColumn("_p", pr.parsed_object(F.col("reply.text")))
    return parsed.withColumns({
        "feedback": F.try_variant_get("_p", "$.feedback", "string"),
        "correction": F.try_variant_get("_p", "$.correction", "boolean"),
    }).drop("_p")


def recoded(df: DataFrame, spec: str, code: str, feedback: str, features: str, head: str, factory, **options) -> DataFrame:
    """Add `new_code` written after feedback; null when the call failed."""
    prompt = pr.new_code(*[F.col(c) for c in (spec, code, feedback, features, head)])
    return score(df, prompt, factory, **options).withColumn("new_code", pr.parsed_code(F.col("reply.text")))


def described(df: DataFrame, columns: Sequence[str], factory, **options) -> DataFrame:
    """Add `full_description`; columns: image, code, graph_data, preview rows, dataset, chart."""
    scored = score(df, pr.long_description(*[F.col(c) for c in columns]), factory, **options)
    return scored.withColumn("full_description", pr.after_reasoning(F.col("reply.text"))["answer"])


def asked(df: DataFrame, image: str, dataset: str, description: str, graph_data: str, factory, **options) -> DataFrame:
    """Add `questions`: array<struct(question, answer, answer_basis)>."""
    scored = score(df, pr.questions(*[F.col(c) for c in (image, dataset, description, graph_data)]), factory, **options)
    kind = "struct<question:string,answer:string,answer_basis:string>"
    return scored.withColumn("questions", pr.parsed_array(F.col("reply.text"), kind))


def typed_questions(df: DataFrame, questions: str, factory, rounds: int = LABEL_TRIES + 1, **options) -> DataFrame:
    """Add `labels`, one per question; charts whose reply has another length are asked again.

    Each round keeps the fitting rows and asks only for the rest, telling it the wanted and
    the previous length. What never fits gets null labels.
    """
    todo = df.withColumn("_before", F.lit(0))
    done = None
    for number in range(rounds):
        listed = F.to_json(F.col(questions))
        prompt = pr.question_types(listed) if number == 0 else pr.question_types(listed, F.size(questions), F.col("_before"))
        scored = score(todo, prompt, factory, **options).withColumn("labels", pr.parsed_array(F.col("reply.text"), "string"))
        scored = stored(scored.drop("reply"), f"labels-{number}")
        fits = F.coalesce(F.size("labels") == F.size(questions), F.lit(False))
        good = scored.where(fits).withColumn("rounds", F.lit(number + 1)).drop("_before")
        done = good if done is None else done.unionByName(good)
        todo = scored.where(~fits).withColumn("_before", F.coalesce(F.size("labels"), F.lit(0))).drop("labels")
        if todo.isEmpty():
            return done
    left = todo.drop("_before").withColumns({"labels": F.lit(None).cast("array<string>"), "rounds": F.lit(rounds)})
    return done.unionByName(left)


def _answer_prompt(online: bool) -> Column:
    dataset, question = F.col("dataset_description"), F.col("question.question")
    return pr.answer_online(dataset, F.col("image"), question) if online else pr.answer_offline(dataset, question)


def _answer_columns(reply: Column) -> dict[str, Column]:
    return {"test_answer": F.trim(pr.parsed_answer(reply["text"])), "answer_error": reply["error"], "answer_usage": reply}


def _check_prompt() -> Column:
    return pr.grade(F.col("dataset_description"), F.col("question.question"), F.col("question.answer"), F.col("test_answer"))


def _check_columns(reply: Column) -> dict[str, Column]:
    return {"correct": verdict(pr.parsed_answer(reply["text"])), "check_error": reply["error"], "check_usage": reply}


def _with_prefix(rows: DataFrame, online: bool, order: Sequence[str]) -> tuple[DataFrame, Column | None]:
    """Online rows with `prompt_key`, and what their prompts begin with. Rows without an image share no key, but the prefix of their data set."""
    if not online:
        return rows, None
    if not order:
        raise ValueError("online answering needs columns that tell the questions of one chart apart")
    return rows.withColumn("prompt_key", prompt_key(F.col("dataset_id"), F.col("image"))), F.to_json(F.struct("dataset_id", F.col("image").alias("image")))


def _with_answers(rows: DataFrame, factory, prefix: Column | None, order: Sequence[str], **options) -> DataFrame:
    """`numbered` rows and, as the struct `_answer`, what `answered` adds, with replies from a store."""
    replies = _kept_replies(rows, _answer_prompt(prefix is not None), factory, prefix=prefix, order=order, **options)
    columns = [c.alias(name) for name, c in _answer_columns(F.col("reply")).items()]
    return with_values(rows, replies.select("row", *(["wave"] if prefix is not None else []), *columns), "_answer")


def answered(rows: DataFrame, factory, online: bool = False, order: Sequence[str] = (), **options) -> DataFrame:
    """Add `test_answer`, `answer_error` and usage for every question row.

    Online rows are asked in two waves: the first question of every prompt prefix, which warms a server's cache, and when all of those are
    stored the others (`wave` 0 and 1). They are spread by prompt prefix and sorted inside a task, so that a server sees
    the questions of one chart in a row; `order`, required then, splits a chart with very many questions. With a `store`, rows
    keep their places and neighbours are asked by the same task.
    """
    marked, prefix = _with_prefix(rows, online, order)
    if options.get("store"):
        return flat(_with_answers(numbered(marked, "answered"), factory, prefix, order, **options)).drop("_row")

    def ask(part: DataFrame) -> DataFrame:
        if online:
            part = part.repartitionByRange("prompt_key", *order).sortWithinPartitions("prompt_key", *order)
        scored = score(part, _answer_prompt(online), factory, **options)
        return scored.withColumns(_answer_columns(F.col("reply"))).drop("reply")

    return in_waves(marked, prefix, order, ask, stored) if online else ask(marked)


def graded(rows: DataFrame, factory, **options) -> DataFrame:
    """Add `correct` (true, false or null), `check_error` and usage."""
    return score(rows, _check_prompt(), factory, **options).withColumns(_check_columns(F.col("reply"))).drop("reply")


def evaluated(rows: DataFrame, answer_factory, check_factory, online: bool = False, order: Sequence[str] = (), store: str | None = None, **options) -> DataFrame:
    """Answer all questions, store the answers, then grade them. With `store`, both phases go on where an earlier run died, and
    the rows are stored once for both; answers and verdicts are joined to them by number."""
    if not store:
        return graded(stored(answered(rows, answer_factory, online, order, **options), "answers"), check_factory, **options)
    marked, prefix = _with_prefix(rows, online, order)
    answers = _with_answers(numbered(marked, "evaluated"), answer_factory, prefix, order, store=f"{store}/answer", **options)
    checks = _kept_replies(answers, _check_prompt(), check_factory, store=f"{store}/check", **options)
    columns = [c.alias(name) for name, c in _check_columns(F.col("reply")).items()]
    return flat(with_values(answers, checks.select("row", *columns), "_check")).drop("_row")


def usage_rows(evaluated_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Token and cost counts per row and phase, long form, ready for `usage_totals`."""
    phases = [F.struct(F.lit(p).alias("phase"), *[F.col(f"{p}_usage.{c}").alias(c) for c in (*COUNTS, "cost")]) for p in ("answer", "check")]
    return evaluated_rows.select(*by, F.inline(F.array(*phases)))


def refined(charts: DataFrame, review_factory, code_factory, key: str = "chart_id", max_rounds: int = MAX_ROUNDS, **options) -> DataFrame:
    """Review and re-code charts until no correction is needed; at most `max_rounds` re-codings.

    `charts` has key, image, code, spec, features, head. Returns one row per review: key,
    round, image, code, feedback, correction, error. An unreadable review ends the chart; a
    failed re-coding keeps the code and uses up a round. Each round is written to the shared
    folder, so plans stay short and no model call is repeated.
    """
    active = charts.withColumn("round", F.lit(0))
    history = None
    for number in range(max_rounds + 1):
        image = F.regexp_replace("image", r"_it\d+(\.[^./]*)$", f"_it{number}$1") if number else F.col("image")
        seen = reviewed(active.withColumn("image", image), "image", "code", review_factory, **options)
        seen = stored(seen.withColumn("error", F.col("reply.error")).drop("reply"), f"review-{number}")
        rows = seen.select(key, "round", "image", "code", "feedback", "correction", "error")
        history = rows if history is None else history.unionByName(rows)
        again = seen.where("correction")
        if number == max_rounds or again.isEmpty():
            break
        fixed = recoded(again, "spec", "code", "feedback", "features", "head", code_factory, **options)
        fixed = stored(fixed.drop("reply"), f"recode-{number}")
        active = fixed.withColumns({"code": F.coalesce("new_code", "code"), "round": F.lit(number + 1)}).drop(
            "new_code", "feedback", "correction", "error")
    return history


def with_retries(df: DataFrame, key: str, attempt: Callable[[DataFrame, int], DataFrame], ok: Column, tries: int = SPEC_TRIES) -> DataFrame:
    """Run `attempt` on the rows without success so far, up to `tries` times; add `attempt` number.

    Rows that never succeed are left out, as a chart that fails three times is skipped.
    """
    todo, done = df, None
    for number in range(1, tries + 1):
        tried = stored(attempt(todo, number), f"attempt-{number}")
        good = tried.where(ok).withColumn("attempt", F.lit(number))
        done = good if done is None else done.unionByName(good)
        todo = todo.join(good.select(key), key, "left_anti")
        if number < tries and todo.isEmpty():
            break
    return done

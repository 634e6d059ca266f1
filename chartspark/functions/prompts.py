"""Prompt texts as expressions. The data stands last, after its own heading line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartspark.functions.text import array_slice, after_reasoning, drop_json_fences, split_reasoning, strip_fences
from chartspark.operators.evaluation import QUESTION_TYPES
from chartspark.operators.validate import DESCRIPTION_HEADERS, MAX_GRID, MAX_WORDS, N_QUESTIONS, N_SPECS


def sections(task: str, **parts: Column) -> Column:
    """Task, then each part under its heading; a missing part is empty."""
    pieces = [F.lit(task)]
    for heading, value in parts.items():
        pieces += [F.lit(f"\n\n{heading.upper().replace('_', ' ')}:\n"), F.coalesce(value, F.lit(""))]
    return F.concat(*pieces)


def usefulness(metadata: Column) -> Column:
    task = ("Judge strictly whether charts of this table would mean something, and restate its description without "
            'names of authors. Answer with one JSON object: {"useful": true or false, "description": text}.')
    return sections(task, metadata=metadata)


def plot_specs(features: Column, description: Column, creativity: Column) -> Column:
    task = (f"Propose exactly {N_SPECS} different charts of this table, plain and advanced ones, each with features that exist "
            f"below and at most {MAX_GRID} panels per row and column. Answer with a JSON array of objects with the keys "
            "type, features, description. Creativity runs from 0 (standard) to 1 (unusual).")
    return sections(task, creativity=F.format_number(creativity, 2), features=features, description=description)


def new_names(features: Column, description: Column) -> Column:
    task = ("Give every feature a name that explains itself on a chart axis, using the description only. Keep number and "
            "order; keep a name when unsure. Answer with a JSON array of texts.")
    return sections(task, description=description, features=features)


def chart_plan(spec: Column, features: Column, head: Column) -> Column:
    task = 'Note in 100 to 150 words what the author of this chart should watch. Answer with {"notes": text}.'
    return sections(task, features=features, head=head, chart=spec)


def chart_code(spec: Column, features: Column, head: Column, plan: Column) -> Column:
    task = ("Write the code that draws this chart from the table `df`. Leave the plotted table in `graph_df` and its "
            "description in `graph_data`. Answer with code only.")
    return sections(task, features=features, head=head, plan=plan, chart=spec)


def review(image: Column, code: Column) -> Column:
    task = ("Name the faults that keep a reader from understanding this chart, each with a remedy; no praise, no change of "
            'chart kind. Answer with {"feedback": text, "correction": true or false}.')
    return sections(task, image=image, code=code)


def new_code(spec: Column, code: Column, feedback: Column, features: Column, head: Column) -> Column:
    task = "Correct the code so that the feedback is met. Change nothing else. Answer with code only."
    return sections(task, features=features, head=head, chart=spec, feedback=feedback, code=code)


def long_description(image: Column, code: Column, graph_data: Column, preview: Column, dataset: Column, chart: Column) -> Column:
    headers = " | ".join(DESCRIPTION_HEADERS)
    task = (f"Describe the chart in at most {MAX_WORDS} words of plain text under these headers: {headers}. State only what the "
            "image and the data show.")
    return sections(task, image=image, code=code, data=graph_data, rows=preview, dataset=dataset, chart=chart)


def questions(image: Column, dataset: Column, description: Column, graph_data: Column) -> Column:
    task = (f"Write exactly {N_QUESTIONS} questions that this chart alone answers: 7 easy, 6 medium, 7 hard. Answer with a JSON "
            'array of objects with the keys question, answer, answer_basis ("image" or "both").')
    return sections(task, image=image, dataset=dataset, description=description, data=graph_data)


def question_types(listed: Column, count: Column | None = None, previous: Column | None = None) -> Column:
    """With `count`, the retry wording: the wanted length and the length given before."""
    labels = ", ".join(QUESTION_TYPES)
    task = f"Give each question exactly one of the labels {labels}. Answer with a JSON array of labels, one per question."
    if count is None:
        return sections(task, questions=listed)
    note = F.concat(F.lit("The array must have "), count.cast("string"), F.lit(" labels; it had "), previous.cast("string"))
    return sections(task, length=note, questions=listed)


def answer_offline(dataset: Column, question: Column) -> Column:
    task = "You answer questions about charts briefly, in plain English, with the answer only."
    return sections(task, dataset=dataset, question=question)


def answer_online(dataset: Column, image: Column, question: Column) -> Column:
    """Same prefix for all questions of a chart, so that a server can reuse it."""
    task = "Answer the question about this chart and its data. Keep it brief; return only the answer."
    return sections(task, dataset=dataset, image=image, question=question)


def grade(dataset: Column, question: Column, truth: Column, answer: Column) -> Column:
    task = ("You grade an answer about a chart. Say true when it is close enough to the real answer, numbers included, "
            "else false. One word.")
    return sections(task, dataset=dataset, question=question, real_answer=truth, given_answer=answer)


def parsed_object(reply: Column) -> Column:
    """Reply without reasoning and fences, as a variant; null when it is no JSON."""
    return F.try_parse_json(drop_json_fences(after_reasoning(reply)["answer"]))


def parsed_array(reply: Column, element: str = "variant") -> Column:
    """The JSON array inside a reply, as an array of `element`; null when there is none."""
    return F.try_variant_get(F.try_parse_json(array_slice(after_reasoning(reply)["answer"])), "$", f"array<{element}>")


def parsed_code(reply: Column) -> Column:
    return strip_fences(after_reasoning(reply)["answer"])


def parsed_answer(reply: Column) -> Column:
    return split_reasoning(reply)["answer"]

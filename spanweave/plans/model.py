"""The seam for a language model, with deterministic behaviour without one.

A model is anything with `invoke(prompt) -> str`. A question's calls happen on the driver, one per step; descriptions of
entities are asked for in the tasks. Without a model every step has a rule."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions.text import INTENTS, default_description


class Model(Protocol):
    def invoke(self, prompt: str) -> str: ...


def classify(question: str, ruled: str, model: Model | None) -> str:
    """One of the four intents; `ruled` without a model or if its answer names none."""
    if model is None:
        return ruled
    said = model.invoke(f"Name the category of this question on code, one of {', '.join(INTENTS)}.\n{question}").lower()
    return next((k for k in INTENTS if k in said), ruled)


def expand(question: str, model: Model | None) -> str:
    """The question and the first line of the model's additions; the question alone without a model."""
    if model is None:
        return question
    first = (model.invoke(f"Add search words for this question on code, in one line.\n{question}").strip().split("\n") or [""])[0].strip()
    return f"{question} {first}" if first else question


def describe(entities: DataFrame, model: Model | None) -> DataFrame:
    """Entities with a description each. A model describes those without one, where they are: it goes to the tasks, so
    it must be picklable. What it says nothing of gets the default."""
    rows = entities
    if model is not None:
        kept = [c for c in entities.columns if c != "description"]
        todo = entities.where("description is null").select("id", "entity_type", "name", "snippet")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                said = [model.invoke(f"Describe in one sentence the {t} {n}:\n{(s or '')[:500]}").strip() for t, n, s in zip(*(b.column(c).to_pylist() for c in ("entity_type", "name", "snippet")))]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(said, pa.string())], names=["id", "said"])

        said = todo.mapInArrow(run, "id string, said string")
        rows = entities.join(said, "id", "left").select(*kept, F.coalesce("description", F.nullif("said", F.lit(""))).alias("description")).select(*entities.columns)
    return rows.withColumn("description", default_description(F.col("description"), F.col("entity_type"), F.col("name")))


def answer(question: str, context: str, model: Model | None) -> str:
    """The model's answer from the context; the context itself without a model."""
    return context if model is None else model.invoke(f"Answer from the context only.\n\nContext:\n{context}\n\nQuestion: {question}")


def rerank_order(question: str, texts: list[str], model: Model | None) -> list[int]:
    """The order of at most ten texts by a model's scores, falling, equal ones as they were; unchanged without a model
    or if it does not score every text."""
    plain = list(range(len(texts)))
    if model is None or not texts:
        return plain
    shown = "\n\n".join(f"Text {i}:\n{t[:500]}" for i, t in enumerate(texts[:10]))
    scores = [int(x) for x in re.findall(r"score\s*:\s*(\d+)", model.invoke(f"Give each text a line `Score: n` (0-10) for the question.\nQuestion: {question}\n\n{shown}"), re.I)]
    if len(scores) != len(texts[:10]):
        return plain
    return sorted(plain[:10], key=lambda i: (-scores[i], i)) + plain[10:]


#: What the scores of a verdict mean, by metric (lower case).
RUBRIC = {
    "relevance": "how much of it bears on the question", "completeness": "how much of the question it covers", "accuracy": "how far it agrees with the code", "faithfulness": "how far the context bears it out",
    "clarity": "how easily it is followed", "specificity": "how far it names files, functions and lines", "diversity": "how many different parts of the code it draws on",
}


def judge_answer(question: str, context: str, answered: str, metrics: list[str], model: Model) -> dict[str, int]:
    """A model's score of each metric; 0 where it gives none. With the context as what is judged, a retrieval is."""
    rubric = "\n".join(f"{m}: {RUBRIC.get(m.lower(), 'how good it is in this')}" for m in metrics)
    said = model.invoke(f"Score the answer from 1 (not at all) to 10 (wholly), one line `Metric (1-10): n` for each of {', '.join(metrics)}.\n{rubric}\nThen `Overall analysis:` and `Suggestions:` with a sentence each.\nQuestion: {question}\nContext: {context[:4000]}\nAnswer: {answered}")
    got = {m: re.search(rf"{re.escape(m)}\s*\(?1-10\)?\s*:\s*(\d+)", said, re.I) for m in metrics}
    return {m: int(x.group(1)) if x else 0 for m, x in got.items()}


#: What a verdict on an answer compares (fixed values).
COMPARED = ("accuracy", "completeness", "relevance", "specificity")


def answer_alone(question: str, model: Model | None) -> str | None:
    """The model's answer without any context; null without a model."""
    return None if model is None else model.invoke(f"Answer this question on code as well as you can, in detail.\n\nQuestion: {question}")


def compare(question: str, with_context: str, alone: str, model: Model, metrics: tuple[str, ...] = COMPARED) -> str:
    """A model's verdict on two answers, in the format that operators.judge reads."""
    wanted = "\n".join(f"{m}: RAG n, LLM n" for m in metrics)
    return model.invoke(f"Compare two answers, scores from 1 to 10, in these lines:\n{wanted}\nThen `RAG advantages:` and `LLM-only approach is enough:` with a sentence each.\n\nQuestion: {question}\n\nRAG answer: {with_context}\n\nLLM answer: {alone}")


def recommend(question: str, plan: str, model: Model | None) -> str:
    """A recommendation of changes from a change plan as text; the plan itself without a model."""
    if model is None:
        return plan
    form = "File: path (Lines a-b)\nBefore:\n```python\n...\n```\nAfter:\n```python\n...\n```\nExplanation: ..."
    return model.invoke(f"Recommend changes for the request. Keep to the code's patterns. Give each change in this form:\n{form}\n\n{plan}\n\nRequest: {question}")


def graph_query(question: str, model: Model | None) -> str | None:
    """A question as SQL over the views `nodes` and `edges`, if a model gives a single SELECT; else null."""
    if model is None:
        return None
    said = model.invoke(f"Write one Spark SQL SELECT over nodes(graph_id, id, labels, entity_type, name, source_file, start_line, end_line, description) and edges(graph_id, src, dst, rel_type).\nQuestion: {question}").strip()
    said = re.sub(r"^```\w*\s*|\s*```$", "", said).rstrip("; \n")
    return said if re.match(r"(?i)(select|with)\b", said) and ";" not in said else None

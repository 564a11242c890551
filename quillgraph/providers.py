"""Model-backed steps as interfaces, with replay of recorded answers, so that results are reproducible."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.answers import judgement
from quillgraph.functions.text import no_answer
from quillgraph.functions.vectors import jaro_winkler
from quillgraph.operators.extraction import person_context


class Extractor(Protocol):
    def answers(self, prompts: DataFrame) -> DataFrame:
        """``(key, answer)`` for ``(key, prompt)``."""


class Replay:
    """Recorded answers ``(key, answer)`` by key; keys without one get null."""

    def __init__(self, recorded: DataFrame):
        self.recorded = recorded.select("key", "answer").dropDuplicates(["key"])

    def answers(self, prompts: DataFrame) -> DataFrame:
        return prompts.select("key").join(self.recorded, "key", "left")


class Batched:
    """A model call on lists of prompts, made once per worker by ``load`` and run over Arrow batches."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[str]]]):
        self.load = load

    def answers(self, prompts: DataFrame) -> DataFrame:
        load = self.load

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = load()
            for f in frames:
                yield pd.DataFrame({"key": f["key"], "answer": call(f["prompt"].tolist())})

        return prompts.select("key", "prompt").mapInPandas(run, f"key {dict(prompts.dtypes)['key']}, answer string")


def hashed_vector(text: Column, size: int = 64) -> Column:
    """A deterministic unit vector of a text's words: each adds one at a place by its hash."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)))


def rule_judge(score: Column, a: Column, b: Column, threshold: float = 0.65, name_gate: float = 0.92) -> Column:
    """MATCH where the score passes and the names are alike."""
    return F.when((score >= threshold) & (jaro_winkler(a, b) >= name_gate), F.lit("MATCH")).otherwise(F.lit("NO_MATCH"))


def with_retries(generate: Callable[[str, list[str]], object], check: Callable[[object], list[str]], question: str, times: int = 3) -> tuple[object, list[str]]:
    """A generated pattern and its remaining problems; each try is told those of the one before."""
    problems: list[str] = []
    made = None
    for _ in range(times):
        made = generate(question, problems)
        problems = check(made)
        if not problems:
            break
    return made, problems


def judged_answers(items: DataFrame, judge: Extractor, output: str = "output", gold: str = "gold", question: str = "question") -> DataFrame:
    """``items(key, question, gold, output)`` with ``correct`` and ``reason``.

    A question without an answer that was answered so is right without a call; the
    judge sees only the others, whose answers are JSON. A failed call is wrong.
    """
    settled = no_answer(F.col(gold), F.col(output))
    prompt = F.concat(F.lit("Question: "), F.coalesce(question, F.lit("")), F.lit("\nExpected: "), F.coalesce(gold, F.lit("")), F.lit("\nGiven: "), F.coalesce(output, F.lit("")))
    asked = items.where(~settled).select("key", prompt.alias("prompt"))
    told = judge.answers(asked).select("key", judgement(F.col("answer")).alias("j"))
    out = items.join(told, "key", "left")
    return out.select(*items.columns, F.when(settled, F.lit(True)).otherwise(F.coalesce("j.correct", F.lit(False))).alias("correct"), F.when(settled, F.lit("both sides have no answer")).otherwise(F.col("j.reason")).alias("reason"))


def extraction_prompts(records: DataFrame, people: DataFrame, system: str) -> DataFrame:
    """``(key, prompt)`` of ``records(record, body)``: instructions, the people of the headers, and the body."""
    own = records.join(person_context(people), "record", "left")
    known = F.coalesce("context", F.lit("No persons in headers."))
    return own.select(F.col("record").alias("key"), F.concat(F.lit(system + "\n\n"), known, F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("prompt"))


def question_prompt(question: str, schema: str, paths: list[str], problems: list[str] = ()) -> str:
    """What a generator of graph patterns is asked: the schema, the valid paths, and what was wrong with its last try."""
    wrong = "\nThe last pattern was wrong: " + "; ".join(problems) if problems else ""
    return f"Schema:\n{schema}\nPaths:\n" + "\n".join(paths) + f"\nQuestion: {question}{wrong}"


class QueryGenerator(Protocol):
    def __call__(self, question: str, problems: list[str]) -> object:
        """A graph pattern for a question, given what was wrong with the last one."""


def answered(question: str, generate: QueryGenerator, check: Callable[[object], list[str]], run: Callable[[object], DataFrame], limit: int = 3000, rows: int = 1000) -> str:
    """A question's answer as text: the rows of its pattern as JSON, cut to ``limit`` characters; a pattern that stays wrong could not be extracted.

    Only as many rows are fetched as may appear in the text.
    """
    made, problems = with_retries(generate, check, question)
    if problems:
        return "could not be extracted"
    try:
        found = run(made).limit(rows).toJSON().collect()
    except Exception as e:  # whatever a generated pattern does wrong is its answer
        return f"error: {type(e).__name__}"
    text = "[" + ", ".join(found) + "]"
    return text if len(text) <= limit else text[:limit] + "... [truncated]"

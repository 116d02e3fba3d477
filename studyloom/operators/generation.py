"""Model-backed steps as jobs: a provider answers prompts in tasks with JSON; only answers of the exact shape are taken.

Citations come from stored rows, never from the provider's text. Every provider is a function from a prompt to its raw answer, made
once in each task. A prompt whose answer has not the expected shape is asked once more, with a note about the shape."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions.json_strict import strict_object
from studyloom.operators.batching import budget_batches
from studyloom.operators.citations import is_unique, numbers_within
from studyloom.plans.lineage import cut

#: Gives the raw answer to a prompt.
Provider = Callable[[str], str]
#: The shapes of answers.
TEXT = {"text": "string", "citation_numbers": "array<bigint>"}
VERDICT = {"verdict": "string", "score": "double", "feedback": "string", "missing_concepts": "array<string>"}


def first_sentences(text: Column, n: int = 1) -> Column:
    """The first n sentences of a text, the whole text if it has fewer: the deterministic provider's summary."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"(?s)[^.!?]+(?:[.!?]+|$)"), F.lit(0)), 1, n), "")


def asked(prompts: DataFrame, prompt: str, make_provider: Callable[[], Provider]) -> DataFrame:
    """prompts with raw, the provider's answer, or failure where it raised an error. The provider is made once for each task."""
    columns = prompts.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make_provider()
        for batch in batches:
            raw, failure = [], []
            for text in batch[prompt]:
                try:
                    raw.append(provider(text))
                    failure.append(None)
                except Exception as e:  # noqa: BLE001
                    raw.append(None)
                    failure.append(f"{type(e).__name__}: {e}")
            yield batch[columns].assign(raw=raw, failure=failure)

    return prompts.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in prompts.dtypes) + ", raw string, failure string")


def generate(prompts: DataFrame, prompt: str, make_provider: Callable[[], Provider], fields: dict[str, str], valid: Callable[[Column], Column] | None = None, name: str = "prompt") -> DataFrame:
    """prompts with answer (a struct of fields, null without a valid one), prompt_names (those used, in order) and problem.

    valid(answer) tells an answer of the right shape that is still not acceptable. What has no valid answer is asked once more
    with the shape as a note (a format repair); what fails again has a problem. Answers of provider errors are failures at once.
    Other columns are passed on; raw, failure, answer, problem and prompt_names are replaced."""
    base = prompts.drop("raw", "failure", "answer", "problem", "prompt_names")

    def judged(done: DataFrame) -> DataFrame:
        answer = strict_object(F.col("raw"), **fields)
        out = done.withColumn("answer", answer)
        return out if valid is None else out.withColumn("answer", F.when(valid(F.col("answer")), F.col("answer")))

    first = cut(judged(asked(base, prompt, make_provider)))
    again = F.col("answer").isNull() & F.col("failure").isNull()
    note = F.concat(F.col(prompt), F.lit("\n\nAnswer with one JSON object of exactly these keys: " + ", ".join(fields)))
    second = judged(asked(first.filter(again).drop("raw", "failure", "answer").withColumn("_prompt", F.col(prompt)).withColumn(prompt, note), prompt, make_provider))
    second = second.withColumn(prompt, F.col("_prompt")).drop("_prompt").withColumn("prompt_names", F.array(F.lit(name), F.lit("format_repair")))
    both = first.filter(~again).withColumn("prompt_names", F.array(F.lit(name))).unionByName(second)
    problem = F.when(F.col("failure").isNotNull(), F.col("failure")).when(F.col("answer").isNull(), "the answer has not the expected shape")
    return both.withColumn("problem", problem).drop("raw", "failure")


def is_cited_text(answer: Column) -> Column:
    """A text that isn't blank, with positive citation numbers, each once and at least one."""
    numbers = answer["citation_numbers"]
    return (F.trim(answer["text"]) != "") & (F.size(numbers) > 0) & F.forall(numbers, lambda n: n > 0) & is_unique(numbers)


def map_batches(chunks: DataFrame, document: str, order: str, text: str, budget: int) -> DataFrame:
    """Numbered contexts of each document packed into batches, and the prompt of each batch.

    Result: document, batch_number, first_number, last_number, prompt. A batch holds at most budget characters (or one chunk)."""
    sized = chunks.select(F.col(document).alias("document"), F.col(order).alias("at"), F.col(text).alias("text"), F.length(text).alias("size"))
    packed = budget_batches(sized, "document", ["at"], "size", budget)
    line = F.concat(F.lit("["), F.col("context_number"), F.lit("] "), F.col("text"))
    rows = packed.groupBy("document", "batch_number").agg(F.min("context_number").alias("first_number"), F.max("context_number").alias("last_number"), F.array_sort(F.collect_list(F.struct("context_number", line.alias("line")))).alias("lines"))
    return rows.withColumn("prompt", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n")).drop("lines")


def accept_batches(generated: DataFrame) -> DataFrame:
    """generated with is_valid: every cited number is one of the batch's own contexts, and there is at least one."""
    numbers = F.col("answer.citation_numbers")
    inside = numbers_within(numbers, F.col("first_number"), F.col("last_number"))
    return generated.withColumn("is_valid", F.coalesce(F.col("problem").isNull() & (F.size(numbers) > 0) & inside, F.lit(False)))


def misses(requested: DataFrame, stored: DataFrame, identity: list[str]) -> DataFrame:
    """The requests whose exact identity isn't stored: only they go on to a model."""
    return requested.join(stored.select(*identity).distinct(), identity, "left_anti")

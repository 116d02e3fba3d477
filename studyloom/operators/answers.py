"""Written answers: evaluated by a provider, rated, and recorded as attempts together with the review state they lead to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions.text import casefold, strip
from studyloom.operators.citations import is_unique
from studyloom.operators.generation import VERDICT, Provider, generate
from studyloom.operators.review import FRESH, advance, latest, review_fold
from studyloom.operators.store import put
from studyloom.plans.lineage import cut
from studyloom.plans.ordered_fold import ordered_fold


def is_evaluation(answer: Column) -> Column:
    """A known verdict, a score from 0 to 1, feedback and concepts that aren't blank, concepts all different, none for a correct answer
    and at least one for any other."""
    concepts = answer["missing_concepts"]
    correct = answer["verdict"] == "correct"
    return (
        answer["verdict"].isin("incorrect", "partially_correct", "correct") & answer["score"].between(0.0, 1.0) & (strip(answer["feedback"]) != "")
        & F.forall(concepts, lambda c: strip(c) != "") & is_unique(F.transform(concepts, lambda c: casefold(strip(c)))) & (correct == (F.size(concepts) == 0))
    )


def rating_of(verdict: Column) -> Column:
    return F.when(verdict == "incorrect", "again").when(verdict == "partially_correct", "hard").when(verdict == "correct", "good")


def answer_prompt(question: Column, expected: Column, answer: Column) -> Column:
    line = lambda head, c: F.concat(F.lit(head), F.coalesce(c, F.lit("")))
    return F.concat_ws("\n\n", line("Question: ", question), line("Expected: ", expected), line("Answer: ", answer))


def evaluate_answers(answers: DataFrame, question: str, expected: str, answer: str, make_provider: Callable[[], Provider]) -> DataFrame:
    """answers with evaluation (verdict, score, feedback, missing_concepts), rating, prompt_names and problem.

    Null and blank answers are a problem and aren't asked. Repeated rows are evaluated each. Other columns are passed on."""
    base = answers.withColumn("prompt", answer_prompt(F.col(question), F.col(expected), F.col(answer)))
    blank = F.coalesce(strip(F.col(answer)) == "", F.lit(True))
    done = _evaluated(base.filter(~blank), make_provider)
    empty = base.filter(blank).select(*answers.columns, F.lit(None).cast("struct<verdict: string, score: double, feedback: string, missing_concepts: array<string>>").alias("evaluation"), F.array().cast("array<string>").alias("prompt_names"), F.lit("the answer is blank").alias("problem"))
    out = done.select(*answers.columns, "evaluation", "prompt_names", "problem").unionByName(empty)
    return out.withColumn("rating", rating_of(F.col("evaluation.verdict")))


def _evaluated(rows: DataFrame, make_provider: Callable[[], Provider]) -> DataFrame:
    """generate() on one struct column, so that no column of rows clashes with its own."""
    packed = rows.select(F.struct(*rows.columns).alias("row"), "prompt")
    done = generate(packed, "prompt", make_provider, VERDICT, is_evaluation, "evaluation")
    return done.select("row.*", F.col("answer").alias("evaluation"), F.col("prompt_names"), "problem")


def record_answers(stored: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The attempts to append, the review state of every question they touch, and the outcome of every new id.

    stored, new: id, keys, rating, answered_at and any other columns. An id that is stored with the same content is 'unchanged' (a
    retry: its question's state is given again, no attempt is added), with other content a 'conflict'. Rows of null rating are left out."""
    rows = cut(new.select(*stored.columns).filter(F.col("rating").isNotNull()))
    outcome = cut(put(stored, rows, ["id"]))
    fresh = cut(rows.dropDuplicates(["id"]).join(outcome.filter("outcome = 'inserted'").select("id"), "id", "left_semi").select(*stored.columns))
    touched = rows.join(outcome.filter("outcome <> 'conflict'").select("id"), "id", "left_semi").select(*keys).distinct()
    history = stored.unionByName(fresh).join(touched, keys, "left_semi").select("id", *keys, "rating", "answered_at")
    state = latest(review_fold(history, keys, "answered_at", "rating", "id"), keys, "answered_at", "id")
    return fresh, state.select(*keys, "repetition_count", "interval_days", "ease_factor", "due_at", F.col("answered_at").alias("last_reviewed_at")), outcome


def record_review(progress: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """progress with the state of each reviewed question after one rating more, without an attempt: keys, rating, reviewed_at.

    A question without a state starts anew; several reviews of a question are taken in order of time."""
    start = progress.select(*keys, F.col("repetition_count").alias("_r"), F.col("interval_days").alias("_i"), F.col("ease_factor").alias("_e"))
    known = reviews.filter(F.col("rating").isin("again", "hard", "good", "easy") & F.col("reviewed_at").isNotNull()).join(start, keys, "left").withColumn("_at", F.unix_micros("reviewed_at"))

    def step(state: tuple | None, row: tuple) -> tuple:
        before = state[:3] if state else row[2:] if row[2] is not None else FRESH
        return advance(*before, row[0], row[1])

    folded = ordered_fold(known, keys, ["_at"], step, ["rating", "_at", "_r", "_i", "_e"], "repetition_count int, interval_days int, ease_factor double, _due bigint")
    last = latest(folded.select(*keys, "_at", "repetition_count", "interval_days", "ease_factor", F.timestamp_micros("_due").alias("due_at"), F.col("reviewed_at").alias("last_reviewed_at")), keys, "_at").drop("_at")
    rest = progress.join(last.select(*keys), keys, "left_anti")
    return rest.unionByName(last.select(*[c for c in progress.columns if c in last.columns]), allowMissingColumns=True).select(*progress.columns)

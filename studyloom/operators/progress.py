"""Learning progress of question banks: attempts, verdicts, what is due, difficult concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions.text import casefold


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 for an empty whole."""
    return F.when(whole == 0, 0.0).otherwise(F.try_divide(part, whole))


def progress_report(questions: DataFrame, attempts: DataFrame, progress: DataFrame, bank: list[str], number: str, as_of: Column) -> DataFrame:
    """One row a bank: questions, answered ones, attempts by verdict, due ones, next due time, last study and rates.

    questions has one row a question, progress at most one, attempts any number; each side is aggregated by question before it
    is joined, so a bank with most attempts is not joined row by row. A question without progress is due at as_of."""
    key = [*bank, number]
    verdict = F.col("evaluation.verdict")
    per = attempts.groupBy(*key).agg(
        F.count("*").alias("a_n"), *(F.count_if(verdict == v).alias(f"a_{v}") for v in ("incorrect", "partially_correct", "correct")), F.count_if(verdict.isNull()).alias("a_unclassified"), F.max("answered_at").alias("a_last")
    )
    joined = questions.select(*key).join(progress.select(*key, "due_at"), key, "left").join(per, key, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = joined.groupBy(*bank).agg(
        F.count("*").alias("n_questions"), F.count("a_n").alias("n_answered"), total("a_n").alias("n_attempts"),
        *(total(f"a_{v}").alias(f"n_{v}") for v in ("incorrect", "partially_correct", "correct", "unclassified")),
        F.count_if(F.col("due_at").isNull() | (F.col("due_at") <= as_of)).alias("n_due"), F.min(F.coalesce("due_at", as_of)).alias("next_due_at"), F.max("a_last").alias("last_studied_at"),
    )
    return out.withColumns({"answered_rate": rate(F.col("n_answered"), F.col("n_questions")), "correct_rate": rate(F.col("n_correct"), F.col("n_attempts"))})


def difficult_concepts(attempts: DataFrame, *by: str) -> DataFrame:
    """How often each missing concept was named, and its place: by falling count, then by folded name, then by name."""
    counted = attempts.select(*by, F.explode("evaluation.missing_concepts").alias("concept")).groupBy(*by, "concept").agg(F.count("*").alias("n_missing"))
    return counted.withColumn("folded", casefold("concept"))

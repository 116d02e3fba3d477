"""Citation and concept quality: expected against actual, per case and micro-averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions.text import casefold
from studyloom.operators.progress import rate


def citation_match(expected: DataFrame, actual: DataFrame, case: list[str], what: list[str]) -> DataFrame:
    """Per case with expected citations: matched, missing and unexpected ones (each counted once), recall and precision."""
    e = expected.select(*case, *what).distinct().withColumn("e", F.lit(1))
    a = actual.select(*case, *what).distinct().join(e.select(*case).distinct(), case, "left_semi").withColumn("a", F.lit(1))
    both = e.join(a, [*case, *what], "full").groupBy(*case).agg(
        F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("n_matched"), F.count_if(F.col("a").isNull()).alias("n_missing"), F.count_if(F.col("e").isNull()).alias("n_unexpected")
    )
    return both.withColumns({
        "recall": rate(F.col("n_matched"), F.col("n_matched") + F.col("n_missing")), "precision": rate(F.col("n_matched"), F.col("n_matched") + F.col("n_unexpected")),
        "passed": (F.col("n_missing") == 0) & (F.col("n_unexpected") == 0),
    })


def micro_average(cases: DataFrame, *by: str) -> DataFrame:
    """Sums over cases, not means of ratios."""
    m, x, u = (F.sum(f"n_{k}") for k in ("matched", "missing", "unexpected"))
    return cases.groupBy(*by).agg(
        F.count("*").alias("n_cases"), F.count_if("passed").alias("n_passed"), rate(F.count_if("passed"), F.count("*")).alias("pass_rate"), rate(m, m + x).alias("recall"), rate(m, m + u).alias("precision")
    )


def has_concept(answer: Column, phrases: Column) -> Column:
    """Whether any accepted phrase stands in the answer, folded."""
    return F.exists(phrases, lambda p: F.contains(casefold(answer), casefold(p)))


def concept_match(cases: DataFrame, answer: str, concepts: str) -> DataFrame:
    """cases with found and missing (names of concepts, an array of structs name, accepted_phrases) in the answer, and concept_recall,
    which is 1 where none is expected. A null answer has none of them."""
    holds = lambda c: F.coalesce(has_concept(F.col(answer), c["accepted_phrases"]), F.lit(False))
    names = lambda keep: F.transform(F.filter(concepts, keep), lambda c: c["name"])
    out = cases.withColumns({"found": names(holds), "missing": names(lambda c: ~holds(c))})
    return out.withColumn("concept_recall", F.when(F.size(concepts) == 0, 1.0).otherwise(rate(F.size("found"), F.size(concepts))))


def evaluate_cases(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """cases (case_id, question, expected_citations, expected_concepts) with the answer to each (case_id, question, answer,
    citations): citations matched, missing and unexpected (sorted), recalls, precision, and passed. ValueError if a case has no answer
    or several, an answer has no case, or the questions differ."""
    n = answers.groupBy("case_id").agg(F.count("*").alias("n"), F.first("question").alias("asked"))
    r = cases.join(n, "case_id", "full").agg(F.count_if(F.coalesce("n", F.lit(0)) != 1).alias("counts"), F.count_if(F.col("question").isNull()).alias("strangers"), F.count_if(F.col("question") != F.col("asked")).alias("questions")).first()
    if r["counts"] or r["strangers"] or r["questions"]:
        raise ValueError(f"{r['counts']} cases without exactly one answer, {r['strangers']} answers without a case, {r['questions']} answers to another question")
    both = cases.join(answers.select("case_id", "answer", "citations"), "case_id")
    e, a = F.array_distinct("expected_citations"), F.array_distinct("citations")
    both = both.withColumns({"matched": F.array_sort(F.array_intersect(e, a)), "missing_citations": F.array_sort(F.array_except(e, a)), "unexpected": F.array_sort(F.array_except(a, e))})
    out = concept_match(both, "answer", "expected_concepts")
    hit = F.size("matched")
    return out.withColumns({
        "citation_recall": rate(hit, hit + F.size("missing_citations")), "citation_precision": rate(hit, hit + F.size("unexpected")),
        "passed": (F.size("missing_citations") == 0) & (F.size("unexpected") == 0) & (F.size("missing") == 0),
    })

from datetime import datetime, timedelta

from pyspark.sql import functions as F

import pytest

from studyloom.api import NOTHING_FOUND, Library
from studyloom.functions.providers import drafting, marking

T0 = datetime(2024, 1, 1)
PAGES = "document_id string, source string, content_sha256 string, page_number int, text string"
ATTEMPTS = "id string, document_id string, identity string, question_number int, rating string, answered_at timestamp, verdict string, missing_concepts array<string>"


def pages(spark, *rows):
    return spark.createDataFrame([(d, f"{d}.pdf", h, n, t) for d, h, n, t in rows], PAGES)


def test_a_library_from_index_to_progress(spark, tmp_path):
    def provider():
        import json
        import re

        return lambda prompt: json.dumps({"text": "said", "citation_numbers": [int(n) for n in re.findall(r"\[(\d+)\]", prompt)][:1] or [99]})

    lib = Library(spark, str(tmp_path / "lib"))
    assert lib.documents().count() == 0 and lib.search(spark.createDataFrame([(1, "x")], "query_id int, text string")).count() == 0
    first = pages(spark, ("a", "h1", 1, "river terraces rise"), ("a", "h1", 2, "market rents fall"), ("b", "h2", 1, "tidal mixing"), ("c", "h2", 1, "tidal mixing"), ("e", "h3", 1, " "))
    assert {r.document_id: r.status for r in lib.index(first).collect()} == {"a": "added", "b": "added", "c": "skipped", "e": "added"}
    assert {r.status for r in lib.index(first).collect()} == {"skipped"}
    assert {r.document_id: (r.page_count, r.chunk_count) for r in lib.documents().collect()} == {"a": (2, 2), "b": (1, 1), "e": (1, 0)}
    assert [r.chunk_index for r in lib.chunks_of("a").collect()] == [0, 1] and lib.chunks_of("zz").count() == 0

    queries = spark.createDataFrame([(7, "query: market rents fall"), (8, "tidal mixing")], "query_id int, text string")
    best = {r.query_id: r.text for r in lib.search(queries, 1).collect()}
    assert best == {7: "market rents fall", 8: "tidal mixing"}
    answers = {r.query_id: r for r in lib.ask(queries, provider, 2).collect()}
    assert answers[7].is_valid and answers[7].answer == "said" and len(answers[7].cited_chunk_ids) == 1

    assert {r.document_id for r in lib.summarize("v1", provider).collect()} == {"a", "b"}
    before = lib.table("summaries").count()
    assert lib.summarize("v1", provider).count() == before
    cited = {r.document_id: [(c.number, c.page_number, c.excerpt) for c in r.citations] for r in lib.table("summaries").collect()}
    assert cited == {"a": [(1, 1, "river terraces rise")], "b": [(1, 1, "tidal mixing")]}
    assert lib.summarize("v1", provider, force=True).count() == before
    banks = {r.document_id: r.questions for r in lib.draft_questions("q1", "v1", drafting, 3).collect()}
    assert [q.number for q in banks["a"]] == [1, 2, 3] and banks["a"][0].citations[0].excerpt == "river terraces rise"
    answers = spark.createDataFrame([("e1", "a", "q1", 1, "See [1].", T0), ("e2", "a", "q1", 2, " ", T0), ("e3", "zz", "q1", 1, "x", T0)], "id string, document_id string, identity string, question_number int, answer_text string, answered_at timestamp")
    marked = {r.id: (r.rating, r.problem) for r in lib.evaluate(answers, marking).collect()}
    assert marked == {"e1": ("good", None), "e2": (None, "the answer is blank")}
    none = {r.query_id: r.answer for r in Library(spark, str(tmp_path / "empty")).ask(queries, provider).collect()}
    assert set(none.values()) == {NOTHING_FOUND} and len(none) == 2
    assert [(r.number, r.excerpt) for r in lib.citations(lib.ask(queries, provider, 1).filter("query_id = 7")).collect()] == [(1, "market rents fall")]
    with pytest.raises(ValueError, match="model"):
        Library(spark, str(tmp_path / "lib"), model="another")

    log = spark.createDataFrame([("x1", "a", "i", 1, "good", T0, "correct", []), ("x2", "a", "i", 1, "good", T0 + timedelta(days=1), None, None)], ATTEMPTS)
    assert {r.outcome for r in lib.record(log).collect()} == {"inserted"}
    again = spark.createDataFrame([("x1", "a", "i", 1, "good", T0, "correct", []), ("x2", "a", "i", 1, "easy", T0, None, None)], ATTEMPTS)
    assert {r.id: r.outcome for r in lib.record(again).collect()} == {"x1": "unchanged", "x2": "conflict"}
    questions = spark.createDataFrame([("a", "i", 1), ("a", "i", 2)], "document_id string, identity string, question_number int")
    assert {r.question_number for r in lib.due(questions, F.lit(T0 + timedelta(days=3))).collect()} == {2}
    report = lib.progress(questions, F.lit(T0 + timedelta(days=30))).first()
    assert (report.n_questions, report.n_answered, report.n_attempts, report.n_correct, report.n_due) == (2, 1, 2, 1, 2)

    state = {r.question_number: (r.repetition_count, r.last_reviewed_at) for r in lib.progress_states().collect()}
    assert state == {1: (2, T0 + timedelta(days=1))}
    lib.review(spark.createDataFrame([("a", "i", 1, "again", T0 + timedelta(days=2)), ("a", "i", 2, "easy", T0)], "document_id string, identity string, question_number int, rating string, reviewed_at timestamp"))
    assert {r.question_number: r.repetition_count for r in lib.progress_states().collect()} == {1: 0, 2: 1}

    lib.replace(pages(spark, ("a", "h9", 1, "new text")))
    assert [r.text for r in lib.chunks_of("a").collect()] == ["new text"] and lib.table("attempts").count() == 0
    assert lib.remove(spark.createDataFrame([("a",), ("nobody",)], "document_id string")) == 1
    assert lib.tables.clean() > 0
    assert {r.document_id for r in lib.documents().collect()} == {"b", "e"} and {r.document_id for r in lib.table("summaries").collect()} == {"b"}

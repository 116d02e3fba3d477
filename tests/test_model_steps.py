import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from studyloom.functions.json_strict import strict_object
from studyloom.functions.providers import drafting, marking, outlining
from studyloom.operators.answers import evaluate_answers, record_answers, record_review
from studyloom.operators.generation import TEXT, first_sentences, generate, is_cited_text, map_batches, misses
from studyloom.operators.questions import Rejected, draft_banks, drafts_of, trusted
from studyloom.operators.search import check_vectors
from studyloom.operators.store import insert_unique, update_existing
from studyloom.operators.summaries import map_step, reduce_step, summarize

ROWS = [("d", i, f"text {i} of d") for i in range(4)] + [("e", i, f"text {i} of e") for i in range(3)] + [("f", 0, "only one"), ("g", 0, "fails"), ("g", 1, "fine but longer")]
T0 = datetime(2024, 1, 1)


def chunks(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc string, i int, t string")


def test_strict_objects(spark):
    good = ['{"text": "a", "citation_numbers": [1, 2]}', '{"citation_numbers": [], "text": ""}']
    bad = ['{"text": "a"}', '{"text": 1, "citation_numbers": [1]}', '{"text": "a", "citation_numbers": [1.5]}', '{"text": "a", "citation_numbers": [true]}', '{"text": "a", "citation_numbers": ["1"]}', '{"text": null, "citation_numbers": [1]}', '{"text": "a", "citation_numbers": [1], "x": 0}', "[]", "no", "", None]
    got = [r.v for r in spark.createDataFrame([(t,) for t in good + bad], "t string").select(strict_object(F.col("t"), **TEXT).alias("v")).collect()]
    assert [(v.text, v.citation_numbers) for v in got[:2]] == [("a", [1, 2]), ("", [])] and got[2:] == [None] * len(bad)
    score = spark.createDataFrame([('{"s": 1}',), ('{"s": 0.25}',), ('{"s": 1e-1}',), ('{"s": true}',)], "t string").select(strict_object(F.col("t"), s="double").alias("v")).collect()
    assert [r.v and r.v.s for r in score] == [1.0, 0.25, 0.1, None]


def test_one_format_repair_and_no_more(spark):
    def make():
        asked = {}

        def provider(prompt):
            if "raises" in prompt:
                raise RuntimeError("no model")
            if "never" in prompt or "later" in prompt and "exactly these keys" not in prompt:
                return "no JSON"
            return json.dumps({"text": "fine", "citation_numbers": [1]})

        return provider

    rows = spark.createDataFrame([(1, "now", "x"), (2, "later", "x"), (3, "never", "x"), (4, "raises", "x")], "id int, prompt string, answer string")
    got = {r.id: (r.answer and r.answer.text, r.prompt_names, r.problem) for r in generate(rows, "prompt", make, TEXT, is_cited_text).collect()}
    assert got[1] == ("fine", ["prompt"], None) and got[2] == ("fine", ["prompt", "format_repair"], None)
    assert got[3][0] is None and got[3][1] == ["prompt", "format_repair"] and got[3][2]
    assert got[4] == (None, ["prompt"], "RuntimeError: no model")


def test_summaries_are_combined_repaired_and_fall_back(spark):
    out, keep = summarize(chunks(spark, ROWS[:8]), "doc", "i", "t", 14, outlining, "v1")
    got = {r.document: r for r in out.collect()}
    assert got["d"].summary == "4 sections" and not got["d"].fell_back and got["d"].citation_numbers == [1, 2, 3, 4]
    assert got["d"].prompt_names == ["map", "format_repair", "reduce", "reduce_repair"]
    assert got["e"].summary == "[1] text 0 of e\n\n[2] text 1 of e\n\n[3] text 2 of e" and got["e"].fell_back
    assert got["f"].summary == "[1] only one" and got["f"].prompt_names == ["map"] and got["f"].n_batches == 1
    assert keep.count() == 8


def provider_of(answers):
    def make():
        def provider(prompt):
            for key, value in answers.items():
                if key in prompt:
                    if isinstance(value, Exception):
                        raise value
                    return json.dumps(value)
            return json.dumps({"text": "batch", "citation_numbers": [int(prompt[1])]})

        return provider

    return make


def test_a_failed_batch_fails_its_document(spark):
    out, keep = summarize(chunks(spark), "doc", "i", "t", 14, provider_of({"fails": RuntimeError("x"), "text 2 of e": {"text": "b", "citation_numbers": [1]}, "Combine": {"text": "all", "citation_numbers": [1, 2, 3, 4]}}), "v1")
    got = {r.document: (r.summary, r.problem) for r in out.collect()}
    assert got["d"] == ("all", None) and got["f"] == ("batch", None)
    assert got["g"] == (None, "batch 1: RuntimeError: x") and got["e"] == (None, "batch 3: a citation lies outside the batch")
    assert {(r.document, r.batch_number) for r in keep.collect()} == {("d", n) for n in range(1, 5)} | {("e", 1), ("e", 2), ("f", 1), ("g", 2)}


def test_a_combination_may_cite_only_what_the_sections_cite(spark):
    out, _ = summarize(chunks(spark, ROWS[:4]), "doc", "i", "t", 14, provider_of({"Combine": {"text": "all", "citation_numbers": [1, 9]}}), "v1")
    assert [(r.summary, r.problem) for r in out.collect()] == [(None, "the combination cites what no section does")]


def test_resume_takes_stored_batches_and_force_does_not(spark):
    plan = map_batches(chunks(spark, ROWS[:4]), "doc", "i", "t", 14)
    stored = spark.createDataFrame([("d", "v1", 1, 1, 1, "stored", [1], ["map"]), ("d", "v1", 2, 2, 3, "other range", [2], ["map"]), ("d", "v2", 3, 3, 3, "other identity", [3], ["map"])], "document string, identity string, batch_number int, first_number int, last_number int, text string, citation_numbers array<bigint>, prompt_names array<string>")
    done, keep = map_step(plan, outlining, "v1", stored)
    got = {r.batch_number: (r.text, r.problem) for r in done.collect()}
    assert got[1] == ("stored", None) and got[2][1] == "the stored batch does not match the plan" and got[3][0].startswith("[3] text") and keep.count() == 2
    assert reduce_step(done, outlining).first().problem.startswith("batch 2")
    forced, kept = map_step(plan, outlining, "v1", stored, force=True)
    assert {r.text for r in forced.collect()} == {f"[{n}] text {n - 1} of d" for n in range(1, 5)} and kept.count() == 0
    assert misses(plan, stored.filter("batch_number = 1"), ["batch_number"]).count() == 3


def test_banks_replace_repeated_questions_only(spark):
    s = spark.createDataFrame([("a", "text", [4, 7]), ("b", "text", [5]), ("c", None, [1]), ("d", "text", [])], "document string, text string, numbers array<int>")
    got = {r.document: r for r in draft_banks(s, drafting, 5).collect()}
    assert [q.text for q in got["a"].questions] == ["What is said in [4]?", "What is said in [7]?", "What else is said in [4]? (3)", "What else is said in [7]? (4)", "What else is said in [4]? (5)"]
    assert [q.number for q in got["b"].questions] == [1, 2, 3, 4, 5] and len({q.text.casefold() for q in got["b"].questions}) == 5
    assert got["a"].prompt_names == ["questions", "questions_repair"] and [b.last_number for b in got["a"].new_batches] == [2, 4, 5]
    assert got["c"].problem and got["d"].problem and got["c"].questions is None
    stored = spark.createDataFrame([("a", 1, 1, 2, [(1, "Old one", "x", [4]), (2, "Old two", "x", [7])]), ("b", 1, 1, 3, [])], "document string, batch_number int, first_number int, last_number int, questions array<struct<number: int, text: string, expected_answer: string, citation_numbers: array<bigint>>>")
    again = {r.document: r for r in draft_banks(s.limit(2), drafting, 3, stored=stored).collect()}
    assert [q.text for q in again["a"].questions] == ["Old one", "Old two", "What is said in [4]?"] and len(again["a"].new_batches) == 1
    assert again["b"].problem == "the stored batch does not match the plan"
    assert [q.text for q in draft_banks(s.limit(1), drafting, 2, stored=stored, force=True).first().questions][0] == "What is said in [4]?"


def test_drafts_of_the_wrong_shape():
    one = {"text": " q ", "expected_answer": "a", "citation_numbers": [1]}
    assert drafts_of(json.dumps({"questions": [one]}))[0]["text"] == "q"
    for bad in ({}, {"questions": []}, {"questions": [one, one]}, {"questions": [one | {"citation_numbers": [True]}]}, {"questions": [one | {"citation_numbers": [1, 1]}]}, {"questions": [one | {"text": " "}]}, {"questions": [one | {"x": 1}]}, {"questions": [one | {"citation_numbers": [0]}]}):
        with pytest.raises(Rejected):
            drafts_of(json.dumps(bad))
    with pytest.raises(Rejected):
        drafts_of("no")


def test_trusted_citations(spark):
    row = spark.createDataFrame([([2, 1], [(1, "a"), (2, "b")]), ([3], [(1, "a")])], "n array<int>, c array<struct<number: int, source: string>>")
    got = row.select(trusted(F.col("n"), F.col("c")).alias("t")).collect()
    assert [x.source for x in got[0].t] == ["b", "a"] and got[1].t is None


def test_answers_are_marked_and_rated(spark):
    rows = [(1, "q", "long answer", "long answer"), (2, "q", "long answer", "long ans"), (3, "q", "long answer", "no"), (4, "q", "x", " "), (5, "q", "x", None)]
    out = {r.id: (r.rating, r.evaluation and r.evaluation.missing_concepts, r.problem) for r in evaluate_answers(spark.createDataFrame(rows, "id int, question string, expected string, answer string"), "question", "expected", "answer", marking).collect()}
    assert out == {1: ("good", [], None), 2: ("hard", ["details"], None), 3: ("again", ["everything"], None), 4: (None, None, "the answer is blank"), 5: (None, None, "the answer is blank")}
    broken = provider_of({"Question": {"verdict": "correct", "score": 1, "feedback": "ok", "missing_concepts": ["x"]}})
    assert evaluate_answers(spark.createDataFrame(rows[:1], "id int, question string, expected string, answer string"), "question", "expected", "answer", broken).first().problem


def test_recording_answers_and_reviews(spark):
    schema = "id string, q int, rating string, answered_at timestamp"
    stored = spark.createDataFrame([("a", 1, "good", T0)], schema)
    new = spark.createDataFrame([("a", 1, "good", T0), ("b", 1, "good", T0 + timedelta(days=1)), ("c", 2, "easy", T0), ("d", 3, None, T0)], schema)
    fresh, state, outcome = record_answers(stored, new, ["q"])
    assert {r.id for r in fresh.collect()} == {"b", "c"} and {r.id: r.outcome for r in outcome.collect()} == {"a": "unchanged", "b": "inserted", "c": "inserted"}
    assert {r.q: (r.repetition_count, r.interval_days) for r in state.collect()} == {1: (2, 6), 2: (1, 4)}
    _, _, bad = record_answers(stored, spark.createDataFrame([("a", 1, "easy", T0)], schema), ["q"])
    assert bad.first().outcome == "conflict"
    after = record_review(state, spark.createDataFrame([(1, "good", T0 + timedelta(days=9)), (5, "good", T0)], "q int, rating string, reviewed_at timestamp"), ["q"])
    assert {r.q: (r.repetition_count, r.interval_days) for r in after.collect()} == {1: (3, 15), 2: (1, 4), 5: (1, 1)}
    assert record_review(state, new.limit(0).select("q", "rating", F.col("answered_at").alias("reviewed_at")), ["q"]).count() == 2


def test_vectors_are_taken_whole_or_not_at_all(spark):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "vec array<float>")
    assert check_vectors(df([1.0, 0.0], [0.0, 2.0]), "vec") == 2 and check_vectors(df([1.0]).limit(0), "vec", 7) is None
    for bad in (df([1.0], [0.0]), df([1.0], None), df([1.0], [])):
        with pytest.raises(ValueError, match="null, empty or zero"):
            check_vectors(bad, "vec")
    for bad, size in ((df([1.0], [1.0, 2.0]), None), (df([1.0]), 2)):
        with pytest.raises(ValueError, match="dimension"):
            check_vectors(bad, "vec", size)


def test_inserts_and_updates_say_what_is_wrong(spark):
    stored = spark.createDataFrame([(1, "h1"), (2, "h2"), (2, "h3")], "k int, h string")
    new = spark.createDataFrame([(1, "h9"), (5, "h2"), (6, "h6"), (7, "h7"), (8, "h7"), (9, None)], "k int, h string")
    assert {r.k: r.problem for r in insert_unique(stored, new, ["k"], "h").collect()} == {1: "key exists", 5: "value exists", 6: None, 7: "value exists", 8: "value exists", 9: None}
    assert {r.k: r.problem for r in update_existing(stored, spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "k int, h string"), ["k"]).collect()} == {1: None, 2: "repeated", 3: "missing"}


def test_first_sentences(spark):
    one = spark.createDataFrame([("One. Two! Three",), ("none",), ("",)], "t string").select(first_sentences(F.col("t"), 2).alias("x")).collect()
    assert [r.x for r in one] == ["One. Two!", "none", ""]

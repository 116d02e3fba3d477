import json

import pytest
from pyspark.sql import functions as F

from studyloom.operators.citations import exploded, is_subset, is_unique, numbers_within, resolve
from studyloom.operators.evaluate import citation_match, evaluate_cases, has_concept, micro_average
from studyloom.operators.search import NOTHING_FOUND, ground
from studyloom.sources.pages import checked_files, read_binary_pages, read_cases, read_text_pages, skip_known
from studyloom.sources.reports import nested_as_json, nested_from_json, write_report


def test_citations_matched_missing_unexpected(spark):
    e = spark.createDataFrame([("a", "s", 1), ("b", "s", 2), ("b", "s", 3)], "id string, source string, page int")
    a = spark.createDataFrame([("a", "s", 1), ("a", "s", 8), ("a", "s", 8), ("b", "s", 2), ("z", "s", 1)], "id string, source string, page int")
    cases = citation_match(e, a, ["id"], ["source", "page"])
    got = {r.id: (r.n_matched, r.n_missing, r.n_unexpected, r.recall, r.precision, r.passed) for r in cases.collect()}
    assert got == {"a": (1, 0, 1, 1.0, 0.5, False), "b": (1, 1, 0, 0.5, 1.0, False)}
    m = micro_average(cases).first()
    assert (m.n_cases, m.n_passed, m.pass_rate, round(m.recall, 6), round(m.precision, 6)) == (2, 0, 0.0, round(2 / 3, 6), round(2 / 3, 6))


def test_array_predicates_and_resolution(spark):
    df = spark.createDataFrame([(1, [1, 2], [2, 1, 3]), (2, [4, 4], [1])], "id int, a array<int>, b array<int>")
    r = {x.id: x for x in df.select("id", is_subset(F.col("a"), F.col("b")).alias("s"), is_unique(F.col("a")).alias("u"), numbers_within(F.col("a"), F.lit(1), F.lit(3)).alias("w")).collect()}
    assert (r[1].s, r[1].u, r[1].w, r[2].s, r[2].u, r[2].w) == (True, True, True, False, False, False)
    assert spark.range(1).select(has_concept(F.lit("The STRASSE is long"), F.array(F.lit("straße"))).alias("x")).first().x
    cited = exploded(spark.createDataFrame([(1, [{"n": 5}, {"n": 6}])], "id int, citations array<struct<n:int>>"), ["id"])
    got = {(r.place, r.n): r.chunk_id for r in resolve(cited, spark.createDataFrame([(5, 50, "t")], "n int, chunk_id int, text string"), ["n"]).collect()}
    assert got == {(1, 5): 50, (2, 6): None}


def test_page_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first \n<<>>\n second\r\n\n<<>>", encoding="utf-8")
    got = {(r.source, r.page_number): r.text for r in read_text_pages(spark, str(tmp_path), "<<>>", "*.txt").collect()}
    assert got == {("a.txt", 1): "first", ("a.txt", 2): "second", ("a.txt", 3): ""}
    (tmp_path / "x.pdf").write_bytes(b"one|two")
    (tmp_path / "y.pdf").write_bytes(b"one|two")
    (tmp_path / "z.pdf").write_bytes(b"broken")

    def extract(data):
        if data == b"broken":
            raise ValueError("not readable")
        return data.decode().split("|")

    pages = read_binary_pages(spark, str(tmp_path), extract)
    rows = sorted((r.source, r.page_number or 0, r.text, r.problem) for r in pages.collect())
    assert rows == [("x.pdf", 1, "one", None), ("x.pdf", 2, "two", None), ("y.pdf", 1, "one", None), ("y.pdf", 2, "two", None), ("z.pdf", 0, None, "ValueError: not readable")]
    files = pages.select("path", "source", "content_sha256").distinct()
    status = {r.source: r.status for r in skip_known(files, files.filter("source = 'z.pdf'")).collect()}
    assert status == {"x.pdf": "added", "y.pdf": "skipped", "z.pdf": "skipped"}


def test_cases_file(spark, tmp_path):
    good = {"schema_version": 1, "cases": [{"id": "c", "question": "q?", "expected_citations": [{"source": "s", "page_number": 1}], "expected_concepts": []}]}
    (tmp_path / "good.json").write_text(json.dumps(good))
    assert [r.case_id for r in read_cases(spark, str(tmp_path / "good.json")).collect()] == ["c"]
    for k, bad in enumerate(({**good, "schema_version": 2}, {"schema_version": 1, "cases": [{"id": None, "question": "q"}]})):
        (tmp_path / f"bad{k}.json").write_text(json.dumps(bad))
        with pytest.raises(Exception):  # noqa: B017
            read_cases(spark, str(tmp_path / f"bad{k}.json")).collect()


def test_every_missed_concept_of_every_bank_comes_out(spark, tmp_path):
    import datetime as dt

    from studyloom.queries.learning import concepts_missed_by_bank

    t = dt.datetime(2024, 1, 1)
    schema = "id string, document_id string, question_bank_identity_fingerprint string, question_number int, question_text string, answer_text string, expected_answer string, rating string, answered_at timestamp, evaluation struct<verdict:string, missing_concepts:array<string>>, received_at timestamp"
    row = lambda i, bank, concepts: (str(i), bank, "f", 1, "q", "a", "e", "good", t, ("incorrect", concepts), t)
    rows = [row(0, "x", [f"concept {k:03}" for k in range(150)]), row(1, "x", ["concept 149"]), row(2, "y", ["b", "A"])]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/study_attempts.parquet")
    out = concepts_missed_by_bank(spark, str(tmp_path)).collect()
    places = {(r.document_id, r.concept): r.place for r in out}
    assert len(out) == 152 and places["x", "concept 149"] == 1 and places["x", "concept 148"] == 150
    assert [places["y", c] for c in "Ab"] == [1, 2]


def test_files_are_checked_by_name(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    assert checked_files(spark, [str(tmp_path / "a.PDF")], ".pdf") == [str(tmp_path / "a.PDF")]
    with pytest.raises(ValueError, match="does not exist; .* is no file; .* is no .pdf file"):
        checked_files(spark, [str(tmp_path / "none.pdf"), str(tmp_path), str(tmp_path / "b.txt")], ".pdf")


def test_an_extractors_warnings_are_kept(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"good")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def extract(content):
        import warnings

        warnings.warn(f"{len(content)} bytes", stacklevel=1)
        if content == b"bad":
            raise ValueError("broken")
        return ["one", "two"]

    got = sorted((r.source, r.page_number, r.problem, tuple(r.diagnostics)) for r in read_binary_pages(spark, str(tmp_path), extract).collect())
    assert got == [("a.pdf", 1, None, ("4 bytes",)), ("a.pdf", 2, None, ("4 bytes",)), ("b.pdf", None, "ValueError: broken", ("3 bytes",))]


def test_cases_have_ids_of_their_own(spark, tmp_path):
    case = {"id": "c", "question": "q", "expected_citations": [{"source": "s", "page_number": 1}], "expected_concepts": []}
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": 1, "cases": [case, case]}), encoding="utf-8")
    with pytest.raises(Exception, match="unique"):
        read_cases(spark, str(tmp_path / "a.json")).collect()


def test_cases_against_answers(spark):
    cite, concept = "array<struct<source: string, page_number: int>>", "array<struct<name: string, accepted_phrases: array<string>>>"
    cases = spark.createDataFrame([("a", "q1", [("s", 1), ("s", 2)], [("river", ["River", "stream"]), ("sea", ["ocean"])]), ("b", "q2", [("s", 1)], [])], f"case_id string, question string, expected_citations {cite}, expected_concepts {concept}")
    schema = f"case_id string, question string, answer string, citations {cite}"
    out = {r.case_id: r for r in evaluate_cases(cases, spark.createDataFrame([("a", "q1", "the STREAM", [("s", 2), ("t", 9), ("s", 7)]), ("b", "q2", None, [("s", 1)])], schema)).collect()}
    assert (out["a"].found, out["a"].missing, out["a"].concept_recall, out["a"].citation_recall, out["a"].passed) == (["river"], ["sea"], 0.5, 0.5, False)
    assert [(c.source, c.page_number) for c in out["a"].unexpected] == [("s", 7), ("t", 9)] and abs(out["a"].citation_precision - 1 / 3) < 1e-9
    assert out["b"].passed and out["b"].concept_recall == 1.0
    for rows in ([("a", "q1", "", [])], [("a", "q1", "", []), ("b", "other", "", [])], [("a", "q1", "", []), ("b", "q2", "", []), ("z", "q", "", [])], [("a", "q1", "", []), ("a", "q1", "", []), ("b", "q2", "", [])]):
        with pytest.raises(ValueError, match="cases without"):
            evaluate_cases(cases, spark.createDataFrame(rows, schema))


def test_reports_and_json_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, [("s", None)], True), (2, None, False)], "id int, c array<struct<source: string, page: int>>, ok boolean")
    text = nested_as_json(df)
    assert [r.c for r in text.orderBy("id").collect()] == ['[{"source":"s","page":null}]', None]
    assert nested_from_json(text, df.schema).orderBy("id").collect() == df.orderBy("id").collect()
    assert not write_report(df, str(tmp_path / "r"), F.col("ok")) and write_report(df.filter("ok"), str(tmp_path / "s"), F.col("ok"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_queries_without_hits_ask_no_model(spark):
    def never():
        def provider(prompt):
            raise AssertionError(prompt)

        return provider

    hits = spark.createDataFrame([], "query_id bigint, rank int, id bigint, text string")
    out = ground(hits, spark.createDataFrame([(1, "q")], "query_id bigint, question string"), "text", never).first()
    assert out.answer == NOTHING_FOUND and out.is_valid and out.cited_ids == [] and out.problem is None

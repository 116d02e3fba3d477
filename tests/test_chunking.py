import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from studyloom.operators.batching import budget_batches, fixed_batches, numbered
from studyloom.operators.chunking import chunk_pages, chunk_words, page_chunks, split_pages, word_runs


@pytest.mark.parametrize(
    ("text", "most", "overlap", "expected"),
    [
        ("one two three four", 9, 0, ["one two", "three", "four"]),
        ("one two three four five", 13, 5, ["one two three", "three four", "four five"]),
        ("abcdefgh", 5, 0, ["abcde", "fgh"]),
        ("alpha beta\n\ngamma delta epsilon", 25, 0, ["alpha beta", "gamma delta epsilon"]),
        ("alpha beta\n\ngamma delta epsilon", 25, 5, ["alpha beta", "gamma delta epsilon"]),
        ("   \n", 25, 5, []),
        (None, 25, 5, []),
        ("a\n \nb", 4, 0, ["a\n\nb"]),
        ("a  b\tc d", 100, 5, ["a b c d"]),
    ],
)
def test_page_chunks(text, most, overlap, expected):
    assert page_chunks(text, most, overlap) == expected


def naive(words, most, overlap):
    out, start = [], 0
    while start < len(words):
        end = start
        while end < len(words) and len(" ".join(words[start : end + 1])) <= most:
            end += 1
        out.append((start, end))
        if end == len(words):
            return out
        back = end
        while back > start and len(" ".join(words[back - 1 : end])) <= overlap:
            back -= 1
        start = end if back == start else back
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=60), st.integers(9, 40), st.integers(0, 30))
def test_word_runs_as_a_plain_loop(lengths, most, overlap):
    overlap = min(overlap, most - 1)
    assert word_runs(lengths, most, overlap) == naive(["x" * n for n in lengths], most, overlap)


def test_chunks_are_numbered_over_pages(spark):
    rows = [("d", 1, "one two three four five six", 9), ("d", 2, "seven", 9), ("d", 3, " ", 9), ("e", 1, None, 9), ("f", 1, "x", 9)]
    pages = spark.createDataFrame(rows, "document_id string, number int, body string, chunk_index int")
    got = chunk_pages(pages, "document_id", "number", "body", 13, 0).orderBy("document", "chunk_index").collect()
    assert [(r.document, r.page, r.chunk_index, r.chunk_text) for r in got] == [("d", 1, 0, "one two three"), ("d", 1, 1, "four five six"), ("d", 2, 2, "seven"), ("f", 1, 0, "x")]
    assert chunk_pages(pages.limit(0), "document_id", "number", "body").count() == 0
    with pytest.raises(ValueError):
        chunk_pages(pages, "document_id", "number", "body", 10, 10)


def test_chunk_words_of_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 50_000), (2, ""), (3, None)], "id int, t string")
    got = chunk_words(df, "id", "t", 100, 20).collect()
    assert {r.document for r in got} == {1} and max(len(r.chunk_text) for r in got) <= 100
    assert [r.chunk_index for r in sorted(got, key=lambda r: r.chunk_index)] == list(range(len(got)))


def test_split_pages(spark):
    df = spark.createDataFrame([(1, "a<<>>b<<>>"), (2, None), (3, "x.*y")], "id int, t string")
    got = {(r.document, r.page): r.page_text for r in split_pages(df, "id", "t", "<<>>").collect()}
    assert got == {(1, 1): "a", (1, 2): "b", (1, 3): "", (3, 1): "x.*y"}


def test_budget_batches(spark):
    rows = [("d", 1, 6), ("d", 2, 6), ("d", 3, 4), ("e", 1, 50), ("e", 2, None), ("e", 3, 10), ("f", 1, 1)]
    got = budget_batches(spark.createDataFrame(rows, "doc string, i int, size int"), "doc", ["i"], "size", 10).collect()
    assert {(r.doc, r.i): (r.context_number, r.batch_number) for r in got} == {
        ("d", 1): (1, 1), ("d", 2): (2, 2), ("d", 3): (3, 2), ("e", 1): (1, 1), ("e", 2): (2, 2), ("e", 3): (3, 2), ("f", 1): (1, 1),
    }


def test_fixed_batches_and_numbers(spark):
    df = spark.createDataFrame([("a", 5), ("b", 0), ("c", 2)], "k string, n int")
    got = sorted((r.k, r.batch_number, r.first_number, r.last_number) for r in fixed_batches(df, "n", 2).collect())
    assert got == [("a", 1, 1, 2), ("a", 2, 3, 4), ("a", 3, 5, 5), ("c", 1, 1, 2)]
    assert sorted((r.k, r.no) for r in numbered(df, "k", ["n"], "no").collect()) == [("a", 1), ("b", 1), ("c", 1)]

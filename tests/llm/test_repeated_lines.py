import random
import re

import pytest

import studyloom.llm.repeated_lines as module
from studyloom.llm.repeated_lines import line_key, repeated_lines, without_lines

SCHEMA = "chunk_id bigint, document_id string, source string, text string, a bigint, n bigint, bit string"
IDS = [f"{i:08x}-0000-4000-8000-{i:012x}" for i in range(60)]


# Written by hand, not by the module's own tables: what the lines of sample() count as.
def by_hand(line):
    line = line.replace("о", "o").replace("С", "C").replace("\u200b", "").lower()
    return re.sub("[0-9]+", "0", re.sub(r"\s+", "", line))


def brute(rows, least=4, share=0.1):
    doc = lambda d: None if d is None else re.sub("urn:uuid:|[^0-9a-f]", "", d.lower())
    docs, lines, at = {}, [], {}
    for c, d, s, t, *_ in rows:
        if d is not None:
            docs.setdefault(s, set()).add(doc(d))
        for n, line in enumerate((t or "").split("\n"), 1):
            if k := by_hand(line):
                lines.append((c, n, s, k))
                if d is not None:
                    at.setdefault((s, k), set()).add(doc(d))
    good = lambda s, k: len(at.get((s, k), ())) >= least and len(at[s, k]) / len(docs[s]) >= share
    return {(c, n) for c, n, s, k in lines if good(s, k)}


def sample():
    r = random.Random(5)
    rows = []
    for i in range(240):
        d = None if i % 17 == 0 else r.choice(IDS)
        if d and i % 5 == 0:
            d = "urn:uuid:" + d.upper()
        legal = r.choice(["Copyright 12 Press", "COPYRIGHT  99 press\r", "Cоpyright 7 Press", "own line %d x" % i, ""])
        rows.append((i, d, r.choice(["a", "a", "a", "b", None]), None if i == 3 else f"text of {'abcdefgh'[i % 8] * (i % 50 + 1)}\n{legal}\n​", 1, 2, "z"))
    return rows


@pytest.mark.parametrize("dense", [256, 5, 2])
def test_against_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(module, "DENSE", dense)
    rows = sample()
    found = [(x.chunk_id, x.line_no) for x in repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows) and found


def test_containers_of_variants_are_united(spark, monkeypatch):
    monkeypatch.setattr(module, "DENSE", 4)
    bits = {(1, 10): [1, 2], (1, 11): [2, 9], (2, 10): [1, 2, 3, 4, 5], (2, 11): [5, 40], (3, 10): [7], (4, 10): [0, 1, 2], (4, 11): [0, 1, 2]}
    rows = [("s", k, 0, 50, 0, v, at) for (k, v), every in bits.items() for at in [*every, every[0]]]
    lines = spark.createDataFrame(rows, "source string, a bigint, b bigint, n_docs bigint, bucket bigint, variant bigint, at bigint")
    parts = module.variants(lines)
    assert {(r.a, r.variant): (r.card, r.bitmap is not None) for r in parts.collect()} == {k: (len(set(v)), len(set(v)) >= 4) for k, v in bits.items()}
    out = {r.a: (r.card, r.bits, r.bitmap is not None) for r in module.united(parts).collect()}
    assert out == {1: (3, None, True), 2: (6, None, True), 3: (1, [7], False), 4: (3, None, True)}


def test_letter_case_of_letters_that_look_alike():
    for a, b in (("УЧЕБНИК", "учебник"), ("У", "y"), ("Вода", "ВОДА"), ("ΑΒΓ", "αβγ"), ("Ёлка", "ёлка"), ("page 12", "PAGE  7"), ("ＰＡＧＥ", "page"), ("ﬁn", "FIN")):
        assert line_key(a) == line_key(b), (a, b)
    for a, b in (("ß", "ss"), ("é", "e"), ("²", "2"), ("a.", "a"), ("в", "г")):
        assert line_key(a) != line_key(b), (a, b)


def test_lines_are_taken_out(spark):
    rows = [(i, IDS[i], "s", f"head {'x' * (i + 1)}\nShare this page\ntail {'y' * (i + 1)}", 0, 0, "") for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.chunk_id: r.text for r in without_lines(df, repeated_lines(df)).collect()}
    assert out == {i: f"head {'x' * (i + 1)}\ntail {'y' * (i + 1)}" for i in range(6)}


def test_too_few_documents_and_empty_table(spark):
    rows = [(i, IDS[i % 3], "s", "the same line", 0, 0, "") for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert repeated_lines(df).count() == 0
    assert repeated_lines(df.limit(0)).count() == 0

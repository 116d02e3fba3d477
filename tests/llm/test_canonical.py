import unicodedata
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

import studyloom.llm.canonical as module
from studyloom.llm.canonical import Trie, canonical, certain, chosen, clean, compose, context_of, look_classes, same_look, words
from studyloom.llm.lookalikes import skeleton, unify

SCHEMA = "i bigint, text string, canonical string, word string"
SAME = ["A careful reader", "Α cаrеful rеаdеr", "Ａ　ｃａｒｅｆｕｌ ｒｅａｄｅｒ", "A care­ful rea​der"]
OTHER = ["a careful reader", "A careful reáder", "A careful reader.", "A careful reader²", "A careful reader2"]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def test_same_look_and_only_that(spark):
    found = {(r.id_a, r.id_b) for r in same_look(rows(spark, [*SAME, *OTHER, SAME[0], None, "", "​"]), "i").collect()}
    copy, empty, invisible = len(SAME) + len(OTHER), len(SAME) + len(OTHER) + 2, len(SAME) + len(OTHER) + 3
    assert found == set(combinations(range(len(SAME)), 2)) | {(i, copy) for i in range(1, len(SAME))} | {(empty, invisible)}


def test_canonical_form_and_edges(spark):
    out = {r.i: r.canonical for r in canonical(rows(spark, [*SAME, None, "", "с ним дом", "c ним дoм", "ß", "ss", "x" * 200_000 + "​"]), "i").collect()}
    assert {out[i] for i in range(len(SAME))} == {SAME[0]}
    n = len(SAME)
    assert (out[n], out[n + 1]) == (None, "")
    assert out[n + 2] == out[n + 3] == "с ним дом"
    assert out[n + 4] != out[n + 5]
    assert out[n + 6] == "x" * 200_000


def test_empty_table(spark):
    assert same_look(rows(spark, ["a"]).limit(0), "i").count() == 0


def test_trie_is_a_weighted_automaton():
    t = Trie()
    for w in ("careful", "carefil", "fish", "ёж"):
        t.add(w, (1, 0, 0))
    assert set(t.spellings("cа​rеful")) == {"careful"}
    assert set(t.spellings("ﬁsh")) == {"fish"}
    assert set(t.spellings(unicodedata.normalize("NFD", "ёж"))) == {"ёж"}
    assert set(t.spellings("careful", budget=1)) == {"careful", "carefil"}
    assert t.spellings("caréful") == {}
    assert clean("дом") and clean("Zürich") and not clean("дoм") and not clean("a​b")


ALPHABET = "aаeеoοсcpр ЁёйиŃ̈​ﬁ１1ß\r\n"


def form(text, known):
    plain = unify(text)
    return compose(text, context_of(words(plain)), known)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=12), st.text(alphabet=ALPHABET, max_size=12))
def test_canonical_is_equal_exactly_for_equal_looks(a, b):
    assert (form(a, {}) == form(b, {})) == (skeleton(a) == skeleton(b))
    assert skeleton(form(a, {})) == skeleton(a)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aаcсoоpрTТEЕxф t", min_size=1, max_size=8), min_size=1, max_size=12))
def test_attested_spellings_keep_looks_apart_and_together(texts):
    """The whole job by hand: a vocabulary with counts, the automaton's choice for every word that isn't certain."""
    trie, asked = Trie(), set()
    for t in texts:
        found = words(unify(t))
        k = context_of(found)
        for w in found:
            if clean(w):
                trie.add(w, tuple(int(i == k) for i in range(3)))
            if not certain(w, k):
                asked.add(w)
    best = {w: chosen(w, trie.spellings(w)) for w in asked}
    forms = [form(t, {w: b[context_of(words(unify(t)))] for w, b in best.items()}) for t in texts]
    for (a, f), (b, g) in combinations(zip(texts, forms, strict=True), 2):
        assert (f == g) == (skeleton(a) == skeleton(b))


def test_attested_spelling_goes_before_the_table(spark):
    """ТЕСТ is always stored in Cyrillic, though in Latin texts: so is its form. Without the automaton's matches it would be Latin."""
    cyrillic, mixed = "ТЕСТ", "TЕСТ"
    texts = [f"The {cyrillic} is number {i}" for i in range(5)] + [f"The {mixed} is number 0", "The сору is a copy", "The сoру is a copy"]
    out = {r.i: r.canonical for r in canonical(rows(spark, texts), "i").collect()}
    assert out[5] == out[0] == f"The {cyrillic} is number 0"
    assert form(texts[5], {}) == "The TECT is number 0" != out[5]
    assert out[6] == out[7] == "The copy is a copy"  # attested in Latin, and plain
    found = {(r.id_a, r.id_b) for r in same_look(rows(spark, texts), "i").collect()}
    assert found == {(0, 5), (6, 7)}


def test_most_frequent_spelling_wins_outside_latin_texts():
    trie = Trie()
    trie.add("сор", (0, 9, 0))
    trie.add("cop", (5, 2, 0))
    reached = trie.spellings("cоp")
    assert chosen("cоp", reached) == ["cop", "сор", "сор"]
    assert chosen("фыjж", {}) == [None] * 3


def test_line_ends_with_something_invisible_inside(spark):
    found = {(r.id_a, r.id_b) for r in same_look(rows(spark, ["one\r\ntwo", "one\r\u200b\ntwo", "one\ntwo", "one\n\ntwo"]), "i").collect()}
    assert found == {(0, 1), (0, 2), (1, 2)}


def test_classes_and_large_classes(spark, monkeypatch):
    texts = ["same text"] * 7 + ["sаme text"] * 3 + ["other"]
    out = {r.text_id: (r.n_texts, r.n_links) for r in look_classes(rows(spark, texts), "i").collect()}
    assert out == {i: (10, 3 if i < 7 else 7) for i in range(10)}
    monkeypatch.setattr(module, "ROWS_A_KEY", 3)
    pairs = [(r.id_a, r.id_b) for r in same_look(rows(spark, texts), "i").collect()]
    assert sorted(pairs) == [(a, b) for a in range(7) for b in range(7, 10)]

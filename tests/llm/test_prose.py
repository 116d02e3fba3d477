import random

import numpy as np

import studyloom.llm.prose as module
from studyloom.llm.prose import Classes, Model, classify, spam_pages, without_contents

SYLLABLES = "ba cor dun fel gar hin jol kam lor men nor pal ras sol tam vel".split()
NOUNS = [f"{a}{b} {b}{c}{a}" for a in SYLLABLES for b in SYLLABLES for c in SYLLABLES[:6]]  # as many words as prose has
KEYS = ["cheap planner", "online tutor", "essay help", "top rated", "fast delivery"]
SCHEMA = "doc_id bigint, text string, bits double, lines string, prose boolean"


def pages():
    r = random.Random(6)

    def sentence():
        a, b, k = r.choice(NOUNS), r.choice(NOUNS), r.randint(2, 99)
        return r.choice([
            f"The chapter treats {a} as a consequence of {b}.", f"Readers often confuse {a} with {b}, because both depend on it.", f"In the north {a} rose by {k} percent once the snow had gone.",
            f"This is a page about {a} and {b}.", f"A short note on {a} was found in the house.", f"There is more to {a} than the {k} cases of the survey.", f"What do we know about {a}?",
            f"Those who measured {a} near the river saw that {b} had changed.", f"It is not {a} but {b} that they were after, as the map shows.", f"For {k} years nobody asked about the origin of {a}.",
        ])

    def prose(n):
        return " ".join(sentence() for _ in range(n))

    good = [prose(r.randint(2, 12)) for _ in range(400)]
    good += ["\n".join(f"{i}. {r.choice(NOUNS).capitalize()} {'ABCDEFGHIJKL'[i]} ..... {i * 4 + 2}" for i in range(9)) for _ in range(5)]
    good += [prose(6) + "\n" + "\n".join(f"{i}. Author, {r.choice(NOUNS)}, {1980 + i}. https://site.example/{i}" for i in range(1, 4)) for _ in range(5)]
    good += ["A short page about the river.", ""]
    spam = [" ".join(r.choice(KEYS) for _ in range(60)) for _ in range(6)]
    spam += [prose(1) + "\n" + ", ".join(r.choice(KEYS) for _ in range(150)), " ".join("#" + r.choice(KEYS).replace(" ", "") for _ in range(40))]
    spam += ["\n".join(f"{r.choice(KEYS)} Town{i} https://shop{i}.invalid/{i}" for i in range(20)), "\n".join(f"{r.choice(KEYS)} blue SKU-{i}123 $9.{i}0" for i in range(20))]
    spam += [" ".join(".".join(r.choice(KEYS).replace(" ", "")) for _ in range(40))]
    return good, spam


def test_spam_is_found_and_prose_is_not(spark):
    good, spam = pages()
    rows = [(i, t, 0.0, "", True) for i, t in enumerate([*good, *spam])] + [(9999, None, 0.0, "", True)]
    out = {r.doc_id: r.is_spam for r in spam_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == len(good) + len(spam)
    assert not [i for i in range(len(good)) if out[i]]
    assert all(out[len(good) + i] for i in range(len(spam)))


def test_empty_table(spark):
    assert spam_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_model_decides(spark, monkeypatch):
    """With every class as likely as any other no page is spam, whatever it is made of: nothing stands beside the model."""
    good, spam = pages()
    rows = spark.createDataFrame([(i, t, 0.0, "", True) for i, t in enumerate([*good, *spam])], SCHEMA)
    assert spam_pages(rows).filter("is_spam").count() == len(spam)
    monkeypatch.setattr(module, "_scoring", lambda model: _blind(model))
    assert spam_pages(rows).filter("is_spam").count() == 0


def _blind(model):
    import pyarrow as pa

    def score(batches):
        for batch in batches:
            n = batch.num_rows
            even = np.full(n, model.middle)  # as if each class cost the same
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ones(n, np.int64)), pa.array(even), pa.array(model.deviation(even, np.ones(n)))], names=["doc_id", "n_classes", "bits", "deviation"])

    return score


def test_a_page_is_judged_by_its_greater_part(spark):
    good, spam = pages()
    rows = [(i, t, 0.0, "", True) for i, t in enumerate(good)]
    words = ", ".join(["cheap planner", "online tutor"] * 40)
    rows += [(9000, good[3] * 12 + "\n" + words, 0.0, "", True), (9001, good[3] + "\n" + words * 4, 0.0, "", True)]
    out = {r.doc_id: r.is_spam for r in spam_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not out[9000] and out[9001]


def test_without_prose_there_is_no_model(spark):
    _, spam = pages()
    assert spam_pages(spark.createDataFrame([(i, t, 0.0, "", True) for i, t in enumerate(spam)], SCHEMA)).filter("is_spam").count() == 0


def test_classes():
    known = Classes()
    classes, sizes = classify(["The river ran, the river bent.", "", "see https://a.example/x #Tag 5 $ ....", "Ｔｈｅ ri\u200bver"], known)
    named = {v: k for k, v in {**module._WORDS, **module._NAMED}.items()}
    names = [named.get(c, c - module.OPEN) for c in classes.tolist()]
    assert sizes.tolist() == [8, 0, 6, 2]
    assert names[:8] == ["the", 0, 0, ",", "the", 3, 0, "."] and names[9:14] == ["url", "tag", "number", "amount", "dots"]
    assert names[14:] == ["the", 0]


def test_trigrams_against_counting_by_hand():
    classes, sizes = np.array([3, 4, 3, 4, 5]), np.array([2, 3])
    tri, bi = module._grams(classes, sizes)
    k, line = module.KINDS, module._LINE
    want = [(line, line, 3), (line, 3, 4), (line, line, 3), (line, 3, 4), (3, 4, 5)]
    assert tri.tolist() == [(a * k + b) * k + c for a, b, c in want] and bi.tolist() == [b * k + c for _, b, c in want]
    keys, n = np.unique(tri, return_counts=True)
    pairs, m = np.unique(bi, return_counts=True)
    bits = Model(keys, n, pairs, m).bits(classes, sizes)
    assert bits.shape == (5,) and bits[0] == bits[2] and bits[0] < bits[4]


def test_lists_of_contents_are_left_out():
    contents = "1. Rivers ..... 3\n2. Terraces 7\n3. Grain prices ... 7"
    assert without_contents(contents) == "" and without_contents("Head\n" + contents + "\nA tail.") == "Head\nA tail."
    for kept in ("Buy now 7\nBuy now 5\nBuy now 3", "Pens $ 7.41\nPens $ 8.12\nPens $ 9.99", "one 1\ntwo 2\nthree", ""):
        assert without_contents(kept) == kept

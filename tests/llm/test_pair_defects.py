import random

import numpy as np

from studyloom.llm import pair_defects, truncation
from studyloom.llm.pair_defects import LabelModel, best_cutoff, declining, defects

TOPIC = ["river terraces", "loan words", "grain prices", "night cooling", "salt intrusion", "pollen counts", "tree rings", "market rents", "bird song", "ice cover"]
SCHEMA = "row bigint, question string, answer string, labels string, v_empty int"


def pairs(n=1200):
    r = random.Random(2)
    rows, want = [], {}
    for i in range(n):
        a, b, c = r.sample(TOPIC, 3)
        q = r.choice([f"How does {a} change when {b} is measured near the coast?", f"Why did the survey of {r.randint(1900, 2000)} link {a} to {b}?", f"Which role does {a} play in {b} according to table {r.randint(2, 99)}?"])
        ans = r.choice([f"It depends mainly on {c}, which was strongest around {r.randint(1900, 2000)}.", f"The main difference is that only {a} responds to {c}.", f"{c}".capitalize(), f"what changes first is {c}, and the rest adjusts within {r.randint(2, 99)} days"])
        k = i % 40
        if k == 0:
            ans, want[i] = r.choice(["", None, " \t", "N/A", "[no answer]", "...", "​"]), "empty"
        elif k == 1:
            ans, want[i] = r.choice(["I don't know.", "Sorry, I cannot answer this question.", "je ne sais pas", "no idea, skip this one", "Lo siento, no puedo responder a esta pregunta."]), "refusal"
        elif k == 2:
            ans, want[i] = r.choice([q, q.upper(), "Question: " + q, f"{q} {q}"]), "copy"
        elif k == 3:
            ans, want[i] = r.choice(["Es hängt vor allem von der Verdunstung ab, und zwar seit dem Jahr 1912.", "Всё зависит прежде всего от влажности почвы, а не от ветра.", "Se debe sobre todo a que la humedad del suelo es más débil en el valle."]), "language"
        rows.append((i, q, ans, "x", 9))
    return rows, want


def test_defects_are_told_apart(spark):
    rows, want = pairs()
    out = {r.row: list(r.labels) for r in defects(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == len(rows)
    found = {i: x[0] for i, x in out.items() if x}
    right = sum(found.get(i) == d for i, d in want.items())
    assert right >= 0.95 * len(want)
    assert sum(i not in want for i in found) <= 0.02 * len(rows)


def test_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, None, "", 0), (2, None, "A whole answer about bird song.", "", 0), (3, "", "", "", 0)], SCHEMA)
    out = {r.row: list(r.labels) for r in defects(df).collect()}
    assert out[1] == ["empty"] and out[3] == ["empty"] and "empty" not in out[2]
    assert defects(df.limit(0)).count() == 0


def test_stored_pairs_are_not_written_again(spark, monkeypatch):
    written = []
    monkeypatch.setattr(pair_defects, "cut", lambda df, plain=pair_defects.cut: written.append(df.columns) or plain(df))
    stored = pair_defects.cut(spark.createDataFrame(pairs(200)[0], SCHEMA))
    del written[:]
    labels = {r.row: r.labels for r in defects(stored, stored=True).collect()}
    assert ["row", "question", "answer"] not in written
    assert labels == {r.row: r.labels for r in defects(stored).collect()}


def test_marks_are_sought_only_where_a_text_can_end_with_one(monkeypatch):
    texts = ["It ends here.", "x ..", "x ... ", "a [...]", "a […]\n", "b…", "b [5]", ".", "", "a. . ..", "..."]
    want = [truncation._MARK.sub("", x.rstrip()) for x in texts]

    class Mark:
        sought = []

        def sub(self, to, text, plain=truncation._MARK):
            self.sought.append(text)
            return plain.sub(to, text)

    monkeypatch.setattr(truncation, "_MARK", Mark())
    assert [truncation.ending(x)[0] for x in texts] == want
    assert texts[0] not in Mark.sought


def test_label_model_and_cutoff():
    r = np.random.default_rng(0)
    truth = r.random(20000) < 0.05
    votes = np.stack([np.where(r.random(20000) < 0.9, truth, ~truth), np.where(r.random(20000) < 0.97, truth, ~truth), np.where(r.random(20000) < 0.95, truth, ~truth)], 1) * 2 - 1
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    m = LabelModel().fit(patterns, n.astype(float))
    assert abs(m.prevalence - truth.mean()) < 0.02
    p = m.posterior(votes)
    assert (((p > 0.5) == truth).mean()) > 0.985
    assert 0.2 <= best_cutoff(m.posterior(patterns), n.astype(float)) <= 0.8
    assert best_cutoff(np.zeros(0), np.zeros(0)) == 0.5


def test_refusals_that_name_their_topic(spark):
    rows, _ = pairs()
    r = random.Random(4)
    named = {}
    for i in range(5000, 5012):
        a, b = r.sample(TOPIC, 2)
        named[i] = r.choice([f"I'm sorry, I can't answer the question on {a} and {b}.", f"As an assistant I am unable to comment on {a}, {b} or anything like it.", f"Leider kann ich die Frage zu {a} und {b} nicht beantworten.", f"I don't know how {a} and {b} go together."])
    whole = {6000 + i: f"{a.capitalize()} followed {b} and {c} in the report, which answers the question." for i, (a, b, c) in enumerate(r.sample(TOPIC, 3) for _ in range(12))}
    rows += [(i, f"How does {TOPIC[i % 10]} change with the wind?", t, "x", 9) for i, t in [*named.items(), *whole.items()]]
    out = {x.row: list(x.labels) for x in defects(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[i][:1] == ["refusal"] for i in named)
    assert not any("refusal" in out[i] for i in whole)


def test_declining():
    assert [declining(x) for x in ("i can't say", "pass", "the pass is open", "no lo sé", "lo siento, no puedo", "weiß ich nicht", "désolé", "je ne peux pas", "не знаю", "не могу ответить", "jsp", "it isn't possible")] == [
        (True, True), (False, True), (False, False), (False, True), (True, False), (True, True), (True, False), (True, False), (False, True), (True, False), (False, True), (True, False),
    ]

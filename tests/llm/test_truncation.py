import math
import random

import numpy as np

from studyloom.llm.truncation import censored_fit, ending, endings, items, truncated, truncation_rates

NOUNS = ["river terraces", "loan words", "grain prices", "night cooling", "salt intrusion", "pollen counts", "tree rings", "market rents"]
SCHEMA = "field_name string, record_key string, source string, text string, row bigint, censored double"


def sentence(r):
    a, b = r.sample(NOUNS, 2)
    return r.choice([f"The chapter treats {a} as a consequence of {b}.", f"Readers often confuse {a} with {b}, because both depend on the weather.", f"In the north {a} rose by {r.randint(2, 900)} percent once {b} had settled."])


def corpus(n=1500):
    r = random.Random(3)
    rows, cut = [], set()
    for i in range(n):
        t = " ".join(sentence(r) for _ in range(r.randint(1, 5)))
        if i % 12 == 0 and len(t) > 90:
            t = t[:80] if i % 24 == 0 else t[: r.randint(30, len(t) - 12)]
            if t[-1] not in ". ":
                cut.add(str(i))
            else:
                t = t.rstrip(". ") + "."
        elif i % 12 == 1:
            t = f"{t} {r.choice(NOUNS)}; {r.choice(NOUNS)}; {r.choice(NOUNS)}"
        elif i % 12 == 2:
            t = t.rstrip(".") + f" (sheet {i})"
        elif i % 12 == 3:
            t = r.choice(NOUNS).capitalize()
        rows.append(("f", str(i), "s" if i % 3 else None, t, 1, 0.0))
    return rows, cut


def test_finds_cuts_among_unusual_endings(spark):
    rows, cut = corpus()
    out = truncated(spark.createDataFrame([*rows, ("f", "null", "s", None, 1, 0.0), ("f", "blank", "s", " \n", 1, 0.0)], SCHEMA)).collect()
    assert len(out) == len(rows) + 2
    found = {r.record_key for r in out if r.is_truncated}
    assert len(found & cut) >= 0.9 * len(cut)
    assert len(found - cut) <= 0.1 * len(cut)
    assert {r.record_key: r.posterior for r in out if r.record_key in ("null", "blank")} == {"null": 0.0, "blank": 0.0}


def test_rates_and_empty_table(spark):
    rows, _ = corpus(200)
    df = spark.createDataFrame(rows, SCHEMA)
    rates = {r.source: r for r in truncation_rates(truncated(df)).collect()}
    assert sum(r.n_values for r in rates.values()) == 200 and None in rates
    assert truncated(df.limit(0)).count() == 0
    assert endings(spark.createDataFrame([(1, None)], "row bigint, text string")).count() == 0


def test_censored_fit_recovers_the_distribution():
    r = np.random.default_rng(1)
    full = np.exp(r.normal(5.0, 0.6, 20000)).astype(int) + 1
    held = np.minimum(full, 200)
    lengths, counts = np.unique(held, return_counts=True)
    mean, sd = censored_fit(lengths, counts, np.array([200]))
    assert abs(mean - 5.0) < 0.1 and abs(sd - 0.6) < 0.1
    blind = censored_fit(lengths, counts, np.array([]))
    assert abs(mean - 5.0) < abs(blind[0] - 5.0)
    assert math.isfinite(sd)


def test_endings_of_text():
    assert ending("it ends here.") == ("it ends here.", False, True)
    assert ending("it ends her [...]") == ("it ends her", True, False)
    assert ending("and so on ...")[2] and ending('he said "yes."')[2] and not ending("as in [5]")[2]
    frame, words, width, closing = items("the old town, 12 l'eau https://a.example/b")
    assert frame == ["the", "X", ",", "#", "l", "X", "URL"] and words == ["the", "old", "town", "l'", "eau"] and len(width) == 7 and not closing
    assert items("one. two (5). three; four")[3] == ["one", "three"]


def test_copies_of_a_cut_text_are_cut(spark):
    rows, _ = corpus()
    cut = "Whoever compares the older maps of tree rings, as in the"
    looks = [cut, cut.upper(), cut.replace("o", "о")]  # the last with Cyrillic letters
    copies = [("f", f"c{i}", "s", looks[i % 3], 1, 0.0) for i in range(50)]
    out = {r.record_key: r for r in truncated(spark.createDataFrame([*rows, *copies], SCHEMA)).collect()}
    assert len(out) == len(rows) + 50
    assert all(out[f"c{i}"].is_truncated for i in range(50))


def test_limits_of_a_source_are_judged_together(spark):
    """Values cut at a limit after a whole word say little by their ending; the limit says the rest. Without the length fit the
    same values stay below the cutoff."""
    r = random.Random(9)
    rows, _ = corpus(3000)
    rows = [x for x in rows if not x[3].endswith(NOUNS[0])]
    cut = []
    for i in range(400):
        t = " ".join(sentence(r) for _ in range(5))[:120]
        if t[-1].isalpha():
            cut.append(("f", f"limit{i}", "limited", t, 1, 0.0))
    free = [("f", f"free{i}", "limited", " ".join(sentence(r) for _ in range(r.randint(1, 5))), 1, 0.0) for i in range(900)]
    out = {x.record_key: x for x in truncated(spark.createDataFrame([*rows, *cut, *free], SCHEMA)).collect()}
    at = [out[c[1]] for c in cut]
    assert all(x.limit_posterior > 0.5 for x in at)
    assert sum(x.is_truncated for x in at) >= 0.97 * len(at)
    assert all(not out[f[1]].is_truncated for f in free)


def test_a_cut_value_with_a_blank_at_its_end(spark):
    rows, _ = corpus()
    ends = ["In the north tree rings rose by ", "In the north tree rings rose by 12 percent once loan words had settled. "]
    out = {r.record_key: r for r in truncated(spark.createDataFrame([*rows, *[("f", f"b{i}", "s", t, 1, 0.0) for i, t in enumerate(ends)]], SCHEMA)).collect()}
    assert out["b0"].is_truncated and not out["b1"].is_truncated

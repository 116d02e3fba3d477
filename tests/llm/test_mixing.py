import random

from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from studyloom.llm.mixing import fill_up, mix, newton, shares

SCHEMA = "doc_id bigint, text string, source string, rate double, cap int, mix_id int"


def tables(spark):
    r = random.Random(4)
    rows = [(i, "word " * r.randint(5, 300), r.choice("aaaaabbc"), 0.0, 0, 0) for i in range(800)]
    rows += [(900, None, "a", 0.0, 0, 0), (901, "", "a", 0.0, 0, 0), (902, "text of no source", None, 0.0, 0, 0), (903, "word " * 9000, "c", 0.0, 0, 0)]
    targets = [(1, "a", 0.5, 1), (1, "b", 0.3, 2), (1, "c", 0.2, 4), (2, "c", 0.6, 8), (2, "a", 0.4, 1), (3, "b", 0.5, 2), (3, "gone", 0.5, 2)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(targets, "mix_id int, source string, target_share double, max_repeats int")


def test_shares_meet_targets_within_caps(spark):
    docs, targets = tables(spark)
    mixed = mix(docs, targets)
    caps = {(t.mix_id, t.source): t.max_repeats for t in targets.collect()}
    assert all(0 <= r.copies <= caps[r.mix_id, r.source] for r in mixed.collect())
    got = {(r.mix_id, r.source): r for r in shares(mixed, targets).collect()}
    assert len(got) == 7
    for (m, s), r in got.items():
        if m < 3:
            assert abs(r.actual_share - r.target_share) < 0.002, (m, s, r.actual_share)
    assert got[3, "gone"].actual_share == 0.0 and got[3, "b"].actual_share == 1.0
    # as large as the caps allow: some source is used up
    for m in (1, 2):
        assert any(r.n_copies >= 0.99 * caps[k] * docs.filter(f"source = '{k[1]}' and length(text) > 0").count() for k, r in got.items() if k[0] == m)


def test_empty_tables(spark):
    docs, targets = tables(spark)
    assert mix(docs.limit(0), targets).count() == 0
    assert mix(docs, targets.limit(0)).count() == 0
    assert {r.actual_share for r in shares(mix(docs.limit(0), targets), targets).collect()} == {0.0}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=8), st.floats(0, 120))
def test_fill_up_comes_as_near_as_any_choice(tokens, missing):
    taken = fill_up(tokens, missing)
    assert len(set(taken)) == len(taken)
    best = min(abs(missing - sum(c)) for k in range(len(tokens) + 1) for c in combinations(tokens, k))
    assert abs(missing - sum(tokens[k] for k in taken)) <= best + 1


def test_newton_meets_the_target():
    r = np.random.default_rng(1)
    tokens, n = np.arange(1.0, 400.0), r.integers(0, 50, 399).astype(float)
    total, mean = float((tokens * n).sum()), float((tokens * n).sum() / n.sum())
    for cap, share in ((1, 0.01), (1, 0.5), (3, 0.9), (3, 2.5), (8, 7.9)):
        lam = newton(tokens, n, share * total, cap, mean)
        got = float((n * tokens * np.minimum(cap, np.exp(lam * tokens / mean))).sum())
        assert abs(got - share * total) < 1e-6 * total

import random
from collections import Counter, defaultdict
from itertools import combinations, count

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from studyloom.llm import near_copies
from studyloom.llm.containers import best_fit, fill_containers, fill_rates
from studyloom.llm.near_copies import components, copy_classes, links, shingles

SCHEMA = "doc_id bigint, text string, source string, spec_id int, capacity string, shard int"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.sampled_from(["a", "b", None]), st.integers(0, 3)), max_size=60))
def test_best_fit_keeps_its_promises(found):
    sizes, sources, clusters = ([x[k] for x in found] for k in range(3))
    bins = best_fit(sizes, sources, clusters, 50)
    load, held = Counter(), defaultdict(Counter)
    for s, c, b in zip(sizes, clusters, bins, strict=True):
        load[b] += s
        held[b][c] += 1
    assert all(v <= 50 for v in load.values())
    need = max(1, -(-sum(sizes) // 50))
    counts = Counter(clusters)
    assert all(n <= max(1, -(-counts[c] // need)) for by in held.values() for c, n in by.items())
    by_source = defaultdict(Counter)
    for s, b in zip(sources, bins, strict=True):
        by_source[b][s] += 1
    counts = Counter(x for x in sources if x is not None)
    assert all(n <= 3 * -(-counts[x] // need) + 1 for by in by_source.values() for x, n in by.items() if x is not None)


def test_near_copies_are_apart(spark):
    r = random.Random(2)
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ab", "ec", "id", "of", "ug")]
    base = [" ".join(r.choice(words) for _ in range(120)) for _ in range(12)]
    rows = [(10 * k + n, (t if n == 0 else t.upper() + "!" if n == 1 else t + " " + r.choice(words)), None, 0, "", 0) for k, t in enumerate(base) for n in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    classes = {x.doc_id: x.cluster for x in copy_classes(docs.select("doc_id", "text")).collect()}
    assert len(set(classes.values())) == 12 and all(classes[10 * k] == classes[10 * k + n] for k in range(12) for n in range(3))
    placed = fill_containers(docs, spark.createDataFrame([(1, "n", 4000)], "spec_id int, spec_name string, capacity_tokens int")).collect()
    held = defaultdict(Counter)
    for p in placed:
        held[p.container_id][p.doc_id // 10] += 1
    need = len(held)
    assert all(n <= -(-3 // need) for by in held.values() for n in by.values())


def test_links_against_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(60):
        t = [r.choice(words) for _ in range(100)]
        texts.append(t)
        for change in r.sample(range(1, 6), 3):
            u = list(t)
            for _ in range(change):
                u[r.randrange(len(u))] = r.choice(words)
            texts.append(u)
    joined = [" ".join(t) for t in texts]
    own = [set(shingles(t).tolist()) for t in joined]
    alike = {(b, a) for a, b in combinations(range(len(own)), 2) if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])}
    found = {(x.a, x.b) for x in links(spark.createDataFrame(list(enumerate(joined)), "key bigint, words string")).collect()}
    assert found <= alike
    part = {x.key: x["class"] for x in components(spark.createDataFrame(sorted(found), "a bigint, b bigint")).collect()}
    assert sum(part.get(a) == part.get(b) and a in part for a, b in alike) >= 0.98 * len(alike)


@pytest.mark.parametrize(("few", "salted"), [(64, 2048), (2, 16)])
def test_classes_of_forms_are_whole(spark, monkeypatch, few, salted):
    # forms of which most is the same in all, so that each has more in common with many that are no near copy than minhashes tell apart
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "SALTED", salted)
    r = random.Random(4)
    fresh = (f"w{i}" for i in count())
    rows = []
    for same in (60, 86):
        form = [next(fresh) for _ in range(same)]
        for _ in range(90):
            own = [next(fresh) for _ in range(104 - same)]
            near = own[: len(own) - r.choice([7, 8, 9, 10, 11, 12, 13])]
            near += [next(fresh) for _ in range(len(own) - len(near))]
            rows += [" ".join(form + own), " ".join(form + near)]
    r.shuffle(rows)
    sets = [set(shingles(t).tolist()) for t in rows]
    alike = {(b, a) for a, b in combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert 60 < len(alike) < 180
    found = {(x.a, x.b) for x in links(spark.createDataFrame(list(enumerate(rows)), "key bigint, words string")).collect()}
    assert found == alike  # every class is a pair: no link may be missed


def test_copy_classes_of_odd_texts(spark):
    rows = [(1, "Hello world"), (2, "hello, WORLD."), (3, "123"), (4, "456"), (5, "123"), (6, ""), (7, None), (8, "Hello")]
    out = {x.doc_id: x.cluster for x in copy_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(out) == {1, 2, 3, 4, 5, 8} and out[1] == out[2] and out[3] == out[5] and len(set(out.values())) == 4
    assert copy_classes(spark.createDataFrame(rows, "doc_id bigint, text string").limit(0)).count() == 0


def test_everything_is_placed_and_only_long_texts_are_split(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randint(1, 400))), r.choice(["a", "b", None]), 7, "z", 1) for i in range(300)]
    rows += [(1000 + i, "the same words again", "a", 7, "z", 1) for i in range(100)] + [(2000, None, "a", 7, "z", 1), (2001, "", "a", 7, "z", 1), (2002, "word " * 5000, "b", 7, "z", 1)]
    specs = spark.createDataFrame([(1, "n", 128), (2, "n", 512), (3, "n", None), (4, "n", 0)], "spec_id int, spec_name string, capacity_tokens int")
    docs = spark.createDataFrame(rows, SCHEMA)
    placed = fill_containers(docs, specs)
    got = placed.collect()
    total, load, pieces = Counter(), Counter(), Counter()
    for p in got:
        total[p.spec_id, p.doc_id] += p.n_tokens
        load[p.spec_id, p.container_id] += p.n_tokens
        pieces[p.spec_id, p.doc_id] += 1
    cap = {1: 128, 2: 512}
    assert {s for s, _ in total} == {1, 2}
    assert {d for _, d in total} == {x[0] for x in rows} - {2000, 2001}
    assert all(total[1, d] == total[2, d] for _, d in total)
    assert all(v <= cap[s] for (s, _), v in load.items())
    assert all(n == -(-total[k] // cap[k[0]]) for k, n in pieces.items())
    fill = {x.spec_id: x.fill for x in fill_rates(placed, specs).collect()}
    assert fill[1] > 0.9
    assert fill_containers(docs.limit(0), specs).count() == 0

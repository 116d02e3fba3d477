import numpy as np
import pytest

import studyloom.operators.search as module
from studyloom.operators.search import top_k, vector_report


def test_small_golden(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.8, 0.2])], "id int, v array<float>")
    got = top_k(df, df.filter("id = 1"), 2, "id", "v").orderBy("rank").collect()
    assert [(r.rank, r.id) for r in got] == [(1, 1), (2, 3)] and got[0].score == 1.0
    with pytest.raises(ValueError):
        top_k(df, df, 0, "id", "v")


def test_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(module, "VECTORS_A_BLOCK", 40)
    monkeypatch.setattr(module, "QUERIES_A_BLOCK", 7)
    r = np.random.default_rng(0)
    m = r.normal(size=(300, 8)).round(2)
    m[50] = m[10]
    rows = [(i, [float(x) for x in v], "ab"[i % 2]) for i, v in enumerate(m)] + [(900, None, "a"), (901, [], "a"), (902, [0.0] * 8, "a"), (903, [1.0, 2.0], "b")]
    df = spark.createDataFrame(rows, "vec_id int, v array<double>, rank string")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for tag in (None, "rank"):
        got = {(x.query_id, x.rank): x.id for x in top_k(df, df.filter("vec_id % 50 = 0"), 4, "vec_id", "v", tag).collect()}
        for q in range(0, 300, 50):
            score = np.round(unit @ unit[q], 6)
            ok = [i for i in range(300) if tag is None or i % 2 == q % 2]
            assert [got[q, k] for k in range(1, 5)] == sorted(ok, key=lambda i: (-score[i], i))[:4]
        assert len(got) == 24
    rep = {x["rank"]: x for x in vector_report(df, "v", "rank").collect()}
    assert (rep["a"].n_vectors, rep["a"].n_empty, rep["a"].n_zero, rep["b"].n_other_dimension) == (153, 2, 1, 1)
    assert top_k(df.limit(0), df, 3, "vec_id", "v").count() == 0

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import studyloom.operators.orphans as module
from studyloom.operators.orphans import orphan_report, orphans, references

T0 = datetime(2024, 1, 1)


def tables(n=600):
    r = random.Random(7)
    ids = [f"{r.getrandbits(128):032x}" for _ in range(80)] + ["free text id", "another"]
    catalog = [(i, T0 + timedelta(days=r.randint(0, 50)), T0 if r.random() < 0.3 else None, "x") for i in ids[:60] + ids[-1:] for _ in range(r.randint(1, 2))] + [(None, T0, None, "x"), (ids[70], None, None, "x")]
    hot = ids[3]
    refs = [(str(k), None if k % 50 == 0 else hot if k % 3 == 0 else r.choice(ids), None if k % 31 == 0 else T0 + timedelta(days=r.randint(-20, 70)), 1) for k in range(n)]
    return catalog, refs


def brute(catalog, refs):
    held = {}
    for i, added, removed, _ in catalog:
        if i:
            held.setdefault(i, []).append((added, removed))
    out = {}
    for k, d, t, _ in refs:
        if d is None:
            continue
        rows = held.get(d)
        times = [a for a, _ in rows or () if a]
        reason = "missing" if not rows else "deleted" if all(x for _, x in rows) else "late" if t and times and t < min(times) else None
        if reason:
            out[k] = reason
    return out


@pytest.mark.parametrize(("a_range", "a_group"), [(50_000, 100_000), (7, 20)])
def test_against_brute_force(spark, monkeypatch, a_range, a_group):
    monkeypatch.setattr(module, "PARENTS_A_RANGE", a_range)
    monkeypatch.setattr(module, "PROBES_A_GROUP", a_group)
    catalog, refs = tables()
    c = spark.createDataFrame(catalog, "id string, added_at timestamp, removed_at timestamp, own_time string")
    d = spark.createDataFrame(refs, "key string, doc string, at timestamp, reason int")
    d = d.withColumn("doc", F.when(F.col("key").cast("int") % 4 == 0, F.upper("doc")).otherwise(F.col("doc")))
    asked = references(d, "t", "doc", F.col("key"), "at")
    hits = orphans(asked, c)
    assert {r.record_key: r.reason for r in hits.collect()} == brute(catalog, refs)
    report = orphan_report(hits, asked).collect()
    assert sum(r.n_references for r in report) == asked.count()
    assert sum(r.n_missing + r.n_deleted + r.n_late for r in report) == hits.count()


def test_empty_sides(spark):
    catalog, refs = tables(30)
    c = spark.createDataFrame(catalog, "id string, added_at timestamp, removed_at timestamp, own_time string")
    asked = references(spark.createDataFrame(refs, "key string, doc string, at timestamp, reason int"), "t", "doc", F.col("key"), "at")
    assert {r.reason for r in orphans(asked, c.limit(0)).collect()} == {"missing"}
    assert orphans(asked.limit(0), c).count() == 0

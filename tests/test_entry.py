import importlib.util

import pytest

import __spark_entry__ as entry

NAMES = sorted(n for n in entry.queries() if not n.startswith("p") or n.startswith(("p3", "progress", "page", "package", "prompt")))


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, sf):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    got = entry.queries()[name](spark, sf)
    rows = sorted(map(repr, got.select(*sorted(got.columns)).collect()))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    import os

    for f in os.listdir(sf):
        c.sql(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    want = c.sql(sql)
    names = [d[0] for d in want.description]
    order = [names.index(n) for n in sorted(got.columns)]
    assert sorted(names) == sorted(got.columns)
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    mine = sorted(repr(tuple(flat(v) for v in r)) for r in got.select(*sorted(got.columns)).collect())
    theirs = sorted(repr(tuple(flat(r[i]) for i in order)) for r in want.fetchall())
    assert mine == theirs


def test_core_does_not_need_the_text_package():
    import ast
    from pathlib import Path

    root = Path(importlib.util.find_spec("studyloom").origin).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            used = [n.module or "" for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not [m for m in used if m.startswith("studyloom.llm")], p

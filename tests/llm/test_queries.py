import os

import pytest

from studyloom.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "p1_found": ["table_name", "id_a", "id_b"], "p2_found": ["chunk_id", "line_no"], "p4_found": ["field_name", "record_key"], "p5_found": ["record_kind", "record_key", "defect"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf)
    rows = got.collect()
    assert rows
    if name in COLUMNS:
        assert got.columns == COLUMNS[name]
        keys = [tuple(r)[:2] if name == "p5_found" else tuple(r) for r in rows]
        assert len(keys) == len(set(keys))
    if name in ORACLES:
        duckdb = pytest.importorskip("duckdb")
        c = duckdb.connect()
        for f in os.listdir(sf):
            c.sql(f"create view {f[:-8]} as select * from '{sf}/{f}'")
        want = c.sql(ORACLES[name])
        order = [[d[0] for d in want.description].index(n) for n in got.columns]
        assert sorted(tuple(r) for r in rows) == sorted(tuple(r[i] for i in order) for r in want.fetchall())

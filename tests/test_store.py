import pytest

from studyloom.functions.json_strict import canonical_object, fingerprint, strict_value
from studyloom.functions.text import ascii_lower, casefold, collapse, strip, tidy_page, uuid_key
from studyloom.operators.store import Snapshots, add_column, put, replace_by_key, without


def test_put_is_idempotent_and_tells_conflicts(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (None, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (1, "a"), (2, "x"), (3, "c"), (3, "c"), (4, "d"), (4, "e"), (None, None)], "k int, v string")
    got = {r.k: r.outcome for r in put(stored, new, ["k"]).collect()}
    assert got == {1: "unchanged", 2: "conflict", 3: "inserted", 4: "conflict", None: "unchanged"}
    assert put(stored, new.limit(0), ["k"]).count() == 0


def test_replace_remove_add_column(spark):
    stored = spark.createDataFrame([("d", 1, "x"), ("d", 2, "x"), ("e", 1, "y"), (None, 1, "z")], "doc string, i int, only_old string")
    new = spark.createDataFrame([("d", 9)], "doc string, i int")
    got = {(r.doc, r.i, r.only_old) for r in replace_by_key(stored, new, "doc").collect()}
    assert got == {("d", 9, None), ("e", 1, "y"), (None, 1, "z")}
    assert without(stored, new, "doc").count() == 2
    wider = add_column(stored, "extra", "int")
    assert wider.columns[-1] == "extra" and add_column(wider, "extra", "int") is wider


def test_snapshots_show_all_tables_at_once(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "lib"))
    assert not s.has("a")
    with pytest.raises(KeyError):
        s.read("a")
    s.publish(a=spark.range(3), b=spark.range(5))
    old = s.read("a")
    s.publish(a=s.read("a").filter("id > 0"))
    assert (s.read("a").count(), s.read("b").count(), old.count()) == (2, 5, 3)
    bad = spark.range(2).selectExpr("raise_error('no') AS x")
    with pytest.raises(Exception):  # noqa: B017
        s.publish(b=spark.range(1), c=bad)
    assert s.read("b").count() == 5 and not s.has("c")


def test_text_functions(spark):
    df = spark.createDataFrame([("  Ab  c\n", "x  \r\ny \t\n"), (None, None)], "a string, b string")
    r = df.select(strip("a").alias("s"), collapse("a").alias("c"), tidy_page("b").alias("t")).collect()
    assert (r[0].s, r[0].c, r[0].t) == ("Ab  c", "Ab c", "x\ny") and r[1].s is None
    one = spark.createDataFrame([("STRASSE straße ΣΑΣ ÀÉ",)], "a string").select(casefold("a").alias("f"), ascii_lower("a").alias("l")).first()
    assert one.f == "strasse strasse σασ àé" and one.l == "strasse straße ΣΑΣ ÀÉ"
    ids = ["urn:uuid:092F0321-3936-4F66-A3C5-A5BF635903C6", "{092f0321-3936-4f66-a3c5-a5bf635903c6}", "092f032139364f66a3c5a5bf635903c6 ", "not an id", None]
    keys = [x.k for x in spark.createDataFrame([(i,) for i in ids], "a string").select(uuid_key("a").alias("k")).collect()]
    assert keys[0] == keys[1] == keys[2] == "092f032139364f66a3c5a5bf635903c6" and keys[3] == "!not an id" and keys[4] is None


def test_strict_json_and_fingerprints(spark):
    texts = ['{"k": 5}', '{"k": -0}', '{"k": 5.0}', '{"k": true}', '{"k": "5"}', '{"k": 5, "x": 1}', "{}", "", None, ' {"k":12} ']
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strict_value(texts_col(), "k", "int").alias("v")).collect()]
    assert [x is not None for x in got] == [True, True, False, False, False, False, False, False, False, True]
    row = spark.range(1).selectExpr("'b' AS z", "cast(null AS int) AS a")
    r = row.select(canonical_object(z=row.z, a=row.a).alias("j"), fingerprint(z=row.z, a=row.a).alias("f")).first()
    assert r.j == '{"a":null,"z":"b"}' and len(r.f) == 64


def texts_col():
    from pyspark.sql import functions as F

    return F.col("t")

"""JSON objects accepted only with exactly the expected keys and value types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a JSON value of a kind looks like in raw text; true, 2.0 and "2" are no integers.
_RAW = {"int": r"-?(?:0|[1-9]\d*)", "string": r"\"(?:[^\"\\]|\\.)*\"", "boolean": r"true|false"}


def strict_value(text: Column, key: str, kind: str) -> Column:
    """The value of the only key of a flat JSON object as text; null if the object has other keys or another kind of value."""
    shape = rf"^\s*\{{\s*\"{key}\"\s*:\s*({_RAW[kind]})\s*\}}\s*$"
    return F.when(text.rlike(shape), F.get_json_object(text, f"$.{key}"))


def strict_object(text: Column, /, **fields: str) -> Column:
    """A JSON object as a struct of its fields (name = type: string, bigint, double, boolean, array<bigint>, array<string> or
    array<struct<...>> of these); null if the text is no JSON object, has other keys than these or another kind of value.

    Types are exact: true, 2.0 and "2" are no integers, 2 and 2.5 are both doubles, null is nothing."""
    value = F.try_parse_json(text)
    found = F.regexp_replace(F.schema_of_variant(value), r"DECIMAL\(\d+,\d+\)|DOUBLE|FLOAT", "DOUBLE")
    shapes = [""]
    for name in sorted(fields):
        ways = _shapes(fields[name])
        shapes = [f"{s}{', ' if s else ''}{name}: {w}" for s in shapes for w in ways]
    fits = found.isin([f"OBJECT<{s}>" for s in shapes])
    return F.when(fits, F.try_variant_get(value, "$", "struct<" + ", ".join(f"{k}: {v}" for k, v in fields.items()) + ">"))


def _shapes(kind: str) -> list[str]:
    """How the type of a JSON value of a kind is written."""
    if kind.startswith("array<"):
        return ["ARRAY<VOID>", *(f"ARRAY<{w}>" for w in _shapes(kind[6:-1]))]
    if kind.startswith("struct<"):
        inner = [f.split(":", 1) for f in kind[7:-1].split(", ")]
        out = [""]
        for name, of in sorted((n.strip(), t.strip()) for n, t in inner):
            out = [f"{o}{', ' if o else ''}{name}: {w}" for o in out for w in _shapes(of)]
        return [f"OBJECT<{o}>" for o in out]
    return {"string": ["STRING"], "bigint": ["BIGINT"], "double": ["DOUBLE", "BIGINT"], "boolean": ["BOOLEAN"]}[kind]


def canonical_object(**fields: Column) -> Column:
    """A JSON object with keys in order, no blanks and nulls kept, as it is hashed for a fingerprint."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def fingerprint(**fields: Column) -> Column:
    return F.sha2(canonical_object(**fields), 256)

"""A sequential fold over ordered rows of each key, streamed: no group is ever held in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[tuple | None, tuple], tuple], inputs: list[str], outputs: str) -> DataFrame:
    """rows with the state after each: the columns of rows and `outputs` (a schema string).

    Rows are hashed by keys and sorted by keys and order; step(state, inputs of the row) gives the next state, where state is
    None for the first row of a key. A key lies in one task, which streams it in Arrow batches and carries one state."""
    names = [f.split()[0] for f in outputs.split(", ")]
    base = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    columns = base.columns
    at_keys, at_inputs = [columns.index(k) for k in keys], [columns.index(c) for c in inputs]
    schema = base.select("*", *(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in outputs.split(", "))).schema
    types = {f.split()[0]: {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "timestamp": pa.timestamp("us", "UTC")}[f.split()[1]] for f in outputs.split(", ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            key_rows = zip(*(batch.column(i).to_pylist() for i in at_keys), strict=True)
            in_rows = zip(*(batch.column(i).to_pylist() for i in at_inputs), strict=True)
            out = []
            for key, row in zip(key_rows, in_rows, strict=True):
                if key != last:
                    last, state = key, None
                state = step(state, row)
                out.append(state)
            new = [pa.array([s[k] for s in out], types[n]) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*columns, *names])

    return base.mapInArrow(run, schema)

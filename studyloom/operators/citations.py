"""Citations as arrays: positional resolution against stored chunks and set predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(rows: DataFrame, keys: list[str], citations: str = "citations") -> DataFrame:
    """keys, place (from 1) and the fields of each citation."""
    return rows.select(*keys, F.posexplode(citations).alias("at", "c")).select(*keys, (F.col("at") + 1).alias("place"), "c.*")


def resolve(cited: DataFrame, chunks: DataFrame, on: list[str]) -> DataFrame:
    """cited with the chunk it names: chunk_id and text of the stored chunk, null where there is none.

    chunks has one row for each key of `on`."""
    return cited.join(chunks.select(*on, "chunk_id", F.col("text").alias("chunk_text")), on, "left")


def numbers_within(numbers: Column, first: Column, last: Column) -> Column:
    return F.forall(numbers, lambda x: (x >= first) & (x <= last))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def is_unique(a: Column) -> Column:
    return F.size(F.array_distinct(a)) == F.size(a)

"""Batches of ordered rows: by a budget of characters, and by a fixed number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyloom.plans.ordered_fold import ordered_fold


def budget_batches(rows: DataFrame, key: str, order: list[str], size: str, budget: int) -> DataFrame:
    """rows with context_number (from 1 over the key) and batch_number: consecutive rows while their sizes add up to at most
    budget; a row that alone exceeds it is a batch of its own. Null sizes count 0."""

    def step(state: tuple | None, row: tuple) -> tuple:
        n = row[0] or 0
        if state is None:
            return 1, 1, n
        number, batch, held = state
        return (number + 1, batch + 1, n) if held + n > budget else (number + 1, batch, held + n)

    return ordered_fold(rows, [key], order, step, [size], "context_number int, batch_number int, batch_size bigint")


def fixed_batches(counts: DataFrame, n: str, batch: int) -> DataFrame:
    """For each row with n items: batch_number, first_number and last_number of its batches of `batch` items."""
    many = F.ceil(F.col(n) / batch).cast("int")
    rows = counts.filter(F.col(n) > 0).withColumn("batch_number", F.explode(F.sequence(F.lit(1), many)))
    return rows.withColumns({"first_number": ((F.col("batch_number") - 1) * batch + 1).cast("int"), "last_number": F.least(F.col("batch_number") * batch, F.col(n)).cast("int")})


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with their number (from 1) within key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))

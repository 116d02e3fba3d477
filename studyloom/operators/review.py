"""Spaced repetition as a fold over each question's ratings in order of time, and what is due."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.plans.ordered_fold import ordered_fold

#: (repetitions, interval in days, ease) before the first review, and the least ease.
FRESH, LEAST_EASE = (0, 0, 2.5), 1.3
#: Microseconds of ten minutes and of a day; what a timestamp and an interval column can hold.
TEN_MINUTES, DAY, LAST, MOST_DAYS = 600_000_000, 86_400_000_000, (1 << 63) - 1, (1 << 31) - 1


def advance(repetitions: int, interval: int, ease: float, rating: str, at: int) -> tuple[int, int, float, int | None]:
    """The state after one rating at a time in microseconds: repetitions, interval, ease, due time (None beyond the range of
    timestamps, as intervals multiply without end). Rounding is half to even."""
    if rating == "again":
        return 0, 0, max(LEAST_EASE, ease - 0.2), at + TEN_MINUTES
    if rating == "hard":
        days, lifted = (max(1, round(interval * 1.2)) if interval else 1), max(LEAST_EASE, ease - 0.15)
    elif rating == "good":
        days, lifted = {0: 1, 1: 6}.get(repetitions) or max(1, round(interval * ease)), ease
    elif rating == "easy":
        days, lifted = (max(4, round(interval * ease * 1.3)) if interval else 4), ease + 0.15
    else:
        raise ValueError(f"unknown rating {rating!r}")
    days = min(days, MOST_DAYS)
    due = at + days * DAY
    return repetitions + 1, days, lifted, due if due <= LAST else None


def review_fold(attempts: DataFrame, keys: list[str], at: str, rating: str, tie: str) -> DataFrame:
    """The attempts with repetition_count, interval_days, ease_factor and due_at after each, in order of time (ties by `tie`).

    Rows of null time or null or unknown rating are left out: they are no reviews. due_at is null beyond the timestamp range."""
    known = attempts.filter(F.col(at).isNotNull() & F.col(rating).isin("again", "hard", "good", "easy")).withColumn("_at", F.unix_micros(at))

    def step(state: tuple | None, row: tuple) -> tuple:
        return advance(*(state[:3] if state else FRESH), row[0], row[1])

    out = ordered_fold(known, keys, [at, tie], step, [rating, "_at"], "repetition_count int, interval_days int, ease_factor double, _due bigint")
    return out.withColumn("due_at", F.timestamp_micros("_due")).drop("_at", "_due")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of each key the last row by order (an upsert into one row a key); a partial maximum is taken before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return top.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*rows.columns)


def due(questions: DataFrame, progress: DataFrame, keys: list[str], as_of) -> DataFrame:
    """Questions without progress, or whose due time has come (inclusive), with place: overdue by time, then new ones by key."""
    joined = questions.join(progress.select(*keys, "due_at"), keys, "left")
    return joined.filter(F.col("due_at").isNull() | (F.col("due_at") <= as_of))

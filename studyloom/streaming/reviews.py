"""Attempts as a stream: the review state of each question, and attempts by hour with late ones dropped by watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from studyloom.operators.review import FRESH, advance

_OUT = "question_key string, repetition_count int, interval_days int, ease_factor double, due_us bigint, last_us bigint, n_rejected bigint"
_STATE = "repetition_count int, interval_days int, ease_factor double, last_us bigint, n_rejected bigint"


def review_states(attempts: DataFrame) -> DataFrame:
    """attempts (a stream of question_key, rating, answered_at, id) to the state of each question after every micro-batch that
    reviewed it. Within a batch reviews are taken in order of time and id; one before the question's last review is rejected
    and counted. State is one row a question, whatever the number of attempts."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reps, days, ease, last, rejected = state.get if state.exists else (*FRESH, None, 0)
        rows = pd.concat(list(pdfs)).sort_values(["answered_at", "id"])
        due = None
        for rating, at in zip(rows["rating"], rows["answered_at"], strict=True):
            us = at.value // 1000
            if last is not None and us < last:
                rejected += 1
                continue
            reps, days, ease, due = advance(reps, days, ease, rating, us)
            last = us
        state.update((reps, days, ease, last, rejected))
        yield pd.DataFrame({"question_key": [key[0]], "repetition_count": [reps], "interval_days": [days], "ease_factor": [ease], "due_us": pd.array([due], "Int64"), "last_us": pd.array([last], "Int64"), "n_rejected": [rejected]})

    known = attempts.filter(F.col("answered_at").isNotNull() & F.col("rating").isin("again", "hard", "good", "easy"))
    out = known.groupBy("question_key").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
    return out.select("question_key", "repetition_count", "interval_days", "ease_factor", F.timestamp_micros("due_us").alias("due_at"), F.timestamp_micros("last_us").alias("last_reviewed_at"), "n_rejected")


def attempts_by_hour(attempts: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Attempts and correct ones in each hour of answered_at, each id once within the watermark; later rows are dropped."""
    once = attempts.withWatermark("answered_at", delay).dropDuplicatesWithinWatermark(["id"])
    hour = F.window("answered_at", "1 hour")
    return once.groupBy(hour).agg(F.count("*").alias("n_attempts"), F.count_if(F.col("verdict") == "correct").alias("n_correct")).select(F.col("window.start").alias("hour"), "n_attempts", "n_correct")

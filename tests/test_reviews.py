import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from studyloom.operators.progress import difficult_concepts, progress_report
from studyloom.operators.review import advance, due, latest, review_fold
from studyloom.streaming.reviews import attempts_by_hour, review_states

T0 = datetime(2024, 1, 1, 12)
US = lambda t: round((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))


@pytest.mark.parametrize(
    ("state", "rating", "expected"),
    [
        ((0, 0, 2.5), "again", (0, 0, 2.3, timedelta(minutes=10))), ((0, 0, 2.5), "hard", (1, 1, 2.35, timedelta(days=1))), ((0, 0, 2.5), "good", (1, 1, 2.5, timedelta(days=1))), ((0, 0, 2.5), "easy", (1, 4, 2.65, timedelta(days=4))),
        ((2, 6, 2.5), "again", (0, 0, 2.3, timedelta(minutes=10))), ((2, 6, 2.5), "hard", (3, 7, 2.35, timedelta(days=7))), ((2, 6, 2.5), "good", (3, 15, 2.5, timedelta(days=15))), ((2, 6, 2.5), "easy", (3, 20, 2.65, timedelta(days=20))),
        ((1, 1, 1.35), "again", (0, 0, 1.3, timedelta(minutes=10))), ((1, 1, 2.5), "good", (2, 6, 2.5, timedelta(days=6))),
    ],
)
def test_transitions(state, rating, expected):
    reps, days, ease, at = advance(*state, rating, US(T0))
    assert (reps, days, round(ease, 9), at) == (*expected[:3], US(T0 + expected[3]))
    with pytest.raises(ValueError):
        advance(*state, "unsure", 0)


def log(n=400):
    r = random.Random(1)
    rows = [(i, f"q{r.randint(0, 9)}", r.choice(["again", "hard", "good", "easy", "good"]), T0 + timedelta(hours=r.randint(0, 4000))) for i in range(n)]
    return rows + [(900, "q1", None, T0), (901, "q1", "good", None), (902, "q1", "odd", T0)]


def by_hand(rows):
    out = {}
    for i, q, g, at in sorted((x for x in rows if x[2] in ("again", "hard", "good", "easy") and x[3]), key=lambda x: (x[1], x[3], x[0])):
        out[q] = (advance(*(out[q][0][:3] if q in out else (0, 0, 2.5)), g, US(at)), at, i)
    return out


def test_fold_and_latest(spark):
    rows = log()
    df = spark.createDataFrame(rows, "id int, question_key string, rating string, answered_at timestamp")
    last = latest(review_fold(df, ["question_key"], "answered_at", "rating", "id"), ["question_key"], "answered_at", "id").collect()
    want = by_hand(rows)
    assert {r.question_key: (r.repetition_count, r.interval_days, round(r.ease_factor, 9), r.due_at) for r in last} == {q: (s[0], s[1], round(s[2], 9), datetime(1970, 1, 1) + timedelta(microseconds=s[3])) for q, (s, _, _) in want.items()}
    assert review_fold(df.limit(0), ["question_key"], "answered_at", "rating", "id").count() == 0


def test_intervals_without_end():
    state = (0, 0, 2.5)
    for _ in range(60):
        *state, due_at = advance(*state, "easy", 0)
    assert due_at is None and state[1] == (1 << 31) - 1


def test_due_is_inclusive_and_takes_new_questions(spark):
    q = spark.createDataFrame([(1,), (2,), (3,), (4,)], "n int")
    p = spark.createDataFrame([(1, T0), (2, T0 + timedelta(seconds=1)), (4, T0 - timedelta(days=1))], "n int, due_at timestamp")
    assert {r.n for r in due(q, p, ["n"], F.lit(T0)).collect()} == {1, 3, 4}


def test_progress_report(spark):
    q = spark.createDataFrame([("b", 1), ("b", 2), ("empty", 1)], "bank string, n int")
    ev = lambda v, m: {"verdict": v, "missing_concepts": m}
    a = spark.createDataFrame([("b", 1, ev("partially_correct", ["relevant passages"]), T0), ("b", 1, ev("correct", []), T0 + timedelta(days=1)), ("b", 1, None, T0)], "bank string, n int, evaluation struct<verdict:string,missing_concepts:array<string>>, answered_at timestamp")
    p = spark.createDataFrame([("b", 1, T0 + timedelta(days=9))], "bank string, n int, due_at timestamp")
    got = {r.bank: r for r in progress_report(q, a, p, ["bank"], "n", F.lit(T0)).collect()}
    b, e = got["b"], got["empty"]
    assert (b.n_questions, b.n_answered, b.n_attempts, b.n_incorrect, b.n_partially_correct, b.n_correct, b.n_unclassified, b.n_due) == (2, 1, 3, 0, 1, 1, 1, 1)
    assert (b.next_due_at, b.last_studied_at, b.answered_rate) == (T0, T0 + timedelta(days=1), 0.5)
    assert (e.n_attempts, e.correct_rate, e.last_studied_at) == (0, 0.0, None)
    assert [(r.concept, r.n_missing) for r in difficult_concepts(a).collect()] == [("relevant passages", 1)]


def run(stream, name, mode):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)


def test_stream_of_reviews_equals_the_fold(spark, tmp_path):
    rows = sorted((x for x in log(200) if x[3] and x[2] in ("again", "hard", "good", "easy")), key=lambda x: (x[3], x[0]))
    schema = "id int, question_key string, rating string, answered_at timestamp"
    for k in range(0, 200, 70):
        spark.createDataFrame(rows[k : k + 70], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run(review_states(src), "states", "update")
    last = {}
    for r in spark.table("states").collect():
        if r.question_key not in last or r.last_reviewed_at >= last[r.question_key].last_reviewed_at:
            last[r.question_key] = r
    want = by_hand(rows)
    assert {q: (r.repetition_count, r.interval_days, round(r.ease_factor, 9)) for q, r in last.items()} == {q: (s[0], s[1], round(s[2], 9)) for q, (s, _, _) in want.items()}


def test_stream_by_hour_counts_ids_once(spark, tmp_path):
    schema = "id string, verdict string, answered_at timestamp"
    rows = [("a", "correct", T0), ("a", "correct", T0), ("b", None, T0 + timedelta(minutes=5)), ("c", "correct", T0 + timedelta(hours=5)), ("d", "correct", T0 + timedelta(hours=9))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    run(attempts_by_hour(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "hours", "append")
    got = {r.hour: (r.n_attempts, r.n_correct) for r in spark.table("hours").collect()}
    assert got[T0] == (2, 1) and T0 + timedelta(hours=9) not in got

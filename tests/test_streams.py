"""Streams read to their end, against the same events as a batch."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lotwright.operators import sweeps
from lotwright.streaming import states

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
BEGIN = datetime(2024, 1, 1)


def events(n, seed=3):
    rng = random.Random(seed)
    rows = [(i, BEGIN + timedelta(minutes=i), rng.randrange(9), rng.choice(["click", "view"]), rng.choice([None, float(i)])) for i in range(n)]
    return rows, rng


def written(spark, batches, folder):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"file://{folder}/{k:03d}")
    return f"file://{folder}/*"


def latest(rows):
    out, count = {}, Counter()
    for i, t, u, e, v in {r[0]: r for r in rows}.values():
        count[u] += 1
        if u not in out or i > out[u][0]:
            out[u] = (i, t, e, v)
    return {u: (*x, count[u]) for u, x in out.items()}


def got(frame):
    return {r.user_id: (r.event_id, r.ts, r.event_type, r.value, r.events) for r in frame.collect()}


@pytest.mark.parametrize("idle", [states.IDLE_MS, 20 * 60_000])
def test_late_and_repeated_events(spark, tmp_path, idle):
    """A stream of batches whose events come up to an hour late and again equals the batch; so it does where runs end on the way."""
    rows, rng = events(240)
    order = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.randrange(60)))
    batches = [order[i : i + 60] for i in range(0, 240, 60)]
    batches = [b + rng.sample(b, 10) + (rng.sample(batches[k - 1], 5) if k else []) for k, b in enumerate(batches)]
    path = written(spark, batches, tmp_path)
    stream = states.from_folder(spark, path, spark.createDataFrame([], SCHEMA).schema)
    assert got(states.read_to_end(stream, "test-states", idle)) == latest(rows)


def test_batches_drop_repeats_too(spark):
    rows, _ = events(20)
    assert states.once(spark.createDataFrame(rows + rows, SCHEMA)).count() == 20


def test_sweep(spark):
    rows = [
        (1, "A", "red", 5, 10), (1, "B", "blue", 5, 10), (2, "A", "red", 4, 11), (3, "A", "Ремонт red", 3, 2), (4, "C", "red", 2, 3), (5, "D", "red", 1, 1),
        (6, "A", "red", 5, 12), (6, "A", "other", 5, 12), (7, "C", "red", 0, 13), (8, "D", "red", 0, 14), (1, "E", "red", 5, 1), (9, None, "red", 1, 15),
    ]
    frame = spark.createDataFrame([(c, k, o, n, d) for c, k, o, n, d in rows], "contract int, code string, object string, n int, day int")
    hit = F.contains("object", F.lit("red")) & (F.col("n") > 0)
    told = sweeps.sweep(frame, hit, day="day", begins=F.lit(10), asked=["Z"], discover=2)
    # contracts 1, 2, 6 and 9 match in the period; of the earlier ones 4 and 5 are supplies, 3 a service
    assert {tuple(r) for r in told.codes.collect()} == {("A", 1, 3, 0), ("C", 2, 1, 1), ("D", 2, 1, 1)}
    assert told.looked.first() == (2, 3) and told.found.count() == 0
    again = sweeps.sweep(frame.withColumn("n", F.when(F.col("contract").isin(7, 8), 1).otherwise(F.col("n"))), hit & ~F.col("contract").isin(7), day="day", begins=F.lit(10), asked=["A"], discover=60)
    assert {r.code for r in again.codes.collect()} == {"C", "D"}


def test_plans(spark):
    rows = [(0, ["1", "1"], ["R"], ["x y", "X z"], False), (1, ["a", "A"], ["R"], ["x"], True), (2, [], None, ["  ", "k"], True), (3, None, None, None, None)]
    frame = spark.createDataFrame(rows, "q int, codes array<string>, registrations array<string>, phrases array<string>, only_codes boolean")
    want = [(0, 0, "code", "1"), (0, 1, "registration", "R"), (0, 2, "word", "x"), (0, 3, "word", "y"), (0, 4, "word", "z"), (1, 0, "code", "a"), (2, 0, "word", "k")]
    assert sorted(map(tuple, sweeps.plans(frame).collect())) == want

"""Streams of sessions and repair attempts over several batches, with stops between them, against the batch operators."""

import datetime as dt
import random

from pyspark.sql import functions as F

from paperstrata.operators import intake
from paperstrata.streaming import stateful

EVENT = "id long, collection string, at timestamp, kind string"
ATTEMPT = "item long, nth int, ok boolean"


def run(spark, tmp_path, schema, batches, states):
    """Each batch is added and followed by a stream of its own, which goes on from the state of the one before."""
    own, said = stateful.stream_session(spark), []
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = own.readStream.schema(schema).parquet(f"{tmp_path}/in")
        stateful.follow(states(stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def test_sessions_close_or_expire(spark, tmp_path):
    at = lambda h, ms=0: dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=h, milliseconds=ms)
    first = [(1, "a", at(0), "start"), (2, "a", at(0, 1), "start"), (3, "b", at(1), "start"), (3, "b", at(2), "close"), (4, None, at(2), "close"), (None, "x", at(2), "start"), (7, "x", None, "start")]
    second = [(2, "a", at(2), "start"), (1, "a", at(23, 999), "tick"), (5, "c", at(23), "start")]  # a repeat, and no one is due yet
    third = [(9, "t", at(24), "tick")]  # 1 is due to the millisecond, 2 isn't
    fourth = [(5, "c", at(24, 1), "close"), (5, "c", at(24), "close"), (1, "a", at(25), "close"), (9, "t", at(24, 1), "tick")]  # a close at the watermark is late, one behind it counts
    said = run(spark, tmp_path, EVENT, [first, second, third, fourth], lambda s: stateful.session_states(s, 24))
    rows = sorted((r["id"], r["collection"], r["state"]) for r in said.collect())
    assert rows == sorted([(1, "a", "open"), (2, "a", "open"), (3, "b", "open"), (3, "b", "closed"), (5, "c", "open"), (1, "a", "expired"), (5, "c", "closed"), (2, "a", "expired")])


def test_repairs_agree_with_the_batch(spark, tmp_path):
    rnd = random.Random(4)
    all_rows = [(i, n, rnd.random() < 0.3) for i in range(120) for n in range(1, rnd.randint(2, 7))]
    rnd.shuffle(all_rows)
    third = len(all_rows) // 3
    batches = [all_rows[:third] + [(None, 1, True), (500, None, True)], all_rows[third : 2 * third] + all_rows[: third // 2], all_rows[2 * third :]]
    said = run(spark, tmp_path, ATTEMPT, batches, stateful.repair_states)
    last = said.groupBy("item").agg(F.max_by(F.struct("state", "next"), "turn").alias("r")).select("item", "r.*")
    want = intake.repairs(spark.createDataFrame(all_rows, ATTEMPT)).select("item", "state", "next")
    assert sorted(map(str, last.collect())) == sorted(map(str, want.collect()))

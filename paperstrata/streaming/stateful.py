"""States that follow streams of events: upload sessions that expire, and repair attempts that may be resumed.

Each item, and each SHARD consecutive ids of sessions, is a key with a state of its own in RocksDB, checkpointed with the stream; a
stream that starts again goes on from the last whole batch. Keys are many and small, so no task holds a hot one; sessions share one,
since each call of a key's state crosses from Python to the JVM and back.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.tree import checkpoint_folder
from ..session import ship, table

#: Many small stores: no space is set aside on disk for each, and a batch saves its changes instead of whole stores.
STATES = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Consecutive ids that share a key: a power of two.
SHARD = 64
SESSION_OUT = "id long, collection string, state string"
REPAIR_OUT = "item long, nth int, state string, next int"


class Sessions(StatefulProcessor):
    """Events (id, collection, micros, kind) of sessions: 'open' when one starts, then 'closed' or, hours after the start in event
    time, 'expired', whichever is first. Later events of an ended session, and repeated ones, say nothing. A key holds at most
    SHARD sessions, as JSON, and has a timer at the first end of an open one."""

    def __init__(self, hours: float):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shard = handle.getValueState("shard", "sessions string, timer long")

    def _load(self) -> tuple[dict[int, list], int | None]:
        """The state, end in milliseconds and collection of each session; the timer's end."""
        sessions, timer = self.shard.get() or ("[]", None)
        return {id: session for id, *session in json.loads(sessions)}, timer

    def _save(self, sessions: dict[int, list], timer: int | None) -> None:
        first = min((end for state, end, _ in sessions.values() if state == "open"), default=None)
        if first is not None and (timer is None or first < timer):
            timer = first
            # timers fire when the watermark is past them; this one when it is at the end or past it
            self.handle.registerTimer(timer - 1)
        self.shard.update((json.dumps([[id, *session] for id, session in sessions.items()]), timer))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (sessions, timer), said = self._load(), []
        for event in sorted(rows, key=lambda event: (event.micros, event.kind == "close")):
            session = sessions.get(event.id)
            if event.kind == "start" and session is None:
                sessions[event.id] = ["open", round(event.micros / 1000 + self.hours * 3_600_000), event.collection]
                said.append(Row(id=event.id, collection=event.collection, state="open"))
            elif event.kind == "close" and session and session[0] == "open":
                session[0] = "closed"
                said.append(Row(id=event.id, collection=session[2], state="closed"))
        if said:
            self._save(sessions, timer)
        yield from said

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (sessions, timer), said = self._load(), []
        # a timer that fires is due, and isn't set again, since it goes after this
        fired = expiredTimerInfo.getExpiryTimeInMs() + 1
        due = max(timerValues.getCurrentWatermarkInMs(), fired)
        for id, session in sessions.items():
            if session[0] == "open" and session[1] <= due:
                session[0] = "expired"
                said.append(Row(id=id, collection=session[2], state="expired"))
        self._save(sessions, None if timer == fired else timer)
        yield from said

    def close(self) -> None:
        pass


class Repairs(StatefulProcessor):
    """Attempts (item, nth, ok) of an item, in any order, repeats included: after each batch the state of the item as
    ``intake.repairs`` gives it. An attempt counts once, as it came first."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.attempts = handle.getMapState("attempts", "nth int", "ok boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = {nth[0]: ok[0] for nth, ok in self.attempts.iterator()}
        fresh = {}
        for attempt in rows:
            if attempt.nth not in known:
                known[attempt.nth] = fresh[attempt.nth] = attempt.ok
        for nth, ok in fresh.items():
            self.attempts.updateValue((nth,), (ok,))
        if fresh:
            last, bad = max(known), sum(not ok for ok in known.values())
            state = "done" if known[last] else "failed" if bad >= self.most else "retry"
            yield Row(item=key[0], nth=last, state=state, next=last + 1 if state == "retry" else None)

    def close(self) -> None:
        pass


def session_states(events: DataFrame, hours: float = 24, lateness: str = "0 seconds") -> DataFrame:
    """A stream of events (id, collection, at, kind: start, close or tick) to the changes of its sessions: id, collection, state. Ticks
    only move the time; events without id or time are left out, as are late ones, which the
    watermark has reached."""
    sound = events.filter("id IS NOT NULL AND at IS NOT NULL").select("id", "collection", "at", "kind", F.unix_micros("at").alias("micros"), F.shiftright("id", SHARD.bit_length() - 1).alias("shard")).withWatermark("at", lateness)
    return sound.groupBy("shard").transformWithState(statefulProcessor=Sessions(hours), outputStructType=SESSION_OUT, outputMode="Append", timeMode="EventTime")


def repair_states(attempts: DataFrame, most: int = 3) -> DataFrame:
    """A stream of attempts (item, nth, ok) to the states of their items, a row per item and batch that brings it a new attempt.
    Attempts with a null are left out."""
    sound = attempts.select("item", F.col("nth").cast("int").alias("nth"), "ok").dropna()
    return sound.groupBy("item").transformWithState(statefulProcessor=Repairs(most), outputStructType=REPAIR_OUT, outputMode="Append", timeMode="None")


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that keeps states in RocksDB, which the operators here need."""
    own = ship(spark).newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    for key, value in STATES.items():
        own.conf.set(key, value)
    return own


def follow(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes the changes that are there now to Parquet files, each batch exactly once, and stops. Their batch is in the column turn."""

    def write(batch: DataFrame, turn: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/turn={turn}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _replayed(s: SparkSession, events: DataFrame, states) -> DataFrame:
    """``events`` written as files, followed as a stream, and what it says."""
    own, folder = stream_session(s), f"{checkpoint_folder(s)}/stream-{uuid.uuid4().hex}"
    events.write.parquet(f"{folder}/in")
    stream = own.readStream.schema(events.schema).parquet(f"{folder}/in")
    follow(states(stream), f"{folder}/out", f"{folder}/state").awaitTermination()
    return s.read.parquet(f"{folder}/out")


def _sessions(s, d):
    """A session per document, some closed after a while, and a tick at the end."""
    begun = F.timestamp_seconds(F.lit(852_076_800) + F.col("doc_id") % 5000 * 3600)
    docs = table(s, d, "documents").select("doc_id", "source", begun.alias("at"))
    start = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("collection"), "at", F.lit("start").alias("kind"))
    close = start.filter("id % 3 = 0").select("id", "collection", (F.col("at") + F.expr("INTERVAL 1 HOUR")).alias("at"), F.lit("close").alias("kind"))
    tick = s.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("").alias("collection"), F.timestamp_seconds(F.lit(852_076_800 + 5001 * 3600)).alias("at"), F.lit("tick").alias("kind"))
    said = _replayed(s, start.unionByName(close).unionByName(tick), lambda events: session_states(events, 24 * 30))
    return said.groupBy("id").agg(F.max_by("state", F.when(F.col("state") == "open", 0).otherwise(1)).alias("state"))


def _attempts(s, d):
    own = table(s, d, "documents").select(F.expr("doc_id DIV 5").alias("item"), (F.col("doc_id") % 5).cast("int").alias("nth"), (F.col("n_chars") % 3 == 0).alias("ok"))
    said = _replayed(s, own, repair_states)
    return said.groupBy("item").agg(F.max_by(F.struct("state", "next"), "turn").alias("r")).select("item", "r.*")


QUERIES = {
    "streamed_sessions": (
        _sessions,
        "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'closed' WHEN doc_id % 5000 + 720 <= 5001 THEN 'expired' ELSE 'open' END AS state FROM documents",
    ),
    "streamed_repairs": (
        _attempts,
        """SELECT item, CASE WHEN ok THEN 'done' WHEN bad >= 3 THEN 'failed' ELSE 'retry' END AS state, CASE WHEN NOT ok AND bad < 3 THEN n + 1 END AS next FROM (
          SELECT doc_id // 5 AS item, max(doc_id % 5) AS n, arg_max(n_chars % 3 = 0, doc_id) AS ok, count(*) FILTER (n_chars % 3 <> 0) AS bad FROM documents GROUP BY 1)""",
    ),
}

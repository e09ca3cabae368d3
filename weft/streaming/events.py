"""Event streams: decoding, sessions, status machine, fan-out, deduplication, sinks.

Every function takes a streaming (or batch) DataFrame of events with session_id,
event, ts and further columns, and returns one; sinks return the started query.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.operators.messages import decode_envelope
from weft.operators.sessions import TERMINAL

MOVES = {
    ("idle", "send_message"): "running",
    ("completed", "send_message"): "running",
    ("running", "execution_complete"): "completed",
    ("resuming", "execution_complete"): "completed",
    ("running", "ask_user"): "awaiting_user",
    ("resuming", "ask_user"): "awaiting_user",
    ("running", "interrupt"): "paused",
    ("running", "timeout"): "paused",
    ("awaiting_user", "reply_user"): "resuming",
    ("paused", "resume_session"): "resuming",
}
STATUS = "session_id string, seq long, event string, status string, accepted boolean"


def from_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of envelopes, one JSON line each, from files that arrive in a folder."""
    e = decode_envelope(F.col("value"))
    raw = spark.readStream.options(**options).text(path).select(e.alias("e"))
    return raw.select("e.*").withColumns({"session_id": F.try_element_at("payload", F.lit("session_id")), "ts": F.try_to_timestamp("timestamp")})


def sessions(events: DataFrame, key: str = "session_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of events by session of activity; state older than ``late`` is dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    got = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n_events"))
    return got.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ends"), "n_events")


def in_flight(events: DataFrame, key: str = "session_id", late: str = "5 minutes") -> DataFrame:
    """One running request a session; those that follow within ``late`` are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def statuses(events: DataFrame, timeout_ms: int = 1_800_000) -> DataFrame:
    """The status machine of each session: the status after each event, and whether the
    event fitted. A session that stays silent for ``timeout_ms`` expires.

    Events (session_id, seq, event) of a micro-batch are taken by seq.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "seq": [-1], "event": ["expire"], "status": ["expired"], "accepted": [True]})
            return
        (status,) = state.get if state.exists else ("idle",)
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        after, fits = [], []
        for event in rows["event"]:
            to = MOVES.get((status, event))
            fits.append(to is not None)
            status = to or status
            after.append(status)
        state.update((status,))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"session_id": key[0], "seq": rows["seq"].to_numpy(), "event": rows["event"].to_numpy(), "status": after, "accepted": fits})

    return events.groupBy("session_id").applyInPandasWithState(step, STATUS, "status string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def heartbeats(events: DataFrame, idle_ms: int = 15_000) -> DataFrame:
    """A heartbeat event for each session that stayed silent for ``idle_ms``, until its terminal event."""

    def step(key, parts, state: GroupState):
        if state.hasTimedOut:
            (n,) = state.get
            state.update((n + 1,))
            state.setTimeoutDuration(idle_ms)
            yield pd.DataFrame({"session_id": [key[0]], "event": ["heartbeat"], "n": [n + 1]})
            return
        rows = pd.concat(list(parts))
        if rows["event"].isin(TERMINAL).any():
            if state.exists:
                state.remove()
        else:
            state.update(state.get if state.exists else (0,))
            state.setTimeoutDuration(idle_ms)

    return events.groupBy("session_id").applyInPandasWithState(step, "session_id string, event string, n long", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def replies(asks: DataFrame, answers: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Questions joined with the answer of the same session that came within ``wait``."""
    a = asks.withColumn("asked", F.col("ts").cast("timestamp")).withWatermark("asked", wait).select(F.col("session_id").alias("s"), "asked", "question")
    b = answers.withColumn("replied", F.col("ts").cast("timestamp")).withWatermark("replied", wait).select("session_id", "replied", "reply")
    return a.join(b, F.expr(f"s = session_id and replied >= asked and replied <= asked + interval {wait}")).drop("s")


def broadcast(events: DataFrame, subscribers: DataFrame, deliver, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Deliver each event to every subscriber of its session: ``deliver(batch, id)`` per micro-batch;
    ``once`` ends when all events at hand are delivered."""
    out = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: deliver(df.join(subscribers, "session_id"), i))
    return (out.trigger(availableNow=True) if once else out).start()


def audit_sink(records: DataFrame, path: str, checkpoint: str, seconds: int = 5, once: bool = False) -> StreamingQuery:
    """Append audit records as JSON lines by day, a micro-batch at a time; ``once`` ends with the records at hand."""
    rows = records.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rows.writeStream.format("json").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).trigger(**({"availableNow": True} if once else {"processingTime": f"{seconds} seconds"})).start()


def run_for(query: StreamingQuery, seconds: float) -> str:
    """Wait for a query; after ``seconds`` it is stopped at its last checkpoint ("paused")."""
    if query.awaitTermination(seconds):
        return "completed"
    query.stop()
    return "paused"


def snapshot(state: dict, reason: str = "", hint: str = "") -> str:
    """A run's state as JSON text; what JSON cannot hold becomes text."""
    return json.dumps({"state": state, "reason": reason, "hint": hint}, ensure_ascii=False, default=str, sort_keys=True)


def snapshots(states: DataFrame, reason: str, hint: str = "") -> DataFrame:
    """text: the snapshot of each row, as ``snapshot`` writes it."""
    return states.select(F.to_json(F.struct(F.lit(hint).alias("hint"), F.lit(reason).alias("reason"), F.struct(*sorted(states.columns)).alias("state"))).alias("text"))


def restored(texts: DataFrame, state: str, column: str = "value") -> DataFrame:
    """The states (DDL ``state``) of snapshots with their reason; texts that are no snapshots are left out."""
    got = F.from_json(column, f"struct<hint:string,reason:string,state:struct<{state}>>").alias("s")
    return texts.select(got).where("s.state is not null").select("s.state.*", "s.reason")


def restore(text: str) -> dict:
    got = json.loads(text)
    if not isinstance(got, dict) or "state" not in got:
        raise ValueError("not a checkpoint")
    return got

"""Session lifecycle over tables of sessions, messages and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_sum, step_of

IDLE_SECONDS, PAUSED_SECONDS, MOST_SESSIONS = 1800, 3600, 50
TERMINAL = ("execution_complete", "error")
STATUSES = ("idle", "running", "paused", "resuming", "completed", "expired", "awaiting_user")


def summaries(messages: DataFrame) -> DataFrame:
    """Messages, turns and a preview (first message, 100 characters) of each session."""
    return messages.groupBy("session_id").agg(
        F.count("*").alias("message_count"),
        F.coalesce(F.max("turn_index"), F.lit(0)).cast("long").alias("turn_count"),
        F.left(F.coalesce(F.min_by("text", "pos"), F.lit("")), F.lit(100)).alias("preview"),
    )


def listing(sessions: DataFrame, by: str = "last_active_at") -> DataFrame:
    """Newest first; ties by id."""
    return sessions.orderBy(F.desc(by), "session_id")


def evicted(sessions: DataFrame, most: int = MOST_SESSIONS) -> DataFrame:
    """The sessions beyond the ``most`` that were active last."""
    kept = sessions.orderBy(F.desc("last_active_at"), "session_id").limit(most)
    return sessions.join(kept.select("session_id"), "session_id", "left_anti")


def is_expired(as_of: Column, status="status", active="last_active_at", checkpoint="checkpoint_created_at") -> Column:
    """Inactive for half an hour, or paused or waiting for more than an hour."""
    age = lambda c: as_of.cast("timestamp").cast("double") - F.col(c).cast("timestamp").cast("double")
    waits = F.col(status).isin("paused", "awaiting_user")
    return F.when(waits, F.coalesce(age(checkpoint), age(active)) > PAUSED_SECONDS).otherwise(age(active) > IDLE_SECONDS)


def activity(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Sessions of activity: runs of events less than ``gap`` apart."""
    w = F.session_window(F.col(ts).cast("timestamp"), gap)
    got = events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n_events"))
    return got.select(key, F.col("w.start").cast("timestamp_ntz").alias("started"), F.col("w.end").cast("timestamp_ntz").alias("ends"), "n_events")


def until_terminal(events: DataFrame, key: str, order: str, kinds=TERMINAL, kind: str = "event") -> DataFrame:
    """Each session's events up to its first terminal one, which is the last."""
    stop = events.where(F.col(kind).isin(*kinds)).groupBy(key).agg(F.min(order).alias("__stop")).withColumnRenamed(key, "__k")
    rows = events.join(stop, F.col(key) == F.col("__k"), "left")
    return rows.where(F.col("__stop").isNull() | (F.col(order) <= F.col("__stop"))).drop("__stop", "__k")


def token_events(chunks: DataFrame, call: str, order: str) -> DataFrame:
    """Start, chunk (with its running index) and end (with the total) events of each call."""
    numbered = running_sum(chunks.select(call, order), [call], {"b": step_of(order)}, [order], F.lit(1), "n")  # a call of any length
    chunk = numbered.select(call, F.lit("llm_stream_chunk").alias("event"), F.col("n").cast("long").alias("n"))
    ends = chunks.groupBy(call).agg(F.count("*").alias("n"))
    start = ends.select(call, F.lit("llm_stream_start").alias("event"), F.lit(0).cast("long").alias("n"))
    return start.unionByName(chunk).unionByName(ends.select(call, F.lit("llm_stream_end").alias("event"), "n"))


def first_in_flight(requests: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """One request for each session and stretch of ``seconds``; later ones are dropped."""
    slot = F.floor(F.col(ts).cast("timestamp").cast("double") / seconds)
    rows = requests.withColumn("__slot", slot)
    first = rows.groupBy(key, "__slot").agg(F.min_by(F.struct(*requests.columns), F.struct(F.col(ts), *(F.col(c) for c in requests.columns if c != ts and dict(requests.dtypes)[c] in ("bigint", "int", "string")))).alias("x"))
    return first.select("x.*")


def fan_out(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """An event for every subscriber of its session (an equi-join on the session)."""
    return events.join(subscribers, "session_id")


def progress(tasks: DataFrame, plan: str = "plan_id") -> DataFrame:
    return tasks.groupBy(plan).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"))


def transition(status: Column, event: Column) -> Column:
    """The status machine; events that do not fit leave the status as it is."""
    moves = [
        ("send_message", ("idle", "completed"), "running"),
        ("execution_complete", ("running", "resuming"), "completed"),
        ("ask_user", ("running", "resuming"), "awaiting_user"),
        ("interrupt", ("running",), "paused"),
        ("timeout", ("running",), "paused"),
        ("reply_user", ("awaiting_user",), "resuming"),
        ("resume_session", ("paused",), "resuming"),
        ("expire", ("idle", "paused", "awaiting_user", "completed"), "expired"),
    ]
    out = status
    for name, sources, to in moves:
        out = F.when((event == name) & status.isin(*sources), to).otherwise(out)
    return out


def registered(sessions: DataFrame, most: int = MOST_SESSIONS, by: list[str] | None = None) -> DataFrame:
    """(registered, active, full): how many sessions there are, in all or ``by`` columns, how many run or wait, and whether one more would evict."""
    busy = F.col("status").isin("running", "resuming", "paused", "awaiting_user")
    return sessions.groupBy(*(by or [])).agg(F.count("*").alias("registered"), F.count_if(busy).alias("active")).withColumn("full", F.col("registered") >= most)

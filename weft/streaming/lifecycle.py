"""State across events: the session machine, expiry, heartbeats, running turns, questions.

Each of these is a small machine over one session's events in the order of their time.
``ordered`` runs a machine in Spark's state store: rows wait in the state until the
watermark has passed them, so what arrives out of order within ``late`` is still taken in
order; then the machine takes each row, and rings at its deadline where no row came before
it. The result is that of sorting the session's rows, however they were cut into
micro-batches.

Calls to the store cost far more than what a machine does, so sessions are dealt by hash
into ``buckets``, each a group that reads and writes the state of its sessions at once. A
timer on event time wakes a bucket for whichever of its sessions is first.

A row at the very moment of a deadline comes before it. Rows behind the watermark are late
and dropped by Spark. Rows without a session or a time are left out. State holds the rows
of a session's last ``late`` and one small tuple; both go when the machine ends. The number
of buckets is fixed for the life of a checkpoint.

A stream's watermark only moves with its rows: where sources fall silent, a row with the
event ``TICK`` (any session, no output) passes the time on.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from weft.operators.sessions import IDLE_SECONDS, PAUSED_SECONDS

TICK = "tick"
SECOND = 1_000_000
#: Events that end a turn, and what the session is then.
ENDS = {"execution_complete": "completed", "error": "idle", "ask_user": "awaiting_user", "interrupt": "paused", "timeout": "paused"}
WAITS = ("paused", "awaiting_user")
HELD = "session_id string, at long, seq long, event string"
#: Buckets of sessions unless the caller knows better, and rows that leave a bucket at once.
BUCKETS, OUT_ROWS = 256, 10_000


class Machine:
    """One session's state, a tuple of ``STATE`` or None, and what its rows do to it.

    ``out`` names the columns that ``take`` and ``ring`` give; times are microseconds.
    """

    STATE, out = "at long", ""

    def take(self, now: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def deadline(self, now: tuple | None) -> int | None:
        return None

    def ring(self, now: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError


class Lifecycle(Machine):
    """Status after each event, and whether it fitted; a session expires after ``idle``
    seconds without an event, a paused or waiting one ``wait`` seconds after it stopped.
    After that the session starts anew."""

    STATE = "status string, since long, active long, seq long"
    out = "seq long, at long, event string, status string, accepted boolean, code string"

    def __init__(self, idle: int = IDLE_SECONDS, wait: int = PAUSED_SECONDS):
        self.idle, self.wait = idle * SECOND, wait * SECOND

    @staticmethod
    def move(status: str, event: str) -> tuple[str | None, str]:
        """The next status, or None and why the event does not fit."""
        at_work = status in ("running", "resuming")
        if event == "send_message":
            return (None, "SESSION_BUSY") if status == "running" else ("running", "")
        if event == "resume_session":
            return ("resuming", "") if status in WAITS else (None, "SESSION_NOT_PAUSED")
        if event == "reply_user":
            return ("resuming", "") if status == "awaiting_user" else (None, "SESSION_NOT_PAUSED")
        if event in ENDS and at_work:
            return ENDS[event], ""
        return None, "INVALID_REQUEST"

    def take(self, now, row):
        at, seq, event = row
        status, since = now[:2] if now else ("idle", at)
        to, code = self.move(status, event)
        now = (to or status, at if to else since, at, seq)
        return now, [(seq, at, event, now[0], to is not None, code)]

    def deadline(self, now):
        if now is None:
            return None
        return now[1] + self.wait if now[0] in WAITS else now[2] + self.idle

    def ring(self, now, at):
        return None, [(now[3], at, "expire", "expired", True, "")]


class Heartbeats(Machine):
    """A heartbeat for each ``silence`` seconds without an event, numbered from the last
    event on; an end of the turn that closes the connection ends them."""

    STATE = "active long, n long"
    out = "at long, after long, n long"

    def __init__(self, silence: int = 15, closing: tuple[str, ...] = ("execution_complete", "error")):
        self.silence, self.closing = silence * SECOND, closing

    def take(self, now, row):
        return (None if row[2] in self.closing else (row[0], 0)), []

    def deadline(self, now):
        return None if now is None else now[0] + (now[1] + 1) * self.silence

    def ring(self, now, at):
        return (now[0], now[1] + 1), [(at, now[0], now[1] + 1)]


class RunningTurn(Machine):
    """Whether a request starts a turn: those that come while one runs are dropped, until an end."""

    STATE = "since long"
    out = "seq long, at long, event string, dispatched boolean"

    def __init__(self, starts: tuple[str, ...] = ("send_message", "resume_session", "reply_user"), ends: tuple[str, ...] = tuple(ENDS)):
        self.starts, self.ends = starts, ends

    def take(self, now, row):
        at, seq, event = row
        if event in self.ends:
            return None, []
        if event not in self.starts:
            return now, []
        return now or (at,), [(seq, at, event, now is None)]


class Questions(Machine):
    """Each question's outcome: answered, replaced by the next question, or expired after
    ``wait`` seconds; and answers to nothing, which are rejected."""

    STATE = "asked long, seq long"
    out = "asked long, answered long, at long, outcome string"

    def __init__(self, wait: int = PAUSED_SECONDS):
        self.wait = wait * SECOND

    def take(self, now, row):
        at, seq, event = row
        if event == "ask_user":
            return (at, seq), [(now[1], None, at, "replaced")] if now else []
        return None, [(now[1], seq, at, "answered") if now else (None, seq, at, "rejected")]

    def deadline(self, now):
        return None if now is None else now[0] + self.wait

    def ring(self, now, at):
        return None, [(now[1], None, at, "expired")]


class InOrder(StatefulProcessor):
    """Runs a machine over the rows (session_id, at, seq, event) of each session of a bucket."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.names = ["session_id", *(c.split()[0] for c in machine.out.split(","))]

    def init(self, handle):
        self.handle = handle
        self.live = handle.getListState("live", f"session_id string, {self.machine.STATE}")
        self.held = handle.getListState("held", HELD)
        self.alarm = handle.getValueState("alarm", "at long")

    def close(self):
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(session, int(at), int(seq), event) for part in rows for session, at, seq, event in zip(part["session_id"], part["at"], part["seq"], part["event"], strict=True) if event != TICK and session is not None]
        if new:
            self.held.appendList(new)
            self._wake(min(row[1] for row in new), self._alarm())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        live = {row[0]: tuple(row[1:]) for row in self._all(self.live)}
        waiting = {session: [] for session in live}
        for row in self._all(self.held):
            waiting.setdefault(row[0], []).append(tuple(row[1:]))
        left, next_, out = [], [], []
        for session, rows in waiting.items():
            rows.sort()
            now, some, taken, wake = self._run(live.pop(session, None), rows, until)
            out += ((session, *o) for o in some)
            left += ((session, *row) for row in rows[taken:])
            next_ += wake
            if now is not None:
                live[session] = now
            if len(out) >= OUT_ROWS:
                yield self._frame(out)
                out = []
        self._keep(self.held, left)
        self._keep(self.live, [(session, *now) for session, now in live.items()])
        self.alarm.clear()
        if next_:
            self._wake(min(next_), None)
        if out:
            yield self._frame(out)

    def _run(self, now: tuple | None, rows: list[tuple], until: int):
        """The state once the watermark is ``until``, what came out, how many rows were taken, and when to go on."""
        m, out, at = self.machine, [], 0
        while True:
            row, due = (rows[at] if at < len(rows) else None), m.deadline(now)
            if row and row[0] <= until and (due is None or row[0] <= due):
                now, some = m.take(now, row)
                at += 1
            elif due is not None and due <= until:
                now, some = m.ring(now, due)
            else:
                return now, out, at, [t for t in (due, row and row[0]) if t is not None]
            out += some

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(self.names, zip(*out, strict=True), strict=True)})

    @staticmethod
    def _all(state) -> Iterator[tuple]:
        return state.get() if state.exists() else iter(())

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def _alarm(self) -> int | None:
        return self.alarm.get()[0] if self.alarm.exists() else None

    def _wake(self, at: int, alarm: int | None) -> None:
        """Set the bucket's only timer to ``at`` microseconds, unless it rings before.

        Timers count milliseconds and ring when the watermark has reached them."""
        at = -(-at // 1000)
        if alarm is not None and alarm <= at:
            return
        if alarm is not None:
            self.handle.deleteTimer(alarm)
        self.handle.registerTimer(at)
        self.alarm.update((at,))


def ordered(events: DataFrame, machine: Machine, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """session_id and what ``machine`` gives for a stream of session_id, seq, event and ts.

    Needs the RocksDB state store (see ``state_store``).
    """
    rows = events.where("ts is not null").select(F.col("session_id").cast("string").alias("session_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("seq").cast("long").alias("seq"), "event", F.col("ts").cast("timestamp").alias("ts"))
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets))).withWatermark("ts", late).groupBy("bucket")
    got = keyed.transformWithStateInPandas(InOrder(machine), f"session_id string, {machine.out}", "Append", "EventTime")
    return got


def lifecycle(events: DataFrame, idle: int = IDLE_SECONDS, wait: int = PAUSED_SECONDS, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Status, acceptance and error code of each event, and an ``expire`` row for each session that expires."""
    return ordered(events, Lifecycle(idle, wait), late, buckets)


def heartbeats(events: DataFrame, silence: int = 15, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """at, after (the time of the last event) and n of each heartbeat."""
    return ordered(events, Heartbeats(silence), late, buckets)


def running_turns(events: DataFrame, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Whether each request starts a turn or is dropped because one runs."""
    return ordered(events, RunningTurn(), late, buckets)


def questions(asks: DataFrame, answers: DataFrame, wait: int = PAUSED_SECONDS, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Outcome of each question of one stream by the answers of another (both: session_id, seq, ts)."""
    both = asks.select("session_id", "seq", "ts", F.lit("ask_user").alias("event")).unionByName(answers.select("session_id", "seq", "ts", F.lit("reply_user").alias("event")))
    return ordered(both, Questions(wait), late, buckets)


def ticks(rows: DataFrame) -> DataFrame:
    """Rows (ts) that only pass the time on."""
    return rows.select(F.lit(None).cast("string").alias("session_id"), F.lit(0).cast("long").alias("seq"), F.lit(TICK).alias("event"), "ts")


@contextmanager
def state_store(spark: SparkSession, partitions: int | None = None):
    """Queries that start inside keep their state in RocksDB, which timers and lists need.

    Every partition has a store that each micro-batch opens, and their number stays as it
    is in the query's first one, so ``partitions`` may set it lower than the session does.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)

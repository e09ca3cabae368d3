import json
import random
from datetime import UTC, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weft.plans.stream_queries import drained
from weft.streaming import event_stream
from weft.streaming import lifecycle as lc

START = datetime(2024, 1, 1, tzinfo=UTC)
SHAPE = "session_id string, seq long, event string, ts timestamp"


def at(minutes):
    return int((START + timedelta(minutes=minutes)).timestamp() * 1_000_000)


def stream(spark, path, batches):
    """Each of ``batches``, lists of (session, seq, event, minute), is a micro-batch."""
    path.mkdir()
    for i, rows in enumerate(batches):
        lines = [json.dumps({"session_id": s, "seq": n, "event": e, "ts": None if m is None else (START + timedelta(minutes=m)).isoformat()}) for s, n, e, m in rows]
        (path / f"{i}.json").write_text("\n".join(lines))
        import os

        os.utime(path / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).json(str(path))


def run(machine, rows, until):
    """The machine over one session's rows without Spark."""
    now, out = None, []
    for row in [*sorted(rows), None]:
        while (due := machine.deadline(now)) is not None and (due < row[0] if row else due <= until):
            now, some = machine.ring(now, due)
            out += some
        if row:
            now, some = machine.take(now, row)
            out += some
    return out


def test_moves():
    m = lc.Lifecycle.move
    assert m("running", "send_message") == (None, "SESSION_BUSY") and m("paused", "send_message") == ("running", "")
    assert m("awaiting_user", "reply_user") == ("resuming", "") and m("idle", "reply_user") == (None, "SESSION_NOT_PAUSED")
    assert m("resuming", "interrupt") == ("paused", "") and m("idle", "interrupt") == (None, "INVALID_REQUEST")
    assert m("running", "error") == ("idle", "") and m("completed", "resume_session") == (None, "SESSION_NOT_PAUSED")


def test_state_lives_across_batches(spark, tmp_path):
    """Sends are refused while a turn runs, a paused session outlives an idle one, and expiry needs no further event."""
    batches = [
        [("a", 1, "send_message", 0), ("b", 2, "send_message", 1)],
        [("a", 3, "send_message", 2), ("b", 4, "interrupt", 3)],
        [("a", 5, "ask_user", 4)],
        [("b", 6, "resume_session", 50), ("c", 7, "send_message", 50)],
        [(None, 0, "tick", 200)],
    ]
    got = drained(spark, lc.lifecycle(stream(spark, tmp_path / "in", batches), late="1 minute"))
    rows = {(r.session_id, r.seq, r.event): (r.status, r.accepted, r.code, r["at"]) for r in got.collect()}
    assert rows["a", 3, "send_message"][:3] == ("running", False, "SESSION_BUSY") and rows["a", 5, "ask_user"][0] == "awaiting_user"
    assert rows["a", 5, "expire"] == ("expired", True, "", at(64)) and rows["b", 6, "resume_session"][:2] == ("resuming", True)
    assert rows["b", 6, "expire"][3] == at(80) and rows["c", 7, "expire"][3] == at(80) and len(rows) == 10


@pytest.mark.parametrize("machine", [lc.Lifecycle(600, 1200), lc.Heartbeats(240), lc.RunningTurn(), lc.Questions(900)])
def test_out_of_order_rows_are_taken_in_order(spark, tmp_path, machine):
    rnd = random.Random(3)
    kinds = ["ask_user", "reply_user"] if isinstance(machine, lc.Questions) else ["send_message", "execution_complete", "ask_user", "reply_user", "interrupt", "resume_session", "error"]
    rows = [(rnd.choice("abc"), i, rnd.choice(kinds), m) for i, m in enumerate(sorted(rnd.sample(range(600), 150)))]
    shuffled = sorted(rows, key=lambda r: r[3] + rnd.uniform(-20, 20))  # up to 40 minutes late
    batches = [shuffled[i : i + 30] for i in range(0, 150, 30)]
    hard = [("a", 900, "send_message", None), (None, 901, "send_message", 10)]  # no time, no session
    source = stream(spark, tmp_path / "in", [batches[0] + hard, *batches[1:], [(None, 0, "tick", 700)]])
    got = drained(spark, lc.ordered(source, machine, "45 minutes")).collect()
    want = [(s, *o) for s in "abc" for o in run(machine, [(at(m), n, e) for k, n, e, m in rows if k == s], at(655))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and want


class Store:
    """A state of any kind that counts the calls."""

    def __init__(self, calls):
        self.calls, self.rows = calls, []

    def __getattr__(self, name):
        def call(rows=()):
            self.calls.append(name)
            if name in ("put", "update", "clear"):
                self.rows = list(rows)
            elif name == "appendList":
                self.rows += rows
            return iter(list(self.rows)) if name == "get" else bool(self.rows)

        return call


class Handle(Store):
    def getListState(self, *_):
        return Store(self.calls)

    def getValueState(self, *_):
        return Store(self.calls)

    def registerTimer(self, _):
        self.calls.append("registerTimer")


def test_a_bucket_of_sessions_takes_as_many_calls_as_one(spark):
    calls = []
    ran = lc.InOrder(lc.RunningTurn())
    ran.init(Handle(calls))
    rows = pd.DataFrame({"session_id": [f"s{i % 500}" for i in range(1000)], "at": range(1, 1001), "seq": range(1000), "event": "send_message"})
    assert list(ran.handleInputRows((0,), iter([rows]), None)) == []
    watermark = type("Values", (), {"getCurrentWatermarkInMs": lambda self: 5})()
    got = pd.concat(ran.handleExpiredTimer((0,), watermark, None))
    assert len(got) == 1000 and set(got.loc[got["dispatched"], "seq"]) == set(range(500)) and got["session_id"].nunique() == 500
    assert len(calls) < 20


def test_restarts_go_on_where_they_stopped(spark, tmp_path):
    source = stream(spark, tmp_path / "in", [[("a", 1, "send_message", 0)], [(None, 0, "tick", 5)]])
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def go():
        with lc.state_store(spark):
            q = lc.running_turns(source, "1 minute").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.seq, r.dispatched) for r in spark.read.parquet(out).collect())

    assert go() == [(1, True)]
    (tmp_path / "in" / "9.json").write_text('{"session_id": "a", "seq": 2, "event": "send_message", "ts": "2024-01-01T00:06:00Z"}\n{"seq": 0, "event": "tick", "ts": "2024-01-01T00:20:00Z"}')
    assert go() == [(1, True), (2, False)]


def test_an_empty_stream_gives_nothing(spark, tmp_path):
    assert drained(spark, lc.heartbeats(stream(spark, tmp_path / "in", [[]]))).count() == 0


def test_event_text():
    rows = [("1", "x", "a\nb"), (None, "y", ""), ("2", "message", ": c"), ("2", "z", " lead")]
    text = ": heartbeat\n\n" + "".join(event_stream.encode(*r) for r in rows) + "event: lost\n\nretry: 5\ndata: end\n\n"
    assert list(event_stream.decode(text.split("\n"))) == [*rows, ("2", "message", "end")]


def test_event_stream_loses_and_repeats_nothing(spark, tmp_path):
    event_stream.register(spark)
    (tmp_path / "in").mkdir()
    text, back = str(tmp_path / "text"), str(tmp_path / "back")

    def put(name, n):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"id": f"{name}{i}", "event": "e", "data": f"line {i}\nmore"}) for i in range(n)))

    def write():
        source = spark.readStream.schema(event_stream.SHAPE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        source.writeStream.format("weft_events").option("path", text).option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start().awaitTermination()

    def read():
        got = spark.readStream.format("weft_events").option("path", text).load()
        got.writeStream.format("parquet").option("path", back).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(back).collect())

    put("a", 5), put("b", 3)
    write()
    assert read() == [f"a{i}" for i in range(5)] + [f"b{i}" for i in range(3)]
    # the batch is run again, as after a crash before its commit was noted: its new file goes, nothing comes twice
    writer = event_stream._Writer(text, ["id", "event", "data"])
    again = [writer.write(iter([("a0", "e", "x")]))]
    before = {p.name for p in (tmp_path / "text").iterdir()}
    writer.commit(again, 0)
    assert {p.name for p in (tmp_path / "text").iterdir()} == before - {again[0].file}
    # a task that never got to its commit leaves a file that nobody reads
    writer.write(iter([("zz", "e", "lost")]))
    put("c", 4)
    write()
    assert read() == [f"a{i}" for i in range(5)] + [f"b{i}" for i in range(3)] + [f"c{i}" for i in range(4)]
    assert spark.read.parquet(back).where(F.col("data") == "line 1\nmore").count() == 3

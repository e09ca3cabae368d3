import json
import time

from pyspark.sql import functions as F

from weft.streaming import events as ev


def feed(spark, path, rows):
    path.mkdir(exist_ok=True)
    lines = [json.dumps({"type": "request", "event": e, "payload": {"session_id": s, "seq": str(i)}, "id": str(i), "timestamp": t}) for i, (s, e, t) in enumerate(rows)]
    (path / f"{len(list(path.iterdir()))}.json").write_text("\n".join(lines))


def drain(df, name, spark, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def polled(df, name, spark, n, seconds=60):
    """Rows of a query whose timers never let it end by itself."""
    q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    until = time.time() + seconds
    while spark.table(name).count() < n and time.time() < until:
        time.sleep(0.5)
    q.stop()
    return spark.table(name)


def test_status_machine(spark, tmp_path):
    feed(spark, tmp_path / "in", [("a", "send_message", "2024-01-01T00:00:00Z"), ("a", "send_message", "2024-01-01T00:00:01Z"), ("a", "ask_user", "2024-01-01T00:00:02Z"), ("b", "reply_user", "2024-01-01T00:00:02Z"), ("a", "reply_user", "2024-01-01T00:00:03Z"), ("a", "execution_complete", "2024-01-01T00:00:04Z")])
    rows = ev.from_lines(spark, str(tmp_path / "in")).select("session_id", F.try_element_at("payload", F.lit("seq")).cast("long").alias("seq"), "event")
    got = {(r.session_id, r.seq): (r.status, r.accepted) for r in polled(ev.statuses(rows), "st", spark, 6).collect()}
    assert got == {("a", 0): ("running", True), ("a", 1): ("running", False), ("a", 2): ("awaiting_user", True), ("b", 3): ("idle", False), ("a", 4): ("resuming", True), ("a", 5): ("completed", True)}


def test_sessions_stream_equals_batch(spark, sf):
    from weft.operators.sessions import activity

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    got = drain(ev.sessions(stream, "user_id"), "se", spark, "complete")
    assert got.count() == activity(spark.read.parquet(f"{sf}/events.parquet")).count()


def test_in_flight_and_fan_out(spark, tmp_path):
    feed(spark, tmp_path / "in", [("a", "send_message", "2024-01-01T00:00:00Z"), ("a", "send_message", "2024-01-01T00:00:01Z"), ("b", "send_message", "2024-01-01T00:00:02Z")])
    rows = ev.from_lines(spark, str(tmp_path / "in"))
    assert drain(ev.in_flight(rows), "fl", spark).count() == 2
    subs = spark.createDataFrame([("a", "a_1"), ("a", "a_2"), ("b", "b_1")], "session_id string, subscriber string")
    seen = []
    q = ev.broadcast(rows, subs, lambda df, i: seen.extend((r.session_id, r.subscriber) for r in df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    assert ev.run_for(q, 0.1) == "paused"
    assert sorted(seen) == [("a", "a_1")] * 2 + [("a", "a_2")] * 2 + [("b", "b_1")]


def test_replies(spark, tmp_path):
    t = spark.readStream.schema("session_id string, ts timestamp, question string").json(str((tmp_path / "q").absolute()) if not (tmp_path / "q").mkdir() else "")
    a = spark.readStream.schema("session_id string, ts timestamp, reply string").json(str(tmp_path / "r") if not (tmp_path / "r").mkdir() else "")
    (tmp_path / "q" / "1.json").write_text('{"session_id": "s", "ts": "2024-01-01T00:00:00Z", "question": "?"}')
    (tmp_path / "r" / "1.json").write_text('{"session_id": "s", "ts": "2024-01-01T00:10:00Z", "reply": "yes"}\n{"session_id": "s", "ts": "2024-01-01T02:00:00Z", "reply": "late"}')
    assert [r.reply for r in drain(ev.replies(t, a), "re", spark).collect()] == ["yes"]


def test_audit_stream(spark, tmp_path):
    feed(spark, tmp_path / "in", [("a", "x", "2024-01-01T00:00:00Z"), ("a", "y", "2024-01-02T00:00:00Z")])
    rows = ev.from_lines(spark, str(tmp_path / "in")).select("session_id", "event", "ts")
    q = ev.audit_sink(rows, str(tmp_path / "out"), str(tmp_path / "cp"), 0)
    q.processAllAvailable()
    q.stop()
    assert sorted(r.day for r in spark.read.json(str(tmp_path / "out")).select(F.col("day").cast("string").alias("day")).collect()) == ["2024-01-01", "2024-01-02"]


def test_snapshots():
    text = ev.snapshot({"phase": "x", "when": object}, "timeout")
    assert ev.restore(text)["reason"] == "timeout"

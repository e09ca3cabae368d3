"""Operators over tables that once were loops on the driver."""

from pyspark.sql import functions as F

from weft.operators import history, registry, sessions
from weft.sources import files, stores
from weft.streaming import events


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_channels(spark):
    m = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), (None, 0)], "session_id string, pos int")
    more = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 0, "z"), ("c", 0, "w")], "session_id string, pos int, role string")
    assert rows(history.appended(m.withColumn("role", F.lit("old")), more)) == sorted([("a", 0, "old"), ("a", 1, "old"), ("b", 0, "old"), (None, 0, "old"), ("a", 2, "y"), ("c", 0, "w")], key=repr)
    counts = spark.createDataFrame([("a", 1), (None, 1)], "session_id string, n int")
    assert rows(history.unsynced(m, counts)) == [("a", 1), ("b", 0)]


def test_last_of(spark):
    m = spark.createDataFrame([("a", 0, "k", "x"), ("a", 2, "k", "y"), ("a", 3, "j", "z"), ("b", 1, "j", "w")], "session_id string, pos int, message_type string, text string")
    assert rows(history.last_of(m, "k")) == [("a", "y", 2)]


def test_files_and_folders(spark, tmp_path):
    for name, size in (("x/1.txt", 3), ("x/2.txt", 4), ("y/z/3.txt", 5)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("a" * size)
    found = files.entries(spark, str(tmp_path))
    assert sorted((r.name, r["size"]) for r in found.collect()) == [("1.txt", 3), ("2.txt", 4), ("3.txt", 5)]
    assert sorted((r.name, r["size"], r.n) for r in files.folder_sizes(found).collect()) == [("x", 7, 1), ("z", 5, 1)]
    base = found.first()["folder"].rsplit("/", 1)[0] if found.first()["folder"].endswith("/x") else found.first()["folder"].rsplit("/", 2)[0]
    asked = spark.createDataFrame([(f"{base}/x",), (f"{base}/x/2.txt",), (f"{base}/no",), (None,)], "path string")
    assert rows(files.kinds(asked, found)) == sorted([(f"{base}/x", "directory"), (f"{base}/x/2.txt", "file"), (f"{base}/no", "none"), (None, "none")], key=repr)


def test_servers(spark):
    texts = ['{"mcpServers": {"a": {"command": "run", "args": ["x"]}, "b": {}}}', '{"c": {"url": "u"}}', "broken", None, "{}"]
    got = stores.server_rows(spark.createDataFrame([(t,) for t in texts], "content string"))
    assert rows(got) == [("a", "command", "run", ["x"], None), ("c", "url", None, None, "u")]


def test_templates(spark):
    r = spark.createDataFrame([("t", "A"), ("b", "B"), ("none", "C"), (None, "D")], "template string, name string")
    t = spark.createDataFrame([("t", "hi {name} {x}")], "template string, content string")
    got = stores.filled(r, t, {"name": "name"}, {"b": "built in {name}"})
    assert {(x.name, x.text) for x in got.collect()} == {("A", "hi A {x}"), ("B", "built in B"), ("C", None), ("D", None)}


def test_archive(spark):
    e = spark.createDataFrame([("s", 0), ("s", 1), ("t", 0)], "slug string, pos int")
    stay, gone = stores.archive_entries(e, spark.createDataFrame([("s", 0), ("s", 0), ("x", 9)], "slug string, pos int"))
    assert rows(stay) == [("s", 1), ("t", 0)] and rows(gone) == [("s", 0)]


def test_hooks(spark):
    h = spark.createDataFrame([("p", "late", 9, 0, True), ("p", "b", 1, 2, True), ("p", "a", 1, 1, True), ("p", "off", 0, 3, False), ("q", "c", 5, 4, True)], "point string, name string, priority int, seq int, enabled boolean")
    assert [(r.name, r.n) for r in registry.hook_order(h).orderBy("point", "n").collect()] == [("a", 1), ("b", 2), ("late", 3), ("c", 1)]
    log = spark.createDataFrame([(0, "add", "p", "x"), (1, "add", "q", "x"), (2, "remove", None, "x"), (3, "add", "p", "x"), (4, "add", "p", "y"), (5, "remove", None, "z")], "seq int, op string, point string, name string")
    assert rows(registry.standing(log)) == [("p", "x", 3), ("p", "y", 4)]


def test_loops_of_a_batch_are_asked_together(spark):
    def invoke(talks):
        return [{"content": "", "tool_calls": [{"name": "echo", "args": {"message": t[0]["content"]}}, {"name": "nope"}]} if len(t) < 3 else {"content": f"{len(talks)} at once"} for t in talks]

    r = spark.createDataFrame([("a",), ("b",), (None,)], "text string").coalesce(1)
    got = registry.run_loops(r, "text", invoke, registry.sample_tools()).collect()
    assert [(x.answer, x.n) for x in got] == [("3 at once", 5)] * 3
    endless = registry.run_loops(r, "text", lambda talks: [{"content": "", "tool_calls": [{"name": "nope"}]} for _ in talks], registry.sample_tools(), 3)
    assert {(x.answer, x.n) for x in endless.collect()} == {("[ERROR] unknown tool: nope", 7)}


def test_snapshots_of_many_runs(spark):
    s = spark.createDataFrame([(1, "x"), (2, None)], "k long, plan string")
    texts = events.snapshots(s, "timeout", "go on")
    assert events.restore(texts.first()["text"]) == {"state": {"k": 1, "plan": "x"}, "reason": "timeout", "hint": "go on"}
    again = texts.select(F.col("text").alias("value")).union(spark.createDataFrame([("{}",), ("no",), (None,)], "value string"))
    assert rows(events.restored(again, "k long, plan string")) == [(1, "x", "timeout"), (2, None, "timeout")]


def test_counts_by_key(spark):
    s = spark.createDataFrame([("p", "idle"), ("p", "running"), ("q", "paused")], "plan string, status string")
    assert rows(sessions.registered(s, most=2, by=["plan"])) == [("p", 2, 1, True), ("q", 1, 1, False)] and rows(sessions.registered(s)) == [(3, 2, False)]


def test_hooks_decide_alike_in_a_plan_and_one_by_one(spark):
    import itertools

    from weft.operators import hooks
    from weft.operators.policy import Policy

    rules = [Policy("u1", "*", "file:/a/**", "allow"), Policy("*", "run_command", "*", "deny"), Policy("unknown", "*", "*", "allow")]
    cases = list(itertools.product(("u1", "u2", "", None), ("read_file", "run_command", "ask_user", "get_time"), ("low", "high", None), (None, "", "broke")))
    calls = spark.createDataFrame([(str(i), "s", s, t, {"file_path": "/a/b", "cmd": "ls"}, r, None, "out", e) for i, (s, t, r, e) in enumerate(cases)], "call_id string, session_id string, subject string, tool_name string, args map<string,string>, risk_level string, ts timestamp, result string, error string")
    native, one_by_one = hooks.run_calls(calls, rules), hooks.run_calls(calls, rules, lambda tool, ctx: "out")
    assert rows(native) == rows(one_by_one) and "Python" not in native._jdf.queryExecution().executedPlan().toString()


def test_sums_in_two_levels(spark):
    from weft.operators.running import sums_before

    t = spark.createDataFrame([(None, 1, 5), (0, 0, 1), (0, 2, 2), (3, 1, 4), (3, None, 8)], "o int, i int, v long")
    assert rows(sums_before(t, "o", "i", "v", "n")) == sorted([(None, 1, 5, 0), (0, 0, 1, 5), (0, 2, 2, 6), (3, None, 8, 8), (3, 1, 4, 16)], key=repr)

import pytest
from pyspark.sql import functions as F

from weft.functions.text import redact
from weft.operators import audit, policy
from weft.operators.policy import Policy

GOLDEN = [Policy("*", "read_*", "file:**/*.env", "deny"), Policy("u1", "*", "*", "allow"), Policy("*", "run", "cmd:rm*", "deny"), Policy("*", "list", "dir:/a", "allow")]
CASES = [
    ("u1", "read_file", "file:/x/y.env", "deny"),
    ("u1", "write_file", "file:/x/y", "allow"),
    ("u2", "run", "cmd:rm -rf /", "deny"),
    ("u2", "list", "dir:/a/b", "allow"),
    ("u2", "list", "dir:/ab", "need_escalation"),
    ("u2", "read_file", "file:y.env", "need_escalation"),
    ("u2", "read_file", "file:\\x\\y.env", "deny"),
    (None, None, None, "need_escalation"),
]


def test_golden_decisions_both_ways(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "id int, subject string, action string, resource string")
    want = {i: c[3] for i, c in enumerate(CASES)}
    assert {r.id: r.d for r in df.select("id", policy.decide(GOLDEN).alias("d")).collect()} == want
    got = policy.decide_join(df, policy.compile_table(spark, GOLDEN), "id")
    assert {r.id: r.decision for r in got.collect()} == want


def test_the_decision_is_one_projection(spark):
    df = spark.range(5).selectExpr("'u' subject", "'run' action", "'cmd:ls' resource")
    plan = df.select(policy.decide(GOLDEN))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


@pytest.mark.parametrize(("glob", "hits", "misses"), [("a[0-2]?", ["a1x"], ["a3x", "a1"]), ("[!a]*", ["b", "bc"], ["a"]), ("a.b", ["a.b"], ["axb"])])
def test_name_globs(spark, glob, hits, misses):
    df = spark.createDataFrame([(x,) for x in hits + misses], "s string")
    assert [r.s for r in df.where(policy.matches_name(F.col("s"), glob)).collect()] == hits


def test_redaction_is_stable(spark):
    df = spark.createDataFrame([({"api_key": "x", "Author": "y", "q": "z" * 501},)], "m map<string,string>").select(redact("m").alias("m"))
    m = df.first().m
    assert m == {"api_key": "***REDACTED***", "Author": "***REDACTED***", "q": "z" * 500 + "..."}


def test_resources(spark):
    rows = [("read_file", {"file_path": "a/./b/../c"}, "file:/w/a/c"), ("file_exists", {"check_path": "/x"}, "file:/x"), ("run_command", {"cmd": " ls "}, "cmd:ls"), ("list_directory", {}, "dir:"), ("other", {}, "*")]
    df = spark.createDataFrame(rows, "t string, a map<string,string>, want string")
    assert all(r.got == r.want for r in df.withColumn("got", policy.resource_of(F.col("t"), F.col("a"), "/w")).collect())


def test_shadowed_rows():
    assert policy.shadowed([Policy("*", "*", "*", "allow"), Policy("g", "*", "*", "deny")]) == [(1, 0)]


def test_audit_sink_and_retention(spark, tmp_path):
    df = spark.sql("select timestamp '2024-01-01 01:00:00' ts, 1 a union all select timestamp '2024-03-01 01:00:00', 2")
    audit.append(df, str(tmp_path / "log"))
    audit.append(df, str(tmp_path / "log"))
    assert audit.clean(spark, str(tmp_path / "log"), "2024-03-05") == 1
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_commands(spark):
    df = spark.createDataFrame([("ls -l",), ("rm x",), ("",), (None,)], "c string")
    assert [r.ok for r in df.select(policy.allowed_command(F.col("c")).alias("ok")).collect()] == [True, False, False, False]


def test_policies_beyond_ten_thousand_count(spark):
    table = spark.range(10_050).select(F.col("id").cast("int").alias("ord"), F.lit("*").alias("p_subject"), F.lit("^x$").alias("p_action"), F.concat(F.lit("^r"), "id", F.lit("$")).alias("p_resource"), F.lit("deny").alias("effect"))
    calls = spark.range(10_050).select("id", F.lit("u").alias("subject"), F.lit("x").alias("action"), F.concat(F.lit("r"), "id").alias("resource")).where("id % 1000 = 49")
    assert [r.decision for r in policy.decide_join(calls, table, "id").collect()] == ["deny"] * 11


def test_index_equals_the_case(spark):
    """Random policies and calls; the table's plan compares no call with all policies."""
    import random

    rnd = random.Random(5)
    places = ["/a", "/a/b", "/a/b.env", "/ab", "/", "", "/x y/z", "a+b", "q?"]
    kinds = ["file:", "dir:", "cmd:", "", "other:"]
    glob = lambda: "".join(rnd.choices(["/a", "*", "**", "b", "?", ".env", "[ab]", "|", "+", "/"], k=rnd.randint(0, 4)))
    rules = [Policy(rnd.choice(["*", "u1", "u2"]), rnd.choice(["*", "read_*", "run", "l[is]*", "w-x"]), rnd.choice(["*", rnd.choice(kinds) + glob()]), rnd.choice(["allow", "deny"])) for _ in range(40)]
    calls = [(i, rnd.choice(["u1", "u2", "u3", None, "*"]), rnd.choice(["read_file", "run", "list", "w-x", None]), rnd.choice([None, rnd.choice(kinds) + rnd.choice(places), rnd.choice(kinds) + "\\a\\b"])) for i in range(300)]
    df = spark.createDataFrame(calls, "id int, subject string, action string, resource string")
    dirs = [p for p in rules if not p.resource.startswith("dir:")]  # a folder's trailing slashes only the CASE forgives
    got = policy.decide_join(df, policy.compile_table(spark, dirs), "id")
    assert {r.id: r.decision for r in got.collect()} == {r.id: r.d for r in df.select("id", policy.decide(dirs).alias("d")).collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_prefixes(spark):
    cases = {"^file:/a/[^/]*$": "file:/a/", "^file:/ab?c$": "file:/a", "^.*$": "", "^a|b$": "", "x": "", "^cmd:(?s:ls .*)$": "cmd:", "^\\Qa\\E$": "", "^file:/a\\.b$": "file:/a"}
    df = spark.createDataFrame([(k,) for k in cases], "r string")
    assert [r.p for r in df.select(policy.literal_prefix(F.col("r")).alias("p")).collect()] == list(cases.values())


def test_decisions_by_table_are_counted_not_sorted(spark):
    """The smallest order is a number, so calls are aggregated by hash, and effects follow by a join."""
    from weft.plans.security_queries import POLICIES

    calls = spark.createDataFrame([(1, "u7", "view", "x"), (2, None, None, None)], "event_id long, subject string, action string, resource string")
    got = policy.decide_join(calls, policy.compile_table(spark, POLICIES), "event_id")
    assert {r.event_id: r.decision for r in got.collect()} == {1: "allow", 2: "need_escalation"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in plan and "keys=[event_id#" in plan

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from weft.operators import messages, registry
from weft.operators.registry import ABORT, CONTROL, MODIFY, OBSERVE, Decision, Hook, Hooks, Refused, Tools


def tools():
    t = Tools()

    @t.tool(description="echo")
    def echo(message: str):
        return message

    @t.tool(risk="medium", returns="double")
    def add(a: float, b: float = 1.0):
        return a + b

    @t.tool(risk="high")
    def shell(cmd: str):
        return cmd

    return t


def test_tools_become_functions(spark):
    t = tools()
    assert t.as_functions(spark) == ["echo", "add"]
    assert spark.sql("select echo('x') e, add(1.0D, 2.0D) s").first().asDict() == {"e": "x", "s": 3.0}
    assert [p["required"] for p in t.get("add").parameters] == [True, False] and t.get("add").parameters[0]["type"] == "number"


def test_external_tools():
    t = Tools()
    got = t.add_external("srv", "go", {"properties": {"n": {"type": ["integer", "null"]}, "s": {}}, "required": ["n"]}, print, risks={"go": "low"})
    assert got.name == "mcp__srv__go" and got.risk == "low"
    assert got.parameters == [{"name": "n", "type": "integer", "description": "", "required": True}, {"name": "s", "type": "string", "description": ""}]


def test_hook_order_and_control():
    h, seen = Hooks(), []
    h.add("before", Hook(20, "late", OBSERVE, lambda c: seen.append("late")))
    h.add("before", Hook(10, "early", MODIFY, lambda c: {"x": 1}))
    h.add("before", Hook(15, "broken", OBSERVE, lambda c: 1 / 0))
    ctx = {}
    assert h.fire("before", ctx).action == "continue" and ctx["x"] == 1 and seen == ["late"] and "broken" in ctx["warnings"][0]
    h.add("before", Hook(12, "guard", CONTROL, lambda c: Decision(ABORT, "no")))
    assert h.fire("before", {}).reason == "no" and seen == ["late"]
    h.remove("guard")
    h.add("before", Hook(12, "guard2", CONTROL, lambda c: 1 / 0))
    assert h.fire("before", {}).action == ABORT


def test_hooks_over_frames(spark):
    h = Hooks()
    h.add("out", Hook(1, "double", MODIFY, lambda df: df.withColumn("x", F.col("id") * 2)))
    h.add("out", Hook(2, "guard", CONTROL, lambda df: Decision(ABORT, "secret") if "secret" in df.columns else None))
    assert h.transform("out", spark.range(2)).columns == ["id", "x"]
    with pytest.raises(Refused):
        h.transform("out", spark.range(2).withColumn("secret", F.lit(1)))


def test_skill_levels(spark):
    a = spark.createDataFrame([(0, "calc", "calculation", "does sums"), (1, "web", "web_search", "searches pages"), (2, "gp", "general", "does anything")], "pos long, agent string, skill string, description string")
    q = spark.createDataFrame([("Web Search",), ("calc",), ("pages-x",), ("q",)], "query string")
    got = {(r.query, r.agent, r.level) for r in registry.match_skill(q, a).collect()}
    assert got == {("Web Search", "web", 1), ("calc", "calc", 2), ("pages-x", "web", 3)}
    assert {r.query: r.agent for r in registry.assign(q, a).collect()}["q"] == "calc"


def test_tool_loop():
    answers = iter([{"content": "", "tool_calls": [{"name": "add", "args": {"a": 1.0, "b": 2.0}}, {"name": "nope"}]}, {"content": "3"}])
    got = registry.tool_loop(lambda m: next(answers), tools(), [{"role": "user", "content": "1+2"}])
    assert [m.get("content") for m in got] == ["1+2", "", "3.0", "[ERROR] unknown tool: nope", "3"]


def test_overrides(spark):
    b = spark.createDataFrame([("x", 0, "b"), ("y", 1, "b")], "name string, pos int, v string")
    u = spark.createDataFrame([("y", 0, "u"), ("z", 1, "u")], "name string, pos int, v string")
    got = [(r.name, r.v) for r in registry.override(b, u).orderBy("user_only", "pos").collect()]
    assert got == [("x", "b"), ("y", "u"), ("z", "u")]


def test_messages_round_trip(spark):
    blocks = [("text", "hi", None, None, None), ("thinking", None, "hm", None, None), ("tool_use", None, None, ("1", "t", {"a": "b"}), None)]
    from weft.schemas import MESSAGES

    df = spark.createDataFrame([("s", 0, "assistant", None, blocks, "n", "tool_call", "m", 1, None, {}, None)], MESSAGES)
    row = messages.to_chat(df).first()
    assert row.content == "hi\nhm" and row.tool_calls[0].tool_name == "t" and row.name == "n"
    flags = df.select(messages.is_valid().alias("v"), messages.is_tool_call().alias("c"), messages.is_tool_result().alias("r")).first()
    assert (flags.v, flags.c, flags.r) == (True, True, False)


def test_agents_beyond_ten_thousand_count(spark):
    n = 10_050
    agents = spark.range(n).select(F.col("id").alias("pos"), F.concat(F.lit("a"), "id").alias("agent"), F.concat(F.lit("skill"), "id").alias("skill"), F.lit("").alias("description"))
    asked = spark.range(n).select(F.concat(F.lit("skill"), "id").alias("query")).where("query rlike '00[0-9][0-9]$'")
    got = registry.match_skill(asked, agents).where("level = 1")
    assert got.count() == asked.count() and got.where("query = 'skill10049'").count() == 1
    assert registry.catalog_text(agents).first()["catalog"].count("\n") == n - 1


def test_each_risk_has_its_route(spark):
    t = Tools()

    @t.tool(risk="medium")
    def slow(text: str):
        import time

        time.sleep(5 if text == "late" else 0)
        return text.upper()

    @t.tool(risk="medium", returns="double")
    def inverse(x: float):
        return 1 / x

    t.add(registry.Tool("twice", "", None, "low", "string", [{"name": "x", "type": "string"}], sql="concat(x, x)"))
    t.add(registry.Tool("shell_", "", str, "high"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION shell_(x string) RETURNS string RETURN x")
    assert t.as_functions(spark, limit=0.5) == ["slow", "inverse", "twice"]
    rows = spark.createDataFrame([("late", 0.0), ("ok", 2.0), (None, 4.0)], "s string, x double")
    low = rows.select(F.expr("twice(s)").alias("v"))
    plan = low._jdf.queryExecution().executedPlan().toString()
    assert [r.v for r in low.collect()] == ["latelate", "okok", None] and "Python" not in plan and "Arrow" not in plan
    said = [r.v for r in rows.select(F.expr("slow(s)").alias("v")).collect()]
    assert said[:2] == [registry.OVERTIME.format("0.5"), "OK"] and said[2].startswith("Error: ")
    assert [r.v for r in rows.select(F.expr("inverse(x)").alias("v")).collect()] == [None, 0.5, 0.25]
    with pytest.raises(AnalysisException):
        rows.select(F.expr("shell_(s)"))


def test_tools_of_a_package(spark):
    t = Tools()
    assert t.discover("weft.tools") == 4 and sorted(t.names()) == ["initials", "label", "numbered_lines", "run_anything"]
    assert t.as_functions(spark) == [n for n in t.names() if n != "run_anything"]
    spark.createDataFrame([(1, "a\n\nb"), (2, ""), (3, None)], "id int, text string").createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT id, n, line FROM some_texts, LATERAL numbered_lines(text)").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "a"), (1, 2, ""), (1, 3, "b"), (2, 1, "")]


def test_skills_equal_every_pair(spark):
    """The levels by comparing each query with each agent."""
    import random

    rnd = random.Random(4)
    name = lambda: rnd.choice(["", "_", " ", "-"]).join(rnd.choices(["ab", "web", "Calc", "x", "search", "su"], k=rnd.randint(1, 3)))
    agents = [(i, f"a{i}", rnd.choice([name(), name(), "", None]), rnd.choice(["does sums", "searches the web", name(), None])) for i in range(30)]
    asked = [name() for _ in range(60)] + ["", None, "zzz"]
    norm = lambda s: None if s is None else s.lower().replace("_", "-").replace(" ", "-")
    want = set()
    for q in {x for x in asked if x}:
        n, levels = norm(q), {1: [], 2: [], 3: []}
        for pos, agent, skill, told in agents:
            s, d = norm(skill), told and told.lower()
            if s is not None and s == n:
                levels[1].append((pos, agent))
            elif s is not None and len(n) >= 3 and (n in s or s in n):
                levels[2].append((pos, agent))
            elif d and (n in d or any(len(w) >= 2 and w in d for w in n.split("-"))):
                levels[3].append((pos, agent))
        level = next((k for k in levels if levels[k]), None)
        want |= {(q, a, level) for _, a in sorted(levels[level])[: 1 if level == 1 else None]} if level else set()
    got = registry.match_skill(spark.createDataFrame([(x,) for x in asked], "query string"), spark.createDataFrame(agents, "pos long, agent string, skill string, description string"))
    assert {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

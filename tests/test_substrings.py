import random

from pyspark.sql import functions as F

from weft.operators.substrings import containing
from weft.plans import context


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equals_every_pair(spark):
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("ab-中") for _ in range(rnd.randint(0, n)))
    needles, texts = [(rnd.randrange(3), word(5)) for _ in range(150)] + [(0, None), (1, "")], [(rnd.randrange(3), word(12)) for _ in range(150)] + [(0, None), (2, "")]
    got = containing(spark.createDataFrame(needles, "k int, needle string"), spark.createDataFrame(texts, "k int, text string"), ["k"])
    want = {(k, n, t) for k, n in needles for j, t in texts if k == j and n is not None and t is not None and n in t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and "NestedLoop" not in joins(got) and "Cartesian" not in joins(got)


def test_relevant_messages_equal_every_pair(spark):
    """Keywords count as parts of words, too; no join on the session alone."""
    rnd = random.Random(2)
    words = ["plan", "planning", "a_b", "Test", "test1", "xx", "数据", "数据分析", "分析", "the", "THE", "other"]
    text = lambda n: rnd.choice([" ", "", ", "]).join(rnd.choices(words, k=n))
    said = [(s, p, rnd.choice(["user_input", "final_answer", "tool_call"]), rnd.choice([text(3), text(6), "", None])) for s in "ab" for p in range(25)]
    tasks = [(s, f"{s}{i}", rnd.choice([text(2), text(4), None])) for s in "abc" for i in range(8)]
    m, t = spark.createDataFrame(said, "session_id string, pos int, message_type string, text string"), spark.createDataFrame(tasks, "session_id string, task_id string, description string")
    got = context.relevant(m, t, 10**6)
    from weft.functions.text import overlap, task_keywords

    pairs = m.where("message_type != 'tool_call' and text != ''").join(t, "session_id").where(overlap(task_keywords("description"), "text") >= 2)
    rows = lambda df: sorted((r.session_id, r.task_id, r.pos) for r in df.select("session_id", "task_id", "pos").collect())
    assert rows(got) == rows(pairs) and rows(got)
    plan = joins(context.relevant(m, t))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "needle string, text string")
    assert containing(none.select("needle"), none.select("text")).count() == 0
    assert containing(spark.range(1).select(F.lit("abcd").alias("needle")), none.select("text")).count() == 0


def test_relevant_messages_meet_keywords_as_equals(spark, monkeypatch):
    """Parts of short runs meet keywords without n-grams; runs of more than 24 characters and many runs lose none."""
    asked = []
    monkeypatch.setattr(context, "containing", lambda needles, texts, by: asked.append(texts) or containing(needles, texts, by))
    many = " ".join(f"w{i}" for i in range(600))
    m = spark.createDataFrame([("a", 1, "user_input", "x" * 30 + "needle " + "一" * 25 + "数据"), ("a", 2, "user_input", "needles 数据"), ("a", 3, "user_input", many), ("a", 4, "user_input", "é")], "session_id string, pos int, message_type string, text string")
    t = spark.createDataFrame([("a", "t1", "needle 数据"), ("a", "t2", "w255 w599")], "session_id string, task_id string, description string")
    got = context.relevant(m, t)
    assert sorted((r.task_id, r.pos) for r in got.collect()) == [("t1", 1), ("t1", 2), ("t2", 3)]
    assert sorted(len(r.text) for r in asked[0].collect()) == [27, 36]

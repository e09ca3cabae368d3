import random

from weft.functions.text import estimate_tokens
from weft.operators import history

DDL = "session_id long, pos long, role string, text string, message_type string, turn_index long, approved boolean"


def loop_prune(rows, threshold, keep):
    """A plain loop over one session's rows (pos, tokens, priority, turn)."""
    total = sum(r[1] for r in rows)
    last = max(r[3] for r in rows)
    old = [r for r in rows if r[3] < max(1, last - keep + 1)]
    gone = set()
    for p in (4, 3, 2, 1):
        for r in old:
            if r[2] == p and total > threshold:
                gone.add(r[0])
                total -= r[1]
    return {r[0] for r in rows} - gone


def test_prune_equals_a_loop(spark):
    rnd = random.Random(4)
    kinds = list(history.PRIORITY)
    data, want = [], set()
    for s in range(6):
        turn, rows = 0, []
        for pos in range(40):
            kind = rnd.choice(kinds)
            turn += kind == "user_input"
            text = "x" * rnd.randint(0, 200)
            rows.append((pos, len(text) // 4, history.PRIORITY[kind], turn))
            data.append((s, pos, "user", text, kind, turn, None))
        want |= {(s, p) for p in loop_prune(rows, 400, 3)}
    got = {(r.session_id, r.pos) for r in history.prune(spark.createDataFrame(data, DDL), 400, 3).collect()}
    assert got == want


def test_prune_keeps_users_and_recent_turns(spark):
    data = [(1, i, "user" if i % 3 == 0 else "assistant", "y" * 400, "user_input" if i % 3 == 0 else "tool_call", i // 3 + 1, None) for i in range(30)]
    got = history.prune(spark.createDataFrame(data, DDL), 0, 2)
    assert {r.pos for r in got.collect()} == {r[1] for r in data if r[4] == "user_input" or r[5] >= 9}


def test_rejected_needs_an_explicit_no(spark):
    df = spark.createDataFrame([(1, 0, "a", "t", "plan_proposal", 1, v) for v in (True, False, None)], DDL)
    assert df.where(history.is_rejected()).count() == 1


def test_tokens(spark):
    texts = ["", "abcd", "abc", "中文字", "中文ab", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(estimate_tokens("t").alias("n")).collect()
    assert [r.n for r in got] == [0, 1, 0, 2, 1, 0]


def test_budgets(spark):
    df = spark.createDataFrame([("a", i, 10) for i in range(5)], "k string, i long, c int")
    over = history.budget(df, ["k"], "i", df["c"], 25, overshoot=True)
    within = history.budget(df, ["k"], "i", df["c"], 25, overshoot=False)
    assert sorted(r.i for r in over.collect()) == [0, 1, 2]
    assert sorted(r.i for r in within.collect()) == [0, 1]


def test_summary_falls_back(spark):
    data = [(1, i, "user", "z" * 4000, "user_input", i + 1, None) for i in range(6)]
    got = history.summarize(spark.createDataFrame(data, DDL), lambda texts: [None] * len(texts), 100, 2, fallback=50)
    rows = {r.pos: r.text for r in got.collect()}
    assert sorted(rows) == [0, 4, 5] and len(rows[0]) == 50


def test_turn_numbers_cross_blocks(spark):
    n = 2500
    df = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant") for i in range(n)], "session_id long, pos long, role string")
    got = {r.pos: r.turn_index for r in history.number_turns(df).collect()}
    assert all(got[i] == (i + 1) // 2 for i in range(n))


def test_compaction_equals_its_parts(spark):
    """Turn numbers, filter and pruning in one against one after the other; blocks are crossed, sessions may be null."""
    rnd = random.Random(6)
    kinds = list(history.PRIORITY)
    data = []
    for s in (1, 2, None):
        for pos in range(2300 if s == 1 else 30):
            role = "user" if rnd.random() < 0.2 else "assistant"
            data.append((s, pos, role, rnd.choice([None, "x" * rnd.randint(0, 200)]), "user_input" if role == "user" else rnd.choice(kinds), None, rnd.choice([True, False, None])))
    df = spark.createDataFrame(data, DDL).drop("turn_index")
    for threshold, keep in ((400, 3), (30_000, 1), (0, 500)):
        parts = history.prune(history.eligible(history.number_turns(df)).where(~history.is_rejected()), threshold, keep)
        got = history.compact(df, threshold, keep, history.is_eligible() & ~history.is_rejected())
        rows = lambda f: sorted((repr(r.session_id), r.pos, r.turn_index, r.tokens, r.priority) for r in f.collect())
        assert rows(got) == rows(parts)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 1  # the messages themselves are read once more, and no oftener

"""Queries over policies, audit records, sessions and event streams, carried by events."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.prose_json import from_prose
from weft.functions.text import ellipsis, redact
from weft.operators import audit, messages, policy, sessions
from weft.operators.policy import Policy
from weft.operators.stored import folder

from . import views
from .registry import query
from .views import CALLS

POLICIES = [
    Policy("*", "*", "file:**/*.env", "deny"),
    Policy("u7", "*", "*", "allow"),
    Policy("*", "c*k", "file:/v/1?/**", "deny"),
    Policy("*", "view", "file:/v/*/*", "allow"),
    Policy("u9", "[ps]*", "*", "deny"),
    Policy("*", "signup", "dir:/v", "allow"),
    Policy("*", "purchase", "file:/v/2*/**", "allow"),
    Policy("*", "error", "*", "deny"),
]
DECIDED = """CASE WHEN regexp_matches(resource, '^file:.*/[^/]*\\.env$') THEN 'deny' WHEN subject = 'u7' THEN 'allow'
  WHEN regexp_matches(action, '^c.*k$') AND regexp_matches(resource, '^file:/v/1[^/]/.*$') THEN 'deny'
  WHEN action = 'view' AND regexp_matches(resource, '^file:/v/[^/]*/[^/]*$') THEN 'allow'
  WHEN subject = 'u9' AND regexp_matches(action, '^[ps].*$') THEN 'deny'
  WHEN action = 'purchase' AND regexp_matches(resource, '^file:/v/2[^/]*/.*$') THEN 'allow'
  WHEN action = 'error' THEN 'deny' ELSE 'need_escalation' END"""
TOOL_POLICIES = [Policy("*", "run_command", "cmd:ls *1", "deny"), Policy("*", "read_*", "file:/v/1/**", "allow"), Policy("*", "list_directory", "dir:/v/2", "allow"), Policy("*", "get_time", "*", "allow")]


@query(f"WITH {CALLS} SELECT event_id, {DECIDED} AS decision FROM calls")
def jn01_policy(spark, sf_dir):
    return views.calls(spark, sf_dir).select("event_id", policy.decide(POLICIES).alias("decision"))


@query(f"WITH {CALLS} SELECT event_id, {DECIDED} AS decision FROM calls")
def jn01_policy_table(spark, sf_dir):
    c = views.calls(spark, sf_dir).select("event_id", "subject", "action", "resource")
    return policy.decide_join(c, policy.compile_table(spark, POLICIES), "event_id")


@query(f"""WITH {CALLS} SELECT event_id, EXISTS (SELECT 1 FROM calls t WHERE t.action = 'signup' AND t.session_id = c.session_id AND t.tool_name = c.tool_name
    AND c.ts BETWEEN t.ts AND t.ts + INTERVAL 1 DAY AND starts_with(c.resource, 'file:/v/' || t.user_id || '/')) AS granted FROM calls c WHERE c.action <> 'signup'""")
def jn11_token(spark, sf_dir):
    c = views.calls(spark, sf_dir)
    t = c.where("action = 'signup'").select("session_id", "tool_name", F.concat(F.lit("file:/v/"), "session_id", F.lit("/")).alias("resource"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 1 day")).alias("expires_at"), F.lit(True).alias("approved"), F.lit(False).alias("denied"))
    return policy.granted(c.where("action != 'signup'").select("event_id", "session_id", "tool_name", "resource", "ts"), t).select("event_id", "granted")


@query(f"WITH {CALLS} SELECT event_id, touched AS resource FROM calls")
def pf16_resource(spark, sf_dir):
    return views.calls(spark, sf_dir).select("event_id", policy.resource_of(F.col("tool_name"), F.col("args")).alias("resource"))


@query("SELECT event_id, '***REDACTED***' AS api_key, '***REDACTED***' AS author, CASE WHEN (event_id % 400) * 2 > 500 THEN left(repeat('ab', CAST(event_id % 400 AS INTEGER)), 500) || '...' ELSE repeat('ab', CAST(event_id % 400 AS INTEGER)) END AS q FROM events")
def sc10_redact(spark, sf_dir):
    c = views.calls(spark, sf_dir).select("event_id", redact("args").alias("r"))
    return c.select("event_id", F.col("r")["api_key"].alias("api_key"), F.col("r")["Author"].alias("author"), F.col("r")["q"].alias("q"))


@query("SELECT event_id, CASE WHEN length(props) > 8 THEN left(props, 8) || '...' ELSE props END AS props FROM events")
def sc11_truncate(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", ellipsis("props", 8).alias("props"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS call_sequence FROM events")
def wn06_sequence(spark, sf_dir):
    return audit.number(views.table(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", F.col("call_sequence").cast("bigint").alias("call_sequence"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= DATE '2024-02-14' - 30 GROUP BY 1")
def io12_retention(spark, sf_dir):
    path = folder(spark, "audit")
    audit.append(views.table(spark, sf_dir, "events").select("event_id", "ts"), path)
    audit.clean(spark, path, "2024-02-14")  # whole days go
    kept = spark.read.schema("event_id long, ts timestamp, day string").json(path)
    return kept.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query(f"""WITH {CALLS}, d AS (SELECT *, CASE WHEN regexp_matches(touched, '^cmd:ls .*1$') THEN 'deny'
    WHEN tool_name = 'read_file' AND starts_with(touched, 'file:/v/1/') THEN 'allow' WHEN tool_name = 'list_directory' AND starts_with(touched, 'dir:/v/2/') THEN 'allow'
    WHEN tool_name = 'get_time' THEN 'allow' ELSE 'need_escalation' END AS decision FROM calls)
  SELECT event_id, touched AS resource, CASE WHEN decision = 'deny' THEN 'denied' WHEN decision = 'need_escalation' AND risk_level <> 'low' THEN 'escalated' WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status FROM d""")
def pl05_audited_calls(spark, sf_dir):
    r = audit.records(views.calls(spark, sf_dir), TOOL_POLICIES)
    return r.select(F.col("call_id").cast("bigint").alias("event_id"), "resource", "status")


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
  SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ends, count(*) AS n_events FROM s GROUP BY user_id, sid""")
def ss05_sessions(spark, sf_dir):
    return sessions.activity(views.table(spark, sf_dir, "events"))


@query("SELECT user_id, max(ts) < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1800 SECOND AS expired FROM events GROUP BY 1")
def ss05_expired(spark, sf_dir):
    last = views.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_active_at")).withColumns({"status": F.lit("idle"), "checkpoint_created_at": F.lit(None).cast("timestamp")})
    return last.select("user_id", sessions.is_expired(F.lit("2024-01-30 12:00:00")).alias("expired"))


@query("""SELECT user_id, 'llm_stream_start' AS event, 0 AS n FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, 'llm_stream_chunk', row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 FROM events
  UNION ALL SELECT user_id, 'llm_stream_end', count(*) FROM events GROUP BY user_id""")
def ss03_token_events(spark, sf_dir):
    return sessions.token_events(views.table(spark, sf_dir, "events"), "user_id", "event_id")


@query("SELECT e.user_id, e.event_id FROM events e LEFT JOIN (SELECT user_id, min(event_id) AS stop FROM events WHERE event_type = 'purchase' GROUP BY 1) s USING (user_id) WHERE stop IS NULL OR event_id <= stop")
def ss07_close(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return sessions.until_terminal(e, "user_id", "event_id", ("purchase",), "event_type").select("user_id", "event_id")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, floor(epoch(ts) / 300)")
def ss10_dedup(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return sessions.first_in_flight(e, "user_id", "ts", 300).select("user_id", "event_id")


@query("""SELECT event_id, CASE WHEN event_type = 'view' AND event_id % 7 IN (0, 4) THEN 'running' WHEN event_type = 'click' AND event_id % 7 = 1 THEN 'paused'
    WHEN event_type = 'purchase' AND event_id % 7 IN (1, 3) THEN 'completed' ELSE CASE event_id % 7 WHEN 0 THEN 'idle' WHEN 1 THEN 'running' WHEN 2 THEN 'paused' WHEN 3 THEN 'resuming' WHEN 4 THEN 'completed' WHEN 5 THEN 'expired' ELSE 'awaiting_user' END END AS status FROM events""")
def ss04_transition(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, sessions.STATUSES)), (F.col("event_id") % 7 + 1).cast("int"))
    event = F.when(F.col("event_type") == "view", "send_message").when(F.col("event_type") == "click", "interrupt").when(F.col("event_type") == "purchase", "execution_complete").otherwise("heartbeat")
    return e.select("event_id", sessions.transition(status, event).alias("status"))


@query("SELECT user_id, max(ts) AS last_active_at FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def tk02_sessions(spark, sf_dir):
    s = views.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last_active_at"))
    return sessions.listing(s).withColumnRenamed("session_id", "user_id")


@query("SELECT user_id, last FROM (SELECT user_id, max(ts) AS last, row_number() OVER (ORDER BY max(ts) DESC, user_id) AS n FROM events GROUP BY 1) WHERE n > 50")
def tk03_lru(spark, sf_dir):
    s = views.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last_active_at"))
    return sessions.evicted(s).select(F.col("session_id").alias("user_id"), F.col("last_active_at").alias("last"))


@query("SELECT event_id, user_id || '_' || s AS subscriber FROM events, (VALUES ('a'), ('b')) t(s) WHERE user_id % 2 = 0 OR s = 'a'")
def jn14_fan_out(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"))
    users = e.select("session_id").distinct()
    who = F.explode(F.when(F.col("session_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))))
    subs = users.select("session_id", who.alias("s")).select("session_id", F.concat_ws("_", "session_id", "s").alias("subscriber"))
    return sessions.fan_out(e, subs).select("event_id", "subscriber")


@query("SELECT event_id, CAST(event_id % 100 + event_id % 10 AS BIGINT) AS total, CAST(event_id % 100 AS BIGINT) AS prompt, CAST(event_id % 10 AS BIGINT) AS completion FROM events")
def ag14_usage(spark, sf_dir):
    a, b = (F.col("event_id") % 100).cast("string"), (F.col("event_id") % 10).cast("string")
    raw = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("input_tokens"), a, F.lit("output_tokens"), b)).otherwise(F.create_map(F.lit("prompt_tokens"), a, F.lit("completion_tokens"), b))
    return views.table(spark, sf_dir, "events").select("event_id", messages.usage(raw).alias("u")).select("event_id", "u.*")


@query("SELECT event_id, 'push' AS type, event_type AS event, props AS body, '1.0' AS version FROM events")
def pf22_envelope(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    line = messages.encode_envelope(F.lit("push"), F.col("event_type"), F.create_map(F.lit("body"), F.col("props")), F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    got = e.select(messages.decode_envelope(line).alias("x"))
    return got.select(F.col("x.id").cast("bigint").alias("event_id"), "x.type", "x.event", F.col("x.payload")["body"].alias("body"), "x.version")


@query("SELECT event_id, props AS found FROM events")
def pa06_json(spark, sf_dir):
    p = F.col("props")
    prose = F.when(F.col("event_id") % 3 == 0, p).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("I think } that "), p, F.lit(" is it. {not json}")))
    return views.table(spark, sf_dir, "events").select("event_id", from_prose(prose).alias("found"))


@query("""SELECT n_nationkey, CASE n_nationkey % 15 WHEN 0 THEN 400 WHEN 1 THEN 404 WHEN 2 THEN 410 WHEN 3 THEN 429 WHEN 4 THEN 409 WHEN 5 THEN 409 WHEN 6 THEN 422
  WHEN 10 THEN 502 WHEN 12 THEN 504 ELSE 500 END AS status FROM nation""")
def pf23_status(spark, sf_dir):
    names = F.array(*map(F.lit, [*messages.HTTP_STATUS, "OTHER"]))
    return views.table(spark, sf_dir, "nation").select("n_nationkey", messages.http_status(F.element_at(names, F.col("n_nationkey") % 15 + 1)).alias("status"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN '用户选择了: b' WHEN n_nationkey % 4 = 1 THEN '用户批准了该操作' WHEN n_nationkey % 4 = 2 THEN '用户拒绝了该操作' ELSE '(用户未提供回答)' END AS reply FROM nation""")
def pf24_user_reply(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    said = F.when(k == 1, "YES").when(k == 2, "never").otherwise("")
    got = messages.user_reply(F.array(F.lit("a"), F.lit("b")), F.when(k == 0, 1).when(k == 3, 9), k.isin(1, 2), said)
    return views.table(spark, sf_dir, "nation").select("n_nationkey", got.alias("reply"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '任务尚未制定计划' WHEN n_nationkey % 3 = 1 THEN '任务已执行 ' || n_nationkey || '/25 个子任务，恢复后将继续执行剩余子任务' ELSE '编排阶段: ' || n_name END AS hint FROM nation""")
def pf25_hint(spark, sf_dir):
    k = F.col("n_nationkey") % 3
    phase = F.when(k == 1, F.lit("task_execution")).otherwise(F.col("n_name"))
    return views.table(spark, sf_dir, "nation").select("n_nationkey", messages.recovery_hint(phase, k != 0, F.lit(25), F.col("n_nationkey")).alias("hint"))

"""Queries over conversation history."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.text import display_width, estimate_tokens
from weft.operators import history, messages, registry, sessions

from . import context, views
from .registry import query
from .views import AGENTS, MESSAGES, PRIORITY

RECENT = "turn_index >= greatest(1, max(turn_index) OVER (PARTITION BY session_id) - {n} + 1)"
PRUNED = """
  marked AS (SELECT *, {recent} AS recent, {prio} AS priority, sum(tokens) OVER (PARTITION BY session_id) AS total FROM {src}),
  gone AS (SELECT *, coalesce(sum(CASE WHEN NOT recent AND priority > 0 THEN tokens ELSE 0 END) OVER (PARTITION BY session_id
    ORDER BY CASE WHEN NOT recent AND priority > 0 THEN priority ELSE -1 END DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM marked),
  kept AS (SELECT * FROM gone WHERE NOT (NOT recent AND priority > 0 AND total - before > {limit}))"""
ELIGIBLE = "message_type NOT IN ('guard_plan_review', 'plan_task_dispatch', 'tool_call', 'tool_result')"
REJECTED = "(message_type IN ('plan_proposal', 'plan_result_synthesis') AND approved IS NOT DISTINCT FROM false)"


def pruned(src: str, keep: int = 2, limit: int = 200) -> str:
    return PRUNED.format(recent=RECENT.format(n=keep), prio=PRIORITY, src=src, limit=limit)


@query(f"WITH {MESSAGES} SELECT session_id, pos, tokens FROM msg")
def sc01_tokens(spark, sf_dir):
    return views.plain_messages(spark, sf_dir).select("session_id", "pos", estimate_tokens("text").cast("bigint").alias("tokens"))


@query("SELECT conv_id AS session_id, turn AS pos, CAST(length(text) AS BIGINT) AS width FROM conversations")
def sc18_width(spark, sf_dir):
    return views.plain_messages(spark, sf_dir).select("session_id", "pos", display_width("text").cast("bigint").alias("width"))


@query(f"WITH {MESSAGES} SELECT session_id, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n_messages FROM msg GROUP BY session_id")
def ag01_session_tokens(spark, sf_dir):
    return history.token_totals(views.plain_messages(spark, sf_dir))


@query(f"WITH {MESSAGES} SELECT session_id, CAST({PRIORITY} AS INTEGER) AS priority, count(*) AS n FROM msg GROUP BY ALL")
def ag03_by_priority(spark, sf_dir):
    return views.plain_messages(spark, sf_dir).groupBy("session_id", history.priority().alias("priority")).agg(F.count("*").alias("n"))


@query(f"WITH {MESSAGES} SELECT session_id, coalesce(min(turn_index) FILTER (turn_index > 0), 1) || ' ~ ' || coalesce(max(turn_index) FILTER (turn_index > 0), 1) AS turns FROM msg GROUP BY session_id")
def ag04_turns_range(spark, sf_dir):
    return history.turns_range(views.messages(spark, sf_dir))


@query(
    f"WITH {MESSAGES}, {pruned('msg')} SELECT a.session_id, messages_before, tokens_before, coalesce(messages_after, 0) AS messages_after, coalesce(tokens_after, 0) AS tokens_after, coalesce(messages_after, 0) < messages_before AS did_compress"
    " FROM (SELECT session_id, count(*) AS messages_before, CAST(sum(tokens) AS BIGINT) AS tokens_before FROM msg GROUP BY 1) a"
    " LEFT JOIN (SELECT session_id, count(*) AS messages_after, CAST(sum(tokens) AS BIGINT) AS tokens_after FROM kept GROUP BY 1) b USING (session_id)"
)
def ag05_compression(spark, sf_dir):
    m = views.plain_messages(spark, sf_dir)
    return history.compression_report(m, history.compact(m, 200, 2))


@query(f"WITH {MESSAGES} SELECT session_id, count(*) AS message_count, max(turn_index) AS turn_count, left(arg_min(text, pos), 100) AS preview FROM msg GROUP BY session_id")
def ag06_session_summary(spark, sf_dir):
    return sessions.summaries(views.messages(spark, sf_dir))


@query(f"WITH {MESSAGES} SELECT session_id, pos, message_type FROM msg WHERE {ELIGIBLE}")
def pf01_eligible(spark, sf_dir):
    return history.eligible(views.plain_messages(spark, sf_dir)).select("session_id", "pos", "message_type")


@query(f"WITH {MESSAGES} SELECT session_id, pos FROM msg WHERE {REJECTED}")
def pf02_rejected(spark, sf_dir):
    return views.plain_messages(spark, sf_dir).where(history.is_rejected()).select("session_id", "pos")


@query(f"WITH {MESSAGES} SELECT session_id, pos, {RECENT.format(n=2)} AS recent FROM msg")
def pf03_recent(spark, sf_dir):
    return history.mark_recent(views.messages(spark, sf_dir), 2).select("session_id", "pos", "recent")


@query(f"WITH {MESSAGES} SELECT session_id, pos FROM (SELECT *, {RECENT.format(n=1)} AS recent FROM msg) WHERE recent")
def pf04_last_turns(spark, sf_dir):
    return history.last_turns(views.messages(spark, sf_dir), 1).select("session_id", "pos")


@query("SELECT conv_id AS session_id, turn AS pos, role AS chat_role, text AS content FROM conversations")
def pf06_chat_roles(spark, sf_dir):
    return messages.to_chat(views.full_messages(spark, sf_dir)).select("session_id", "pos", "chat_role", "content")


@query("SELECT conv_id AS session_id, turn AS pos, role, CASE WHEN role = 'user' THEN 'user_input' WHEN role = 'assistant' AND turn % 4 > 1 THEN 'tool_call' WHEN role = 'assistant' THEN 'agent_response' ELSE 'system_prompt' END AS message_type FROM conversations")
def pf07_from_chat(spark, sf_dir):
    rows = views.plain_messages(spark, sf_dir).select("session_id", "pos", F.col("role").alias("chat_role"), F.when(F.col("pos") % 4 > 1, F.col("pos")).otherwise(0).alias("n_calls"))
    return messages.from_chat(rows).select("session_id", "pos", "role", "message_type")


@query("SELECT conv_id AS session_id, turn AS pos, text <> '' AS valid FROM conversations")
def pf10_validate(spark, sf_dir):
    return views.full_messages(spark, sf_dir).select("session_id", "pos", messages.is_valid().alias("valid"))


@query(f"WITH {MESSAGES} SELECT session_id, pos, turn_index FROM msg")
def wn05_turns(spark, sf_dir):
    return views.messages(spark, sf_dir).select("session_id", "pos", F.col("turn_index").cast("bigint").alias("turn_index"))


@query(f"WITH {MESSAGES}, {pruned('msg')} SELECT session_id, pos FROM kept")
def wn01_prune(spark, sf_dir):
    return history.compact(views.plain_messages(spark, sf_dir), 200, 2).select("session_id", "pos")


@query(f"""WITH {MESSAGES},
  kw AS (SELECT session_id, list_distinct(regexp_extract_all(lower(arg_min(text, pos)), '[a-zA-Z0-9_]{{2,}}')) AS kws FROM msg WHERE role = 'user' GROUP BY 1),
  hit AS (SELECT m.session_id, pos, '[' || message_type || ']: ' || left(text, 500) AS line FROM msg m JOIN kw USING (session_id)
    WHERE message_type IN ('user_input', 'final_answer') AND text <> '' AND len(list_filter(kws, lambda k: contains(lower(text), k))) >= 2),
  run AS (SELECT *, coalesce(sum(floor(length(line) / 4.0e0)) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM hit)
  SELECT session_id, pos FROM run WHERE used < 150""")
def wn02_relevant(spark, sf_dir):
    m = views.plain_messages(spark, sf_dir)
    tasks = m.where("role = 'user'").groupBy("session_id").agg(F.min_by("text", "pos").alias("description")).withColumn("task_id", F.lit("t"))
    return context.relevant(m, tasks, 150).select("session_id", "pos")


@query("SELECT session_id, pos, chars FROM (SELECT conv_id AS session_id, turn AS pos, CAST(length(left(text, 300)) AS BIGINT) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def wn11_tail(spark, sf_dir):
    return history.tail(views.plain_messages(spark, sf_dir), 4, 300).select("session_id", "pos", F.length("text").cast("bigint").alias("chars"))


@query(f"WITH {MESSAGES} SELECT message_type, count(*) AS n FROM (SELECT * FROM msg UNION ALL SELECT * FROM msg WHERE role = 'user') WHERE {ELIGIBLE} GROUP BY 1")
def st03_union(spark, sf_dir):
    m = views.plain_messages(spark, sf_dir)
    return history.eligible(m.unionByName(m.where("role = 'user'"))).groupBy("message_type").agg(F.count("*").alias("n"))


@query("SELECT conv_id AS session_id, turn AS pos FROM conversations JOIN (SELECT conv_id, count(*) FILTER (role = 'user') AS n FROM conversations GROUP BY 1) USING (conv_id) WHERE turn >= n")
def st04_suffix(spark, sf_dir):
    m = views.plain_messages(spark, sf_dir)
    have = m.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("n"))
    return history.unsynced(m, have).select("session_id", "pos")


@query(f"""WITH {MESSAGES}, last AS (SELECT session_id, max(pos) AS pos FROM msg GROUP BY 1),
  open AS (SELECT m.session_id, m.pos FROM msg m WHERE message_type = 'tool_call'
    AND NOT EXISTS (SELECT 1 FROM msg a WHERE a.session_id = m.session_id AND a.message_type = 'tool_result' AND a.pos = m.pos + 2))
  SELECT session_id, pos FROM msg WHERE (session_id, pos) NOT IN (SELECT (session_id, pos) FROM last INTERSECT SELECT (session_id, pos) FROM open)""")
def jn10_unanswered(spark, sf_dir):
    m = views.plain_messages(spark, sf_dir)
    calls = m.where("message_type = 'tool_call'").select("session_id", "pos", F.col("pos").alias("tool_call_id"))
    answers = m.where("message_type = 'tool_result'").select("session_id", (F.col("pos") - 2).alias("tool_call_id"))
    return history.unanswered(m, calls, answers).select("session_id", "pos")


@query(f"WITH {MESSAGES} SELECT session_id, min(pos) AS pos, arg_min(text, pos) AS text FROM msg WHERE message_type = 'final_answer' GROUP BY 1")
def jn15_first_of(spark, sf_dir):
    return history.first_of(views.plain_messages(spark, sf_dir), "final_answer")


@query(f"""WITH {MESSAGES}, last AS (SELECT session_id, max(pos) AS pos FROM msg WHERE message_type = 'plan_proposal' GROUP BY 1)
  SELECT m.session_id, m.pos, CASE WHEN l.pos IS NOT NULL AND m.session_id % 2 = 0 THEN 'true' ELSE coalesce(CAST(approved AS VARCHAR), 'open') END AS approved
  FROM msg m LEFT JOIN last l ON l.session_id = m.session_id AND l.pos = m.pos""")
def jn16_approve_latest(spark, sf_dir):
    m = views.plain_messages(spark, sf_dir)
    verdicts = m.where("session_id % 2 = 0").select("session_id").distinct().withColumns({"verdict": F.lit(True), "feedback": F.lit("ok")})
    return history.approve_latest(m, verdicts).select("session_id", "pos", F.coalesce(F.col("approved").cast("string"), F.lit("open")).alias("approved"))


@query(f"WITH {MESSAGES}, base AS (SELECT * FROM msg WHERE {ELIGIBLE} AND NOT {REJECTED}), {pruned('base')} SELECT session_id, pos FROM kept")
def pl01_guard_context(spark, sf_dir):
    return context.guard_context(views.plain_messages(spark, sf_dir), normal=200, keep_turns=2).select("session_id", "pos")


@query(f"""WITH {MESSAGES}, {AGENTS}, base AS (SELECT * FROM msg WHERE {ELIGIBLE} AND NOT {REJECTED}), {pruned('base')},
  catalog AS (SELECT string_agg('- ' || agent || ': ' || description, chr(10) ORDER BY pos) AS text FROM agents)
  SELECT session_id, pos, role, message_type, text FROM kept
  UNION ALL SELECT session_id, 1000000001, 'system', 'system_notification', (SELECT text FROM catalog) FROM kept GROUP BY session_id
  UNION ALL SELECT session_id, 1000000002, 'system', 'system_memory_topic', arg_max(text, pos) FROM msg WHERE role = 'user' AND session_id IN (SELECT session_id FROM kept) GROUP BY session_id""")
def pl02_planner_context(spark, sf_dir):
    m = views.plain_messages(spark, sf_dir)
    catalog = registry.catalog_text(views.agents(spark, sf_dir))
    memories = m.where("role = 'user'").groupBy("session_id").agg(F.max_by("text", "pos").alias("text"))
    return context.planner_context(m, catalog, memories, normal=200, keep_turns=2)


@query(f"""WITH {MESSAGES}, t AS (SELECT session_id, session_id || '-' || pos AS task_id, session_id || '-' || (pos - 2) AS dep, text AS description FROM msg WHERE role = 'assistant'),
  said AS (SELECT * FROM msg WHERE message_type IN ('user_input', 'final_answer') AND text <> ''),
  hit AS (SELECT t.task_id, s.pos, '[' || s.message_type || ']: ' || left(s.text, 500) AS line FROM t JOIN said s USING (session_id)
    WHERE len(list_filter(list_distinct(list_transform(regexp_extract_all(t.description, '[a-zA-Z0-9_]{{2,}}'), lambda x: lower(x))), lambda k: contains(lower(s.text), k))) >= 2),
  run AS (SELECT *, coalesce(sum(floor(length(line) / 4.0e0)) OVER (PARTITION BY task_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM hit),
  near AS (SELECT task_id, string_agg(line, chr(10) || '---' || chr(10) ORDER BY pos) AS related FROM run WHERE used < 1000 GROUP BY 1)
  SELECT t.session_id, t.task_id, '(未提供)' AS intent, 'answer the user' AS goal, t.description,
    CASE WHEN d.task_id IS NULL THEN '- [' || t.dep || ']: (任务不存在)' ELSE '### [' || t.dep || ']' || chr(10) || CASE WHEN d.description = '' THEN '(无结果)' ELSE left(d.description, 2000) END END AS inputs,
    coalesce(near.related, '(无特别相关上下文)') AS related
  FROM t LEFT JOIN t d ON d.task_id = t.dep LEFT JOIN near ON near.task_id = t.task_id""")
def pl03_executor_context(spark, sf_dir):
    m = views.messages(spark, sf_dir)
    tasks = m.where("role = 'assistant'").select("session_id", F.concat_ws("-", "session_id", "pos").alias("task_id"), F.col("text").alias("description"), F.array(F.concat_ws("-", F.col("session_id"), F.col("pos") - 2)).alias("dependencies"), F.lit("completed").alias("status"), F.col("text").alias("result"))
    return context.executor_context(m, tasks, "answer the user")


SUMMARIZED = """  totals AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id) AS held, turn_index >= greatest(1, max(turn_index) OVER (PARTITION BY session_id)) AS late FROM {src}),
  old AS (SELECT session_id, min(pos) AS pos, CAST(sum(length('[' || role || '] ' || left(text, 300))) + count(*) - 1 AS BIGINT) AS n FROM totals WHERE held > {limit} AND NOT late GROUP BY 1)
  SELECT session_id, pos, role, message_type, text FROM totals WHERE held <= {limit} OR late UNION ALL SELECT session_id, pos, 'system', 'system_notification', n || ' characters' FROM old"""


@query(f"WITH {MESSAGES}, {SUMMARIZED.format(src='msg', limit=100)}")
def ud11_summaries(spark, sf_dir):
    return history.summarize(views.messages(spark, sf_dir), lambda texts: [f"{len(t)} characters" for t in texts], 100, 1)


@query(f"WITH {MESSAGES}, base AS (SELECT * FROM msg WHERE {ELIGIBLE} AND NOT {REJECTED}), {pruned('base', 1, 600)}, {SUMMARIZED.format(src='(SELECT * EXCLUDE (total, recent, priority, before) FROM kept)', limit=300)}")
def pl04_compaction(spark, sf_dir):
    m = views.plain_messages(spark, sf_dir)
    stub = lambda texts: [f"{len(t)} characters" for t in texts]
    return context.guard_context(m, normal=600, aggressive=300, keep_turns=1, invoke=stub)


@query("SELECT conv_id AS session_id, turn AS pos, 'answer: ' || text AS answer FROM conversations")
def ud10_model_answers(spark, sf_dir):
    rows = views.plain_messages(spark, sf_dir).select("session_id", "pos", "text")
    return registry.with_model(rows, "text", lambda texts: [None if t is None else f"answer: {t}" for t in texts]).select("session_id", "pos", "answer")


@query("SELECT conv_id AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role, text FROM conversations")
def io09_documents(spark, sf_dir):
    docs = messages.encode_document(views.messages(spark, sf_dir))
    return messages.decode_document(docs).select(F.col("session_id").cast("bigint").alias("session_id"), "pos", "role", "text")

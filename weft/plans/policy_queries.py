"""Queries over policy patterns, tokens, predicates and scalar functions, carried by events and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import globs, markdown, prose_json, text
from weft.operators import hooks, memory, messages, policy, registry, running, sessions
from weft.schemas import BLOCK
from weft.sources import repositories

from . import views
from .registry import query
from .security_queries import TOOL_POLICIES
from .views import CALLS, ENTRIES, MESSAGES, QUERY, TASKS, TOPICS


def _events(spark, sf_dir):
    return views.table(spark, sf_dir, "events")


# Policies and tokens.


@query(f"WITH {CALLS} SELECT event_id, subject = 'u7' AS one, true AS every FROM calls")
def pf11_subject(spark, sf_dir):
    s = F.col("subject")
    return views.calls(spark, sf_dir).select("event_id", policy.matches_subject(s, "u7").alias("one"), policy.matches_subject(s, "*").alias("every"))


@query(f"WITH {CALLS} SELECT event_id, starts_with(action, 'c') AND ends_with(action, 'k') AS star, regexp_matches(action, '^[ps]') AS among, length(action) = 4 AND starts_with(action, 'v') AS marks, action[1] <> 'e' AS other FROM calls")
def pf12_action(spark, sf_dir):
    a = F.col("action")
    return views.calls(spark, sf_dir).select("event_id", *(globs.matches_name(a, g).alias(n) for n, g in (("star", "c*k"), ("among", "[ps]*"), ("marks", "v???"), ("other", "[!e]*"))))


@query(f"""WITH {CALLS} SELECT event_id, regexp_matches(touched, '^file:/v/1[^/]*/.*$') AS files, touched LIKE 'dir:/v/2/%' AS folder, touched LIKE 'cmd:ls %1' AS command, touched = '*' AS plain FROM calls""")
def pf13_resource(spark, sf_dir):
    c = views.calls(spark, sf_dir).select("event_id", policy.resource_of(F.col("tool_name"), F.col("args")).alias("r"))
    return c.select("event_id", *(policy.matches_resource(F.col("r"), p).alias(n) for n, p in (("files", "file:/v/1*/**"), ("folder", "dir:/v/2/"), ("command", "cmd:ls *1"))), (F.col("r") == "*").alias("plain"))


@query(f"""WITH {CALLS} SELECT event_id, regexp_matches(resource, '^file:/v/[^/]*/[^/]*$') AS one_level, regexp_matches(resource, '/[.]env$') AS deep, regexp_matches(resource, '^file:/v/[^/]/.*$') AS single FROM calls""")
def pf14_glob(spark, sf_dir):
    r = F.col("resource")
    return views.calls(spark, sf_dir).select("event_id", *(globs.matches_path(r, g).alias(n) for n, g in (("one_level", "file:/v/*/*"), ("deep", "**/.env"), ("single", "file:/v/?/**"))))


@query("SELECT p_partkey, regexp_matches(p_name, '^a[^/]*$') AS a, regexp_matches(p_brand, '^Brand#[^/][^/]$') AS b FROM part")
def sc20_glob_compile(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_name").rlike(globs.path_regex("a*")).alias("a"), F.col("p_brand").rlike(globs.path_regex("Brand#??")).alias("b"))


@query("SELECT event_id, event_id % 2 = 0 AND user_id % 10 = 1 AS covers, ts < TIMESTAMP '2024-01-15 00:00:00' OR event_id % 7 = 0 AS expired FROM events")
def pf15_token(spark, sf_dir):
    user = F.col("user_id").cast("string")
    e = _events(spark, sf_dir).select("event_id", F.concat(F.lit("file:/"), F.reverse(user), F.lit("/x")).alias("resource"), F.when(F.col("event_id") % 2 == 0, "read_file").otherwise("get_time").alias("tool_name"), F.lit("read_file").alias("token_tool"), F.lit("file:/1").alias("token_resource"), F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("expires_at"))
    return e.select("event_id", policy.token_covers().alias("covers"), policy.token_expired(F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("expired"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'plan' WHEN 1 THEN CASE WHEN event_id % 4 < 3 THEN 'plan' ELSE 'end' END WHEN 2 THEN 'guard' WHEN 3 THEN 'subagent' WHEN 4 THEN 'guard' ELSE 'end' END AS node FROM events""")
def pf17_router(spark, sf_dir):
    phases = F.array(*map(F.lit, ("intent_analysis", "plan_generation", "plan_review", "task_execution", "result_synthesis", "completed", "other")))
    return _events(spark, sf_dir).select("event_id", messages.next_node(F.element_at(phases, (F.col("event_id") % 7 + 1).cast("int")), F.col("event_id") % 4).alias("node"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AND NOT contains(p_name, ' ') AS valid FROM part")
def pf18_repository_url(spark, sf_dir):
    host = F.when(F.col("p_partkey") % 3 == 0, "https://github.com/o/").when(F.col("p_partkey") % 3 == 1, "http://github.com/o/").otherwise("https://github.com/o/x/")
    return views.table(spark, sf_dir, "part").select("p_partkey", F.concat(host, "p_name").rlike(repositories.URL).alias("valid"))


@query(f"WITH {CALLS} SELECT event_id, '/v/' || user_id || CASE WHEN event_id % 3 = 0 THEN '/..x' ELSE '' END || '/f' || event_id AS path, event_id % 3 <> 0 AS escapes FROM calls")
def pf20_path(spark, sf_dir):
    raw = F.col("args")["file_path"]
    c = views.calls(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 == 0, F.replace(raw, F.lit("/x/.."), F.lit("//..x"))).otherwise(raw).alias("p"))
    return c.select("event_id", policy.normal_path(F.col("p")).alias("path"), policy.escapes(F.col("p")).alias("escapes"))


@query("SELECT event_id, event_id % 3 < 2 AS allowed FROM events")
def io29_command(spark, sf_dir):
    k = F.col("event_id") % 3
    command = F.when(k == 0, F.concat(F.lit("ls "), F.col("event_id"))).when(k == 1, F.lit("  cat x | y")).otherwise(F.concat(F.lit("rm "), F.col("event_id")))
    return _events(spark, sf_dir).select("event_id", policy.allowed_command(command).alias("allowed"))


@query(f"""WITH {CALLS}, d AS (SELECT *, CASE WHEN regexp_matches(touched, '^cmd:ls .*1$') THEN 'deny'
    WHEN tool_name = 'read_file' AND starts_with(touched, 'file:/v/1/') THEN 'allow' WHEN tool_name = 'list_directory' AND starts_with(touched, 'dir:/v/2/') THEN 'allow'
    WHEN tool_name = 'get_time' THEN 'allow' ELSE 'need_escalation' END AS decision FROM calls)
  SELECT call_id, subject, touched AS resource, CASE WHEN decision = 'deny' THEN 'denied' WHEN decision = 'need_escalation' AND risk_level <> 'low' THEN 'escalated' WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
    decision = 'need_escalation' AND risk_level <> 'low' AS escalated FROM d""")
def ud07_builtin_hooks(spark, sf_dir):
    return hooks.run_calls(views.calls(spark, sf_dir), TOOL_POLICIES).select("call_id", "subject", "resource", "status", "escalated")


# Messages.


@query(f"WITH {MESSAGES} SELECT session_id, count(*) AS n, max(pos) AS last FROM msg WHERE message_type NOT IN ('guard_plan_review', 'plan_task_dispatch', 'tool_call', 'tool_result') GROUP BY 1")
def pf05_context_messages(spark, sf_dir):
    from weft.operators import history

    return history.eligible(views.plain_messages(spark, sf_dir)).groupBy("session_id").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' || event_id ELSE 'b' || event_id END AS id, event_type AS name, CASE WHEN event_id % 2 = 0 THEN props WHEN event_id % 3 = 0 THEN '{}' ELSE props END AS args FROM events")
def pf08_tool_calls(spark, sf_dir):
    id_ = F.col("event_id").cast("string")
    standard = F.when(F.col("event_id") % 2 == 0, F.array(F.struct(F.concat(F.lit("a"), id_).alias("id"), F.col("event_type").alias("name"), F.col("props").alias("args")))).otherwise(F.array().cast("array<struct<id:string,name:string,args:string>>"))
    inner = F.struct(F.col("event_type").alias("name"), F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("arguments"))
    nested = F.array(F.struct(F.concat(F.lit("b"), id_).alias("id"), inner.alias("function"), F.lit("unused").alias("name"), F.lit(None).cast("string").alias("args")))
    return _events(spark, sf_dir).select("event_id", F.explode(messages.tool_calls(standard, nested)).alias("c")).select("event_id", "c.*")


def _blocks(spark, sf_dir):
    """Conversations with their text in blocks: said, thought, a call."""
    m = views.plain_messages(spark, sf_dir)
    none = lambda t: F.lit(None).cast(t)
    use, result = BLOCK[BLOCK.index("tool_use:") + 9 : BLOCK.index(",tool_result:")], BLOCK[BLOCK.index("tool_result:") + 12 : -1]
    block = lambda kind, said, thought, call: F.struct(F.lit(kind).alias("block_type"), said.alias("text"), thought.alias("thinking"), call.cast(use).alias("tool_use"), none(result).alias("tool_result"))
    call = F.struct(F.col("pos").cast("string").alias("tool_id"), F.lit("look").alias("tool_name"), F.create_map(F.lit("q"), F.col("role")).alias("input_args"))
    blocks = F.array(block("text", F.col("text"), none("string"), none(use)), block("thinking", none("string"), F.col("role"), none(use)), block("tool_use", none("string"), none("string"), call), block("text", F.lit(""), none("string"), none(use)))
    return m.withColumn("blocks", blocks)


@query("SELECT conv_id AS session_id, turn AS pos, CASE WHEN text = '' THEN role ELSE text || '\n' || role END AS said, 'look' AS tool, CAST(turn AS VARCHAR) AS tool_id, 1 AS n FROM conversations")
def pf09_blocks(spark, sf_dir):
    uses = messages.tool_uses()
    return _blocks(spark, sf_dir).select("session_id", "pos", messages.block_text().alias("said"), uses[0]["tool_name"].alias("tool"), uses[0]["tool_id"].alias("tool_id"), F.size(uses).alias("n"))


@query("SELECT conv_id AS session_id, CAST(sum(floor(length(text) / 4.0e0) + floor(length(role) / 4.0e0)) AS BIGINT) AS tokens, count(*) AS n_messages FROM conversations GROUP BY 1")
def ag02_block_tokens(spark, sf_dir):
    from weft.operators import history

    return history.token_totals(_blocks(spark, sf_dir).withColumn("text", F.lit(None).cast("string")))


@query("SELECT conv_id AS session_id, left(arg_min(text, turn), 100) AS preview FROM conversations GROUP BY 1")
def pf26_preview(spark, sf_dir):
    return sessions.summaries(views.messages(spark, sf_dir)).select("session_id", "preview")


@query(f"WITH {MESSAGES} SELECT session_id, arg_min(text, pos) AS first, max(pos) AS last FROM msg WHERE message_type = 'user_input' GROUP BY 1")
def wn08_first_last(spark, sf_dir):
    from weft.operators import history

    m = views.plain_messages(spark, sf_dir)
    first = history.first_of(m, "user_input").select("session_id", F.col("text").alias("first"))
    return first.join(history.last_of(m, "user_input").select("session_id", F.col("pos").alias("last")), "session_id")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events")
def wn09_token_index(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_id")
    return running.running_sum(e, ["user_id"], {"b": running.step_of("event_id")}, ["event_id"], F.lit(1), "n").select("user_id", "event_id", F.col("n").cast("bigint").alias("n"))


@query("SELECT conv_id AS session_id, turn AS pos, role FROM conversations UNION ALL SELECT conv_id, turn + 100, 'tool' FROM conversations WHERE role = 'assistant'")
def st01_append(spark, sf_dir):
    from weft.operators import history

    m = views.plain_messages(spark, sf_dir).select("session_id", "pos", "role")
    more = m.where("role = 'assistant'").select("session_id", F.explode(F.array("pos", F.col("pos") + 100)).alias("pos"), F.lit("tool").alias("role"))
    return history.appended(m, more)


@query("""SELECT user_id, string_agg(n || '=' || v, ',' ORDER BY n) AS state FROM (
    SELECT user_id, event_type AS n, CAST(max(event_id) AS VARCHAR) AS v FROM events GROUP BY 1, 2 UNION ALL SELECT user_id, 'last', CAST(max(event_id) AS VARCHAR) FROM events GROUP BY 1) GROUP BY 1""")
def st02_map_merge(spark, sf_dir):
    id_ = F.col("event_id").cast("string")
    e = _events(spark, sf_dir).select("user_id", "event_id", F.create_map(F.col("event_type"), id_, F.lit("last"), id_).alias("value"))
    got = running.last_value_wins(e, "user_id", "event_id")
    return got.select("user_id", F.array_join(F.transform(F.map_entries("value"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("state"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'read,' || p_name ELSE 'read,' || p_name || ',' || p_brand END AS tools FROM part""")
def st07_tool_union(spark, sf_dir):
    declared, scripts = F.array(F.lit("read"), F.col("p_name")), F.when(F.col("p_partkey") % 3 != 0, F.array("p_brand", F.lit("read")))
    return views.table(spark, sf_dir, "part").select("p_partkey", F.array_join(registry.tool_union(declared, scripts), ",").alias("tools"))


@query(f"""WITH {TASKS} SELECT plan_id, count(*) AS registered, count(*) FILTER (status = 'failed') AS active, count(*) >= 50 AS "full" FROM tasks GROUP BY 1""")
def ag16_counts(spark, sf_dir):
    t = views.tasks(spark, sf_dir).withColumn("status", F.when(F.col("status") == "failed", "running").otherwise("idle"))
    return sessions.registered(t, by=["plan_id"]).select("plan_id", "registered", "active", "full")


# Scalar functions.

DATED = "CASE doc_id % 4 WHEN 0 THEN {missing} WHEN 1 THEN {missing} WHEN 2 THEN days + 0.5e0 ELSE days - 2 / 24.0e0 END"


def _dated(spark, sf_dir):
    """Dates that are no date, lack a zone, are in UTC, or in another zone."""
    k, day = F.col("pos") % 4, F.left("date", F.lit(10))
    stamp = F.when(k == 0, "soon").when(k == 1, day).when(k == 2, F.concat(F.date_sub(day.cast("date"), 1).cast("string"), F.lit("T12:00:00Z"))).otherwise(F.concat(day, F.lit("T04:00:00+02:00")))
    return views.entries(spark, sf_dir).select(F.col("pos").alias("doc_id"), stamp.alias("stamp"))


@query(f"WITH {ENTRIES}, e AS (SELECT pos AS doc_id, days FROM ent) SELECT doc_id, round({DATED.format(missing='365.0e0')}, 6) AS days FROM e")
def sc06_days_since(spark, sf_dir):
    return _dated(spark, sf_dir).select("doc_id", F.round(text.days_since("stamp", views.AS_OF), 6).alias("days"))


@query(f"WITH {ENTRIES}, e AS (SELECT pos AS doc_id, days FROM ent) SELECT doc_id, round({DATED.format(missing='999.0e0')}, 6) AS days FROM e")
def sc07_days_since_text(spark, sf_dir):
    return _dated(spark, sf_dir).select("doc_id", F.round(text.days_since("stamp", views.AS_OF, 999.0), 6).alias("days"))


@query("""SELECT p_partkey, round(len(list_intersect(list_distinct(string_split(p_name, '')), list_distinct(string_split(p_type, '')))) / CAST(len(list_distinct(string_split(p_name || p_type, ''))) AS DOUBLE), 6) AS similarity FROM part""")
def sc08_title_similarity(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", F.round(text.char_jaccard("p_name", "p_type"), 6).alias("similarity"))


@query("SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n FROM documents")
def sc09_well_formed(spark, sf_dir):
    """Texts as bytes with a lone surrogate and a stray byte put in."""
    raw = F.concat(F.encode(F.left("text", F.lit(3)), "utf-8"), F.unhex(F.lit("EDA080")), F.encode(F.substring("text", 4, 2**31 - 1), "utf-8"), F.unhex(F.lit("FF")))
    d = views.table(spark, sf_dir, "documents").select("doc_id", text.well_formed(raw).alias("text"))
    return d.select("doc_id", "text", F.length("text").cast("bigint").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN json_extract_string(props, '$.k') END AS k, event_id % 3 > 0 AS is_object FROM events")
def sc13_json_load(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("[1, 2]")).otherwise(F.col("props"))
    got = text.json_object(raw)
    return _events(spark, sf_dir).select("event_id", got["k"].alias("k"), got.isNotNull().alias("is_object"))


@query("SELECT n_nationkey, '{' || chr(10) || '  \"name\" : \"' || n_name || '\",' || chr(10) || '  \"字\" : ' || n_regionkey || chr(10) || '}' AS json FROM nation")
def sc14_json_dump(spark, sf_dir):
    return views.table(spark, sf_dir, "nation").select("n_nationkey", text.json_text(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("字"))).alias("json"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS now FROM events")
def sc15_utc_time(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", text.utc_iso(F.col("ts")).alias("now"))


@query("SELECT event_id, md5('e' || chr(1) || event_id) AS message_id, left(md5('s' || chr(1) || event_id), 12) AS short_id, strftime(ts, '%Y%m%d_%H%M%S') AS session_id FROM events")
def sc16_ids(spark, sf_dir):
    id_ = F.col("event_id").cast("string")
    return _events(spark, sf_dir).select("event_id", text.stable_id(F.lit("e"), id_).alias("message_id"), text.stable_id(F.lit("s"), id_, length=12).alias("short_id"), text.session_name("ts").alias("session_id"))


@query("SELECT p_partkey, CAST((p_partkey % 7 + 2 * (p_partkey % 3)) // 2 AS INTEGER) AS level FROM part")
def sc19_indent(spark, sf_dir):
    line = F.concat(F.repeat(F.lit(" "), (F.col("p_partkey") % 7).cast("int")), F.repeat(F.lit("\t"), (F.col("p_partkey") % 3).cast("int")), F.col("p_name"))
    return views.table(spark, sf_dir, "part").select("p_partkey", text.indent_level(line).alias("level"))


@query("SELECT p_partkey, 'Build ' || p_name || ' of ' || p_brand || ' {later} ' || p_name AS prompt FROM part")
def sc21_fill(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", text.fill("Build {name} of {brand} {later} {name}", name="p_name", brand="p_brand").alias("prompt"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '[ERROR] ' ELSE '' END || p_name || chr(10) || p_brand AS result FROM part")
def sc23_result_text(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", text.result_text(F.array(F.col("p_name"), F.lit(""), F.lit(None).cast("string"), F.col("p_brand")), F.col("p_partkey") % 2 == 0).alias("result"))


# Memory: keyword joins and counts.


@query(f"""WITH {TOPICS} SELECT slug, len(list_filter(['the', 'thing', 'and', 'nation', 'that'], lambda q: len(list_filter(keywords, lambda t: contains(t, q) OR contains(q, t))) > 0)) / 5.0e0 AS share,
    CAST(len(list_filter(['the', 'thing', 'and', 'nation', 'that'], lambda q: contains(lower(title), q))) AS INTEGER) AS n FROM top""")
def jn08_topic_keywords(spark, sf_dir):
    q = text.memory_keywords(F.lit(QUERY))
    return views.topics(spark, sf_dir).select("slug", text.keyword_match(q, F.col("keywords")).alias("share"), text.overlap(q, "title").alias("n"))


@query(f"WITH {ENTRIES}, {TOPICS} SELECT slug, count(*) AS n FROM ent JOIN top USING (slug) WHERE topic_pos % 3 <> 0 GROUP BY 1")
def jn09_topic_index(spark, sf_dir):
    t = views.topics(spark, sf_dir).where("topic_pos % 3 != 0").withColumn("keywords", F.array(F.lit("the")))
    e = views.entries(spark, sf_dir).withColumn("text", F.lit("the"))
    return memory.search(t, e, "the", views.AS_OF, 2**31 - 1).groupBy("slug").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CAST(len(list_filter(list_distinct(list_transform(regexp_extract_all('The nation and that thing', '[a-zA-Z0-9_]{2,}'), lambda x: lower(x))), lambda k: contains(lower(text), k))) AS INTEGER) AS n FROM documents""")
def ag09_overlap(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", text.overlap(text.task_keywords(F.lit("The nation and that thing")), "text").alias("n"))


@query(f"""WITH k AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-zA-Z]{{3,}}')) AS ks FROM documents)
  SELECT doc_id, round(len(list_filter(['the', 'the', 'thing', 'nation'], lambda q: len(list_filter(ks, lambda t: contains(t, q) OR contains(q, t))) > 0)) / 4.0e0, 6) AS share FROM k""")
def ag10_match_ratio(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.round(text.text_match("the the thing nation", "text"), 6).alias("share"))


@query("SELECT source AS slug, doc_id % 3 = 0 AS gone, count(*) AS n FROM documents GROUP BY 1, 2")
def io15_archive(spark, sf_dir):
    from weft.sources import stores

    e = views.entries(spark, sf_dir).select("slug", (F.col("pos") % 3).alias("pos"))
    stay, gone = stores.archive_entries(e, e.select("slug").distinct().withColumn("pos", F.lit(0)))
    both = stay.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)))
    return both.groupBy("slug", "gone").agg(F.count("*").alias("n"))


# Markdown.


@query("SELECT doc_id, source AS name, 'user' AS type, CAST(doc_id % 9 + 1 AS BIGINT) AS max_iterations, 'body of ' || lang AS body FROM documents")
def pa04_skills(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    doc = F.concat(F.lit("---\nname: "), "source", F.lit("\ntype: user\ndescription: d\nmax_iterations: "), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("\n---\n\nbody of "), "lang", F.lit("\n"))
    return markdown.skill_rows(d.select("doc_id", doc.alias("body")), "doc_id").select("doc_id", "name", "type", "max_iterations", "body")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source END AS slug, CASE WHEN doc_id % 2 = 0 THEN 'text of ' || lang ELSE 'plain ' || lang END AS body FROM documents")
def pa03_front_matter(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    doc = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\nslug: "), "source", F.lit("\nn: 3\n---\ntext of "), "lang")).otherwise(F.concat(F.lit("plain "), "lang"))
    return markdown.front_matter_rows(d.select("doc_id", doc.alias("body")), "doc_id").select("doc_id", F.col("meta")["slug"].alias("slug"), "body")


@query("SELECT doc_id, CAST(i AS INTEGER) AS line_no, CAST((i + 1) // 2 AS INTEGER) AS segment FROM (SELECT doc_id, unnest(range(0, 2 * (doc_id % 4) + 1)) AS i FROM documents)")
def wn10_segments(spark, sf_dir):
    part = F.concat(F.lit("\n## "), F.col("doc_id").cast("string"), F.lit("\nx ## "), "lang")
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("intro"), F.repeat(part, (F.col("doc_id") % 4).cast("int"))).alias("body"))
    rows = markdown.segment(markdown.numbered_lines(d, "doc_id"), F.col("line").startswith("## "))
    return rows.select("doc_id", "line_no", F.col("segment").cast("int").alias("segment"))


@query("SELECT doc_id, doc_id % 3 + doc_id % 4 + 1 AS slides, CAST(1 AS BIGINT) AS title, doc_id % 3 AS section, doc_id % 4 AS content FROM documents")
def ag07_slide_counts(spark, sf_dir):
    from weft.sources import deck

    d = views.table(spark, sf_dir, "documents")
    sections, pages = F.repeat(F.concat(F.lit("\n## "), "lang"), (F.col("doc_id") % 3).cast("int")), F.repeat(F.lit("\n### page\n- one"), (F.col("doc_id") % 4).cast("int"))
    body = F.concat(F.lit("# "), "source", F.lit("\n## sub"), sections, pages)
    return deck.slide_counts(markdown.slide_rows(d.select("doc_id", body.alias("body")), "doc_id"), "doc_id")


@query("SELECT doc_id, true AS made, doc_id % 5 + 1 AS slides FROM documents")
def io25_decks(spark, sf_dir):
    from weft.sources import deck

    d = views.table(spark, sf_dir, "documents")
    body = F.concat(F.lit("# "), "source", F.repeat(F.concat(F.lit("\n### page\n- "), F.coalesce("lang", F.lit(""))), (F.col("doc_id") % 5).cast("int")))
    made = deck.decks(markdown.slide_rows(d.select("doc_id", body.alias("body")), "doc_id"), "doc_id")
    inside = F.regexp_count(F.decode("deck", "iso-8859-1"), F.lit(r"ppt/slides/slide\d+\.xml"))  # named in the file and in its index
    return made.select("doc_id", ((F.col("size") > 0) & (F.decode(F.substring("deck", 1, 2), "iso-8859-1") == "PK")).alias("made"), (inside / 2).cast("bigint").alias("slides"))


@query("SELECT event_id, props AS found FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, '[]' FROM events WHERE event_id % 2 = 1")
def pa06_json_lists(spark, sf_dir):
    prose = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("So: "), "props", F.lit(" done"))).otherwise(F.lit("nothing here"))
    return _events(spark, sf_dir).select("event_id", prose_json.from_prose(prose, lists=True).alias("found"))

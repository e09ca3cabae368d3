"""The engine's entities as views over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.history import number_turns
from weft.schemas import BLOCK

AS_OF = "2024-05-01T00:00:00Z"
QUERY = "the thing and nation that"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kinds(role="role", turn="pos"):
    return (
        F.when(F.col(role) == "user", "user_input")
        .when(F.col(role) == "system", "system_prompt")
        .when(F.col(turn) % 5 == 0, "plan_proposal")
        .when(F.col(turn) % 5 == 1, "subagent_task_result")
        .when(F.col(turn) % 5 == 2, "tool_call")
        .when(F.col(turn) % 5 == 3, "tool_result")
        .otherwise("final_answer")
    )


def plain_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", "text")
    return rows.withColumns({"message_type": kinds(), "approved": F.when(F.col("pos") % 3 == 0, True).when(F.col("pos") % 3 == 1, False)})


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_turns(plain_messages(spark, sf_dir))


def full_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the columns that only structured messages fill."""
    empty = {"blocks": f"array<{BLOCK}>", "metadata": "map<string,string>", "name": "string"}
    rows = messages(spark, sf_dir).withColumns({k: F.lit(None).cast(v) for k, v in empty.items()})
    return rows.withColumn("message_id", F.concat_ws("-", "session_id", "pos"))


MESSAGES = """msg AS (
  SELECT conv_id AS session_id, turn AS pos, role, text,
    CASE WHEN role = 'user' THEN 'user_input' WHEN role = 'system' THEN 'system_prompt'
      WHEN turn % 5 = 0 THEN 'plan_proposal' WHEN turn % 5 = 1 THEN 'subagent_task_result'
      WHEN turn % 5 = 2 THEN 'tool_call' WHEN turn % 5 = 3 THEN 'tool_result' ELSE 'final_answer' END AS message_type,
    CASE turn % 3 WHEN 0 THEN true WHEN 1 THEN false END AS approved,
    CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_index,
    CAST(floor((length(text) - length(regexp_replace(text, '[一-鿿㐀-䶿豈-﫿]', '', 'g'))) / 1.5e0
      + length(regexp_replace(text, '[一-鿿㐀-䶿豈-﫿]', '', 'g')) / 4.0e0) AS BIGINT) AS tokens
  FROM conversations)"""
PRIORITY = """CASE WHEN message_type = 'user_input' THEN 0 WHEN message_type IN ('system_prompt', 'final_answer') THEN 1
  WHEN message_type = 'subagent_task_result' THEN 3 WHEN message_type IN ('tool_call', 'tool_result') THEN 4 ELSE 2 END"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic entries: a document each, its first line the title, dated within 120 days of January 2024."""
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 120).cast("int"))
    return d.select(F.col("source").alias("slug"), F.col("doc_id").alias("pos"), F.substring_index("text", "\n", 1).alias("title"), "text", F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("date"), "lang")


ENTRIES = """ent AS (
  SELECT source AS slug, doc_id AS pos, split_part(text, chr(10), 1) AS title, text, lang,
    strftime(DATE '2024-01-01' + CAST(doc_id % 120 AS INTEGER), '%Y-%m-%d') || 'T00:00:00Z' AS date,
    CAST(DATE '2024-05-01' - (DATE '2024-01-01' + CAST(doc_id % 120 AS INTEGER)) AS DOUBLE) AS days
  FROM documents)"""


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    t = d.groupBy("source").agg(F.array_sort(F.collect_set(F.concat(F.col("lang"), F.lit("thing")))).alias("keywords"), F.min("doc_id").alias("topic_pos"))
    return t.select(F.col("source").alias("slug"), "topic_pos", F.col("source").alias("title"), "keywords")


TOPICS = """top AS (
  SELECT source AS slug, min(doc_id) AS topic_pos, source AS title, list_sort(list(DISTINCT lang || 'thing')) AS keywords
  FROM documents GROUP BY source)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls: an event each."""
    e = table(spark, sf_dir, "events")
    tool = F.element_at(F.array(*map(F.lit, ("read_file", "list_directory", "run_command", "get_time"))), (F.col("event_id") % 4 + 1).cast("int"))
    user, id_ = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    path = F.concat(F.lit("/v/"), user, F.lit("/./x/../f"), id_)
    args = F.create_map(F.lit("file_path"), path, F.lit("dir_path"), path, F.lit("cmd"), F.concat(F.lit("ls "), id_), F.lit("api_key"), F.col("props"), F.lit("Author"), F.lit("y"), F.lit("q"), F.repeat(F.lit("ab"), (F.col("event_id") % 400).cast("int")))
    return e.select(
        "event_id",
        id_.alias("call_id"),
        user.alias("session_id"),
        F.concat(F.lit("u"), user).alias("subject"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("file:/v/"), user, F.lit("/"), id_, F.when(F.col("event_id") % 5 == 0, F.lit("/.env")).otherwise(F.lit(""))).alias("resource"),
        tool.alias("tool_name"),
        args.alias("args"),
        F.when(F.col("event_id") % 3 == 0, "high").otherwise("low").alias("risk_level"),
        F.col("props").alias("result"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        "ts",
    )


CALLS = """calls AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS call_id, CAST(user_id AS VARCHAR) AS session_id, 'u' || user_id AS subject, event_type AS action,
    'file:/v/' || user_id || '/' || event_id || CASE WHEN event_id % 5 = 0 THEN '/.env' ELSE '' END AS resource,
    CASE event_id % 4 WHEN 0 THEN 'read_file' WHEN 1 THEN 'list_directory' WHEN 2 THEN 'run_command' ELSE 'get_time' END AS tool_name,
    CASE event_id % 4 WHEN 0 THEN 'file:/v/' || user_id || '/f' || event_id WHEN 1 THEN 'dir:/v/' || user_id || '/f' || event_id
      WHEN 2 THEN 'cmd:ls ' || event_id ELSE '*' END AS touched,
    CASE WHEN event_id % 3 = 0 THEN 'high' ELSE 'low' END AS risk_level, props, event_type, user_id, ts
  FROM events)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each part; it depends on the part of half its key."""
    p = table(spark, sf_dir, "part")
    half = F.floor(F.col("p_partkey") / 2).cast("bigint")
    status = F.when(F.col("p_size") % 25 == 0, "failed").when(F.col("p_partkey") % 3 == 0, "pending").otherwise("completed")
    key = F.col("p_partkey").cast("string")
    return p.select(
        key.alias("task_id"),
        F.col("p_brand").alias("plan_id"),
        F.when(F.col("p_partkey") > 0, F.array(half.cast("string"))).otherwise(F.array().cast("array<string>")).alias("dependencies"),
        status.alias("status"),
        F.when(status == "completed", F.concat(F.lit("r"), key)).alias("result"),
        F.concat(F.lit("use {{"), half.cast("string"), F.lit("}} and {{ "), key, F.lit(".result }} and {{zz}}")).alias("description"),
    )


TASKS = """tasks AS (
  SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS task_id, p_brand AS plan_id, p_partkey // 2 AS half,
    CASE WHEN p_size % 25 = 0 THEN 'failed' WHEN p_partkey % 3 = 0 THEN 'pending' ELSE 'completed' END AS status,
    CASE WHEN p_size % 25 <> 0 AND p_partkey % 3 <> 0 THEN 'r' || p_partkey END AS result
  FROM part)"""


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An agent for each kind of part."""
    p = table(spark, sf_dir, "part").groupBy("p_type").agg(F.min("p_partkey").alias("pos"))
    return p.select("pos", F.lower("p_type").alias("agent"), F.concat(F.lit("Make_"), F.col("p_type")).alias("skill"), F.concat(F.lit("builds "), F.lower("p_type"), F.lit(" rings and bolts")).alias("description"))


AGENTS = """agents AS (
  SELECT min(p_partkey) AS pos, lower(p_type) AS agent, 'Make_' || p_type AS skill, 'builds ' || lower(p_type) || ' rings and bolts' AS description
  FROM part GROUP BY p_type)"""

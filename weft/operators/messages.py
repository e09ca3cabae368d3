"""Messages to and from chat roles, tool calls, envelopes and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.schemas import DOCUMENT, ENVELOPE

ROLES = ("user", "assistant", "system", "tool")
# Error codes and their HTTP status.
HTTP_STATUS = {
    "INVALID_REQUEST": 400, "SESSION_NOT_FOUND": 404, "SESSION_EXPIRED": 410, "SESSION_LIMIT": 429, "SESSION_BUSY": 409,
    "SESSION_NOT_PAUSED": 409, "CHECKPOINT_INVALID": 422, "RESUME_FAILED": 500, "EXECUTION_ERROR": 500, "COMPRESSION_ERROR": 500,
    "LLM_ERROR": 502, "TRANSPORT_ERROR": 500, "TIMEOUT": 504, "INTERNAL_ERROR": 500,
}
# Words by which a task asks for a tool, and by which it asks for words only.
OUTPUT_WORDS = ("文件", "写入", "生成", "保存", "创建", "执行", "命令", "运行", "pptx", "markdown", "json", "csv", "转换", "下载", "抓取", "file", "write", "generate", "create", "save", "run")
TEXT_ONLY = ("文本回复", "文字回答", "聊天对话", "介绍", "列出", "问候", "闲聊", "回答", "解释说明")
YES = ("yes", "是", "ok", "approve", "批准", "确认", "true", "1")


def block_text(blocks="blocks") -> Column:
    """Texts and thoughts of all blocks, a line each."""
    said = F.flatten(F.transform(blocks, lambda b: F.array(F.when(b["block_type"] == "text", b["text"]), F.when(b["block_type"] == "thinking", b["thinking"]))))
    return F.array_join(F.filter(said, lambda t: t.isNotNull() & (t != "")), "\n")


def tool_uses(blocks="blocks") -> Column:
    return F.transform(F.filter(blocks, lambda b: (b["block_type"] == "tool_use") & b["tool_use"].isNotNull()), lambda b: b["tool_use"])


def content() -> Column:
    return F.coalesce("text", block_text(), F.lit(""))


def to_chat(messages: DataFrame) -> DataFrame:
    """Chat form: role, content, tool_calls, tool_call_id and name; unknown roles speak as assistant."""
    result = F.get(F.filter("blocks", lambda b: (b["block_type"] == "tool_result") & b["tool_result"].isNotNull()), F.lit(0))["tool_result"]
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("assistant")
    tool = F.col("role") == "tool"
    return messages.select(
        "session_id",
        "pos",
        role.alias("chat_role"),
        F.when(tool & result.isNotNull(), result["output"]).otherwise(content()).alias("content"),
        F.when(F.col("role") == "assistant", tool_uses()).alias("tool_calls"),
        F.when(tool, F.coalesce(result["tool_id"], F.try_element_at("metadata", F.lit("tool_call_id")), F.lit(""))).alias("tool_call_id"),
        F.when(tool & result.isNotNull(), result["tool_name"]).when(F.col("role") != "system", F.nullif("name", F.lit(""))).alias("name"),
    )


def from_chat(rows: DataFrame) -> DataFrame:
    """Engine form of (chat_role, content, n_calls): role and message_type; unknown roles notify."""
    role = F.when(F.col("chat_role").isin(*ROLES), F.col("chat_role")).otherwise("system")
    kind = (
        F.when(F.col("chat_role") == "user", "user_input")
        .when((F.col("chat_role") == "assistant") & (F.col("n_calls") > 0), "tool_call")
        .when(F.col("chat_role") == "assistant", "agent_response")
        .when(F.col("chat_role") == "system", "system_prompt")
        .when(F.col("chat_role") == "tool", "tool_result")
        .otherwise("system_notification")
    )
    return rows.withColumns({"role": role, "message_type": kind})


def tool_calls(standard: Column, fallback: Column) -> Column:
    """Calls as id, name, args: the standard list, else the nested one (args as JSON text)."""
    nested = F.transform(fallback, lambda c: F.struct(F.coalesce(c["id"], F.lit("")).alias("id"), F.coalesce(c["function"]["name"], c["name"], F.lit("")).alias("name"), F.coalesce(c["function"]["arguments"], c["args"], F.lit("{}")).alias("args")))
    return F.when(F.size(standard) > 0, standard).otherwise(nested)


def is_valid() -> Column:
    """Known role, an id, a type, and something said."""
    said = F.when(F.col("text").isNotNull(), F.col("text") != "").otherwise(F.coalesce(F.size("blocks") > 0, F.lit(False)))
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return F.coalesce(F.col("role").isin(*ROLES), F.lit(False)) & filled("message_id") & filled("message_type") & said


def is_tool_call() -> Column:
    return F.coalesce((F.col("message_type") == "tool_call") & (F.size(tool_uses()) > 0), F.lit(False))


def is_tool_result() -> Column:
    return F.coalesce((F.col("role") == "tool") & (F.col("message_type") == "tool_result"), F.lit(False))


def needs_tool(description) -> Column:
    """Any output word and no word that asks for text only."""
    d = F.col(description) if isinstance(description, str) else description
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: d.contains(w))
    return has(OUTPUT_WORDS) & ~has(TEXT_ONLY)


def http_status(code) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    table = F.create_map(*(F.lit(x) for kv in HTTP_STATUS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, code), F.lit(500))


def user_reply(options: Column, selected: Column, approval: Column, reply: Column) -> Column:
    """What an answer to a question means: a choice, an approval, or its words."""
    chosen = F.get(options, selected)
    yes = F.lower(reply).isin(*YES)
    return (
        F.when(selected.isNotNull() & (selected >= 0) & (selected < F.size(options)), F.concat(F.lit("用户选择了: "), chosen))
        .when(approval, F.when(yes, F.lit("用户批准了该操作")).otherwise(F.lit("用户拒绝了该操作")))
        .otherwise(F.coalesce(F.nullif(reply, F.lit("")), F.lit("(用户未提供回答)")))
    )


def recovery_hint(phase: Column, has_plan: Column, total: Column, done: Column) -> Column:
    # The texts by which a session says how far it is.
    hint = (
        F.when(phase == "intent_analysis", "正在分析您的意图，尚未开始执行")
        .when(phase == "plan_generation", "正在制定任务计划")
        .when(phase == "plan_review", "任务计划已制定，等待审核")
        .when(phase == "task_execution", F.format_string("任务已执行 %d/%d 个子任务，恢复后将继续执行剩余子任务", done, total))
        .when(phase == "result_synthesis", "子任务已全部执行完毕，正在汇总结果")
        .when(phase == "completed", "任务已全部完成")
        .otherwise(F.concat(F.lit("编排阶段: "), phase))
    )
    return F.when(has_plan, hint).otherwise("任务尚未制定计划")


def next_node(phase: Column, rejections: Column, most: int = 3) -> Column:
    """Which step follows a phase: plans are written again at most ``most`` times."""
    return (
        F.when(phase == "intent_analysis", "plan")
        .when((phase == "plan_generation") & (rejections < most), "plan")
        .when(phase == "plan_generation", "end")
        .when(phase == "plan_review", "guard")
        .when(phase == "task_execution", "subagent")
        .when(phase == "result_synthesis", "guard")
        .otherwise("end")
    )


def usage(raw: Column) -> Column:
    """Token usage with the names that providers use: total, prompt, completion."""
    get = lambda *names: F.coalesce(*(F.try_element_at(raw, F.lit(n)).cast("long") for n in names), F.lit(0))
    prompt, completion = get("prompt_tokens", "input_tokens"), get("completion_tokens", "output_tokens")
    total = F.coalesce(F.try_element_at(raw, F.lit("total_tokens")).cast("long"), prompt + completion)
    return F.struct(total.alias("total"), prompt.alias("prompt"), completion.alias("completion"))


def encode_envelope(type_: Column, event: Column, payload: Column, id_: Column, stamp: Column, version: str = "1.0") -> Column:
    return F.to_json(F.struct(type_.alias("type"), event.alias("event"), payload.alias("payload"), id_.alias("id"), F.lit(version).alias("version"), stamp.alias("timestamp")))


def decode_envelope(line: Column) -> Column:
    """An envelope with its defaults: empty payload, version 1.0."""
    e = F.from_json(line, ENVELOPE)
    payload = F.coalesce(e["payload"], F.create_map().cast("map<string,string>"))
    return F.struct(e["type"].alias("type"), e["event"].alias("event"), payload.alias("payload"), F.coalesce(e["id"], F.lit("")).alias("id"), F.coalesce(e["version"], F.lit("1.0")).alias("version"), e["timestamp"].alias("timestamp"))


def encode_document(messages: DataFrame) -> DataFrame:
    """One JSON document a session (nulls left out), its messages in order."""
    one = F.struct("pos", F.struct("role", F.col("text").alias("content"), "message_type").alias("m"))
    got = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(one)).alias("ms"), F.max("turn_index").alias("turn_count"))
    return got.select("session_id", F.to_json(F.struct("session_id", F.lit("idle").alias("status"), "turn_count", F.transform("ms", lambda x: x["m"]).alias("messages"))).alias("document"))


def decode_document(documents: DataFrame, column: str = "document") -> DataFrame:
    """Messages of session documents, with defaults for what was left out."""
    d = documents.select(F.from_json(column, DOCUMENT).alias("d"))
    rows = d.select("d.session_id", F.coalesce("d.status", F.lit("idle")).alias("status"), F.posexplode("d.messages").alias("pos", "m"))
    return rows.select("session_id", "status", "pos", F.coalesce("m.role", F.lit("user")).alias("role"), F.coalesce("m.content", F.lit("")).alias("text"), "m.message_type")

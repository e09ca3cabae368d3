"""Context assembly: pipelines over history, catalog, memory and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import HAN, estimate_tokens, task_keywords
from weft.operators import graph, history
from weft.operators.running import running_sum, step_of
from weft.operators.stored import write
from weft.operators.substrings import containing

#: Runs of more characters are looked up by n-grams; parts are listed for so many runs at once.
RUN, BLOCK = 24, 256


def guard_context(messages: DataFrame, pending: DataFrame | None = None, normal: int = history.NORMAL, aggressive: int = history.AGGRESSIVE, keep_turns: int = 3, invoke=None) -> DataFrame:
    """What the reviewing agent sees: eligible, not rejected, compacted, summarized if still too long.

    Messages may come without turn numbers; then texts are read twice in all."""
    rows = messages.unionByName(pending, allowMissingColumns=True) if pending is not None else messages
    if "turn_index" in rows.columns:
        rows = history.prune(history.eligible(rows).where(~history.is_rejected()), normal, keep_turns)
    else:
        rows = history.compact(rows, normal, keep_turns, history.is_eligible() & ~history.is_rejected())
        rows = write(rows, "compacted") if invoke else rows  # the summaries read it again
    return history.summarize(rows, invoke, aggressive, keep_turns) if invoke else rows


def planner_context(messages: DataFrame, catalog: DataFrame, memories: DataFrame, **limits) -> DataFrame:
    """The reviewing agent's rows, with the intent, the agents' catalog and memories as further rows."""
    base = write(guard_context(messages, **limits).select("session_id", F.col("pos").cast("long").alias("pos"), "role", "message_type", "text"), "context")
    sessions = base.select("session_id").distinct()

    def also(df, pos, kind):
        return df.select("session_id", F.lit(pos).cast("long").alias("pos"), F.lit("system").alias("role"), F.lit(kind).alias("message_type"), "text")

    intent = history.first_of(messages, "guard_intent_analysis")
    one = sessions.withColumn("k", F.lit(1)).join(catalog.limit(1).select(F.lit(1).alias("k"), F.col("catalog").alias("text")), "k")
    remembered = memories.select("session_id", "text").join(sessions, "session_id", "left_semi")
    return base.unionByName(also(intent, 1_000_000_000, "guard_intent_analysis")).unionByName(also(one, 1_000_000_001, "system_notification")).unionByName(also(remembered, 1_000_000_002, "system_memory_topic"))


def _parts(run: Column) -> Column:
    """The substrings of two characters or more."""
    starts = lambda n: F.sequence(F.lit(1), F.length(run) - n + 1)
    return F.flatten(F.transform(F.sequence(F.lit(2), F.length(run)), lambda n: F.transform(starts(n), lambda i: F.substring(run, i, n))))


def relevant(messages: DataFrame, tasks: DataFrame, limit: int = 1000, snippet: int = 500, least: int = 2) -> DataFrame:
    """Messages that share ``least`` keywords with a task of their session, until ``limit`` tokens are used.

    ``tasks``: session_id, task_id, description. The message that uses the budget up still counts.
    A keyword is of one kind of characters, so a text holds it in one of its runs of that kind:
    all parts of a message's runs of up to ``RUN`` characters meet the session's keywords as equals,
    longer runs, of which parts would be many, by n-grams.
    """
    said = messages.where(F.col("message_type").isin("user_input", "final_answer") & (F.coalesce("text", F.lit("")) != ""))
    wanted = tasks.select("session_id", "task_id", F.explode(task_keywords("description")).alias("needle"))
    runs = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z0-9_]+|{HAN}+"), F.lit(0)))
    spoken = said.select("session_id", "pos", runs.alias("runs"))
    short = F.filter("runs", lambda r: F.length(r).between(2, RUN))
    cuts = F.sequence(F.lit(0), F.floor(F.size(short) / BLOCK).cast("int"))
    blocks = spoken.select("session_id", "pos", F.explode(F.transform(cuts, lambda k: F.slice(short, k * BLOCK + 1, F.lit(BLOCK)))).alias("runs"))
    parts = blocks.select("session_id", "pos", F.explode(F.array_distinct(F.flatten(F.transform("runs", _parts)))).alias("needle"))
    near = parts.join(wanted, ["session_id", "needle"]).select("session_id", "task_id", "pos", "needle")
    long = spoken.select("session_id", "pos", F.explode(F.filter("runs", lambda r: F.length(r) > RUN)).alias("text"))
    shared = containing(wanted.join(long.select("session_id").distinct(), "session_id", "left_semi"), long, ["session_id"])
    far = wanted.join(shared, ["session_id", "needle"]).join(long, ["session_id", "text"]).select("session_id", "task_id", "pos", "needle")
    met = near.unionByName(far).distinct()
    met = met.groupBy("session_id", "task_id", "pos").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    line = F.concat(F.lit("["), F.col("message_type"), F.lit("]: "), F.left("text", F.lit(snippet)))
    rows = met.join(said, ["session_id", "pos"]).withColumn("line", line).withColumn("cost", estimate_tokens("line"))
    rows = running_sum(rows, ["session_id", "task_id"], {"b": step_of("pos")}, ["pos"], F.col("cost"), "used")
    return rows.where(F.col("used") < limit)


def executor_context(messages: DataFrame, tasks: DataFrame, goal: str, limit: int = 1000) -> DataFrame:
    """What an executing agent sees for each task: intent, goal, task, inputs, related messages.

    ``tasks``: session_id, task_id, description, dependencies, status, result.
    """
    intent = history.first_of(messages, "guard_intent_analysis").select("session_id", F.left("text", F.lit(200)).alias("intent"))
    got = graph.dependency_inputs(tasks)
    part = F.when(F.col("state") == "completed", F.concat(F.lit("### ["), "dep", F.lit("]\n"), "preview")).when(F.col("state") == "missing", F.concat(F.lit("- ["), "dep", F.lit("]: (任务不存在)"))).otherwise(F.concat(F.lit("- ["), "dep", F.lit("]: (任务状态: "), "state", F.lit(")")))
    inputs = got.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dep_pos", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("inputs"))
    near = relevant(messages, tasks, limit).groupBy("session_id", "task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n---\n").alias("related"))
    rows = tasks.select("session_id", "task_id", "description").join(intent, "session_id", "left").join(inputs, "task_id", "left").join(near, ["session_id", "task_id"], "left")
    return rows.select(
        "session_id",
        "task_id",
        F.coalesce("intent", F.lit("(未提供)")).alias("intent"),
        F.lit(goal).alias("goal"),
        "description",
        F.coalesce("inputs", F.lit("(无依赖输入)")).alias("inputs"),
        F.coalesce("related", F.lit("(无特别相关上下文)")).alias("related"),
    )

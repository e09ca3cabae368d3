"""Conversation history: turns, filters, token totals, compaction.

Rows are messages: session_id, pos, role, text, message_type, and where known
turn_index, approved and blocks. All functions take and return DataFrames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import estimate_tokens

from .running import running_sum, step_of
from .stored import write

# Message types and how dispensable they are (4: most).
PRIORITY = {
    "user_input": 0, "user_interrupt": 0, "user_feedback": 0,
    "system_prompt": 1, "system_notification": 1, "guard_intent_analysis": 1, "guard_plan_review": 1, "final_answer": 1,
    "system_memory_profile": 1, "system_memory_topic": 1,
    "plan_proposal": 2, "plan_task_dispatch": 2, "plan_result_synthesis": 2, "agent_response": 2,
    "subagent_task_result": 3,
    "tool_call": 4, "tool_result": 4,
}
INTERNAL = ("guard_plan_review", "plan_task_dispatch", "tool_call", "tool_result")
PROPOSALS = ("plan_proposal", "plan_result_synthesis")
WINDOW_TOKENS = 65_536
NORMAL, AGGRESSIVE = int(WINDOW_TOKENS * 0.6), int(WINDOW_TOKENS * 0.8)


def priority(kind="message_type") -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    out = F.lit(2)
    for level in (0, 1, 3, 4):
        out = F.when(kind.isin([k for k, p in PRIORITY.items() if p == level]), F.lit(level)).otherwise(out)
    return out


def is_eligible(kind="message_type") -> Column:
    return ~F.coalesce(F.col(kind).isin(*INTERNAL), F.lit(False))


def eligible(messages: DataFrame) -> DataFrame:
    """Without the types that only serve orchestration."""
    return messages.where(is_eligible())


def is_rejected(kind="message_type", approved="approved") -> Column:
    """Proposals that were turned down; an unset approval is no rejection."""
    return F.coalesce(F.col(kind).isin(*PROPOSALS), F.lit(False)) & F.col(approved).eqNullSafe(F.lit(False))


def number_turns(messages: DataFrame) -> DataFrame:
    """Adds turn_index: user messages so far in the session."""
    one = (F.col("role") == "user").cast("int")
    return running_sum(messages, ["session_id"], {"b": step_of("pos")}, ["pos"], F.coalesce(one, F.lit(0)), "turn_index", inclusive=True)


def _last_turn(messages: DataFrame) -> DataFrame:
    turns = messages.groupBy("session_id").agg(F.max(F.coalesce("turn_index", F.lit(0))).alias("turn_count"))
    return messages.join(turns.withColumnRenamed("session_id", "__s"), F.col("session_id").eqNullSafe(F.col("__s"))).drop("__s")


def mark_recent(messages: DataFrame, n: int) -> DataFrame:
    """Adds recent: whether the message is of the session's last ``n`` turns."""
    marked = _last_turn(messages)
    return marked.withColumn("recent", F.coalesce("turn_index", F.lit(0)) >= F.greatest(F.lit(1), F.col("turn_count") - n + 1))


def last_turns(messages: DataFrame, n: int) -> DataFrame:
    """The messages of the last ``n`` turns; none for n < 1."""
    if n <= 0:
        return messages.where(F.lit(False))
    return mark_recent(messages, n).where("recent").drop("recent", "turn_count")


def with_tokens(messages: DataFrame) -> DataFrame:
    """Adds tokens: over text, or over the text and thinking of all blocks."""
    own = estimate_tokens("text")
    if "blocks" in messages.columns:
        both = F.aggregate("blocks", F.lit(0), lambda a, b: a + estimate_tokens(b["text"]) + estimate_tokens(b["thinking"]))
        own = F.when(F.col("text").isNull() & F.col("blocks").isNotNull(), both).otherwise(own)
    return messages.withColumn("tokens", own)


def token_totals(messages: DataFrame) -> DataFrame:
    return with_tokens(messages).groupBy("session_id").agg(F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("n_messages"))


def prune(messages: DataFrame, threshold: int = NORMAL, keep_turns: int = 3) -> DataFrame:
    """Compaction: old messages go, most dispensable first and oldest first, while the
    session holds more than ``threshold`` tokens. User messages and the last turns stay.

    A message goes exactly if what remains before its own removal is over the
    threshold, which is a running sum of the tokens that go before it.
    """
    rows = mark_recent(with_tokens(messages), keep_turns).withColumn("priority", priority())
    total = rows.groupBy("session_id").agg(F.sum("tokens").alias("total")).withColumnRenamed("session_id", "__s")
    rows = rows.join(total, F.col("session_id").eqNullSafe(F.col("__s"))).drop("__s")
    rows = rows.withColumn("open", ~F.col("recent") & (F.col("priority") > 0))
    rows = running_sum(rows, ["session_id"], {"p": -F.when(F.col("open"), F.col("priority")).otherwise(-1), "b": step_of("pos")}, ["pos"], F.when(F.col("open"), F.col("tokens")).otherwise(0), "gone")
    keep = ~(F.col("open") & (F.col("total") - F.col("gone") > threshold))
    return rows.where(keep).drop("open", "gone", "total", "recent", "turn_count")


def compact(messages: DataFrame, threshold: int = NORMAL, keep_turns: int = 3, among: Column | None = None) -> DataFrame:
    """``prune`` of messages whose turns are not numbered yet, of those ``among`` holds for;
    turns count all messages. Adds turn_index, tokens and priority.

    Texts are read twice, to be measured and to be kept. All between works on a table of
    numbers, a row a message: turns before a block of positions, tokens that go before a
    block of one priority, and windows over single blocks. A position is unique in its
    session; rows without a session form one.
    """
    same = lambda a, b, *keys: reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))
    block = step_of("pos")
    user = F.coalesce(F.col("role") == "user", F.lit(False)).cast("int")
    counts = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    size = write(with_tokens(messages).select("session_id", "pos", block.alias("b"), user.alias("user"), priority().alias("priority"), F.col("tokens").cast("long").alias("tokens"), counts.alias("counts")), "sizes")
    whole, ahead = Window.partitionBy("session_id"), Window.partitionBy("session_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    users = size.groupBy("session_id", "b").agg(F.sum("user").alias("n"))
    users = users.select("session_id", "b", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), F.sum("n").over(whole).alias("turns"))
    inner = Window.partitionBy("s.session_id", "s.b").orderBy("s.pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = size.alias("s").join(users.alias("u"), same("s", "u", "session_id", "b")).select("s.*", (F.col("ahead") + F.sum("s.user").over(inner)).alias("turn_index"), "turns").where("counts")
    open_ = (F.col("turn_index") < F.greatest(F.lit(1), F.col("turns") - keep_turns + 1)) & (F.col("priority") > 0)
    rows = rows.withColumn("rank", F.when(open_, -F.col("priority")).otherwise(1))
    rows = write(rows.select("session_id", "pos", "b", "rank", "priority", "tokens", "turn_index"), "ranked")
    open_ = F.col("rank") < 0
    goes = rows.groupBy("session_id", "rank", "b").agg(F.sum("tokens").alias("n"))
    ahead = whole.orderBy("rank", "b").rowsBetween(Window.unboundedPreceding, -1)
    goes = goes.select("session_id", "rank", "b", F.sum("n").over(whole).alias("total"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("gone"))
    inner = Window.partitionBy("s.session_id", "s.rank", "s.b").orderBy("s.pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.alias("s").join(goes.alias("g"), same("s", "g", "session_id", "rank", "b")).select("s.*", (F.col("total") - F.col("gone") - F.coalesce(F.sum("s.tokens").over(inner), F.lit(0))).alias("held"))
    kept = rows.where(~(open_ & (F.col("held") > threshold))).select("session_id", "pos", "turn_index", "tokens", "priority")
    return messages.alias("m").join(kept.alias("k"), same("m", "k", "session_id", "pos")).select("m.*", "turn_index", "tokens", "priority")


def turns_range(messages: DataFrame) -> DataFrame:
    """First and last numbered turn of each session as text."""
    turn = F.when(F.col("turn_index") > 0, F.col("turn_index"))
    got = messages.groupBy("session_id").agg(F.coalesce(F.min(turn), F.lit(1)).alias("a"), F.coalesce(F.max(turn), F.lit(1)).alias("b"))
    return got.select("session_id", F.concat_ws(" ~ ", F.col("a").cast("string"), F.col("b").cast("string")).alias("turns"))


def summarize(messages: DataFrame, invoke, threshold: int = AGGRESSIVE, keep_turns: int = 3, fallback: int = 500, line: int = 300) -> DataFrame:
    """Sessions over ``threshold`` tokens: old messages become one summary row.

    ``invoke(list of transcripts) -> list of summaries or None`` is injected; where
    it gives nothing, the first ``fallback`` characters of the transcript stand in.
    Lines are cut to ``line`` characters. A transcript is one row, so its size is
    bounded by what compaction leaves of a session.
    """
    sized = messages if "tokens" in messages.columns else with_tokens(messages)
    both = sized.groupBy("session_id").agg(F.sum("tokens").alias("total"), F.max(F.coalesce("turn_index", F.lit(0))).alias("turn_count")).withColumnRenamed("session_id", "__s")
    rows = sized.join(both, F.col("session_id").eqNullSafe(F.col("__s"))).drop("__s")
    rows = rows.withColumn("recent", F.coalesce("turn_index", F.lit(0)) >= F.greatest(F.lit(1), F.col("turn_count") - keep_turns + 1))
    due = (F.col("total") > threshold) & ~F.col("recent")
    said = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.left(F.coalesce("text", F.lit("")), F.lit(line)))
    old = rows.where(due).groupBy("session_id").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("s")))), lambda x: x["s"]), "\n").alias("transcript"))

    def run(batches):
        for part in batches:
            got = invoke(part["transcript"].tolist())
            part["text"] = [g if g else t[:fallback] for g, t in zip(got, part["transcript"], strict=True)]
            yield part[["session_id", "pos", "text"]]

    kinds = dict(messages.dtypes)
    made = old.mapInPandas(run, f"session_id {kinds['session_id']}, pos {kinds['pos']}, text string")
    made = made.withColumns({"role": F.lit("system"), "message_type": F.lit("system_notification")})
    kept = rows.where(~due).select("session_id", "pos", "role", "message_type", "text")
    return kept.unionByName(made)


def unanswered(messages: DataFrame, calls: DataFrame, answers: DataFrame) -> DataFrame:
    """Messages without each session's last one, where that has a tool call nobody answered.

    ``calls``: session_id, pos, tool_call_id; ``answers``: session_id, tool_call_id.
    """
    last = messages.groupBy("session_id").agg(F.max("pos").alias("pos"))
    open_ = calls.join(answers, ["session_id", "tool_call_id"], "left_anti").select("session_id", "pos").distinct()
    return messages.join(last.join(open_, ["session_id", "pos"]), ["session_id", "pos"], "left_anti")


def first_of(messages: DataFrame, kind: str) -> DataFrame:
    """Each session's first message of a type."""
    return messages.where(F.col("message_type") == kind).groupBy("session_id").agg(F.min_by("text", "pos").alias("text"), F.min("pos").alias("pos"))


def last_of(messages: DataFrame, kind: str) -> DataFrame:
    """Each session's last message of a type."""
    return messages.where(F.col("message_type") == kind).groupBy("session_id").agg(F.max_by("text", "pos").alias("text"), F.max("pos").alias("pos"))


def appended(channel: DataFrame, more: DataFrame) -> DataFrame:
    """A channel with further messages after its own; columns that one side lacks are null. What has a
    position already stays as it is, and its second version is left out."""
    known = channel.select(F.col("session_id").alias("__s"), F.col("pos").alias("__p"))
    new = more.join(known, F.col("session_id").eqNullSafe(F.col("__s")) & (F.col("pos") == F.col("__p")), "left_anti")
    return channel.unionByName(new, allowMissingColumns=True)


def unsynced(messages: DataFrame, counts: DataFrame) -> DataFrame:
    """The messages that another channel still lacks: all from the position on that it has got to.

    ``counts``: session_id, n (messages it has); a session that it does not know lacks all.
    """
    have = counts.select(F.col("session_id").alias("__s"), F.col("n").alias("__n"))
    rows = messages.join(have, F.col("session_id").eqNullSafe(F.col("__s")), "left")
    return rows.where(F.col("pos") >= F.coalesce("__n", F.lit(0))).drop("__s", "__n")


def approve_latest(messages: DataFrame, verdicts: DataFrame, kind: str = "plan_proposal") -> DataFrame:
    """Sets approved and feedback on each session's newest message of a type.

    ``verdicts``: session_id, verdict (boolean), feedback.
    """
    last = messages.where(F.col("message_type") == kind).groupBy("session_id").agg(F.max("pos").alias("pos"))
    hit = last.join(verdicts, "session_id").select("session_id", "pos", "verdict", "feedback")
    rows = messages.join(hit, ["session_id", "pos"], "left")
    return rows.withColumn("approved", F.coalesce("verdict", "approved")).drop("verdict")


def tail(messages: DataFrame, n: int = 40, chars: int = 2000) -> DataFrame:
    """Each session's last ``n`` messages, texts cut to ``chars``."""
    w = Window.partitionBy("session_id").orderBy(F.desc("pos"))
    return messages.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).withColumn("text", F.left("text", F.lit(chars))).drop("__n")


def budget(rows: DataFrame, keys: list[str], order: str, cost: Column, limit: int, overshoot: bool) -> DataFrame:
    """Rows in order until a budget is used up.

    With ``overshoot`` the row that uses it up still counts (the rows before it
    cost less than the limit); without, the running total stays within it.
    """
    got = running_sum(rows, keys, {"b": step_of(order)}, [order], cost, "__used", inclusive=not overshoot)
    return got.where(F.col("__used") < limit if overshoot else F.col("__used") <= limit).drop("__used")


def compression_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Messages and tokens of each session before and after compaction."""
    a = token_totals(before).select("session_id", F.col("n_messages").alias("messages_before"), F.col("tokens").alias("tokens_before"))
    b = token_totals(after).select("session_id", F.col("n_messages").alias("messages_after"), F.col("tokens").alias("tokens_after"))
    got = a.join(b, "session_id", "left").fillna(0, ["messages_after", "tokens_after"])
    return got.withColumn("did_compress", F.col("messages_after") < F.col("messages_before"))

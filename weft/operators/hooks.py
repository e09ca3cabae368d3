"""The hooks that every tool call passes, and calls run through them.

Before a call: a question to the user stops it (10), its audit record is begun (15),
policies decide (20), a tracer looks on (500). After it: the tracer (500), the audit
record is closed (590), a collector gathers the result (600).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .audit import records
from .policy import NONE, Policy, evaluate, resource_of
from .registry import ABORT, CONTROL, OBSERVE, Decision, Hook, Hooks

BEFORE, AFTER = "before_tool_call", "after_tool_call"


def builtin(policies: list[Policy], audit: list | None = None, trace: Callable[[str], None] | None = None, collect: list | None = None) -> Hooks:
    """Hooks over contexts: subject, tool_name, args, resource, risk, and after a call result or error.

    ``audit`` takes the finished records, ``collect`` the results; ``trace`` sees a line a step.
    """
    audit, collect = [] if audit is None else audit, [] if collect is None else collect
    hooks = Hooks()

    def ask(ctx):
        if ctx["tool_name"] == "ask_user":
            begin(ctx)
            close(ctx, "asked")
            return Decision(ABORT, "ask_user", (ctx.get("args") or {}).get("question", ""))

    def begin(ctx):
        ctx["record"] = {"subject": ctx.get("subject") or "unknown", "tool_name": ctx["tool_name"], "resource": ctx.get("resource") or "*", "status": "pending"}

    def check(ctx):
        token = ctx.get("token") or {}
        if token.get("tool_name") == ctx["tool_name"] and (ctx.get("resource") or "").startswith(token.get("resource", "")):
            if token.get("denied"):
                close(ctx, "denied", escalated=True)
                return Decision(ABORT, "denied by the user")
            if token.get("approved") and ctx.get("now", 0) <= token.get("expires_at", 0):
                ctx["record"]["escalated"] = True
                return None
        effect = evaluate(policies, ctx.get("subject") or "unknown", ctx["tool_name"], ctx.get("resource") or "*")
        if effect == "deny":
            close(ctx, "denied")
            return Decision(ABORT, f"denied: {ctx['tool_name']} on {ctx.get('resource')}")
        if effect == NONE and ctx.get("risk", "medium") != "low":
            close(ctx, "escalated", escalated=True)
            return Decision(ABORT, "needs the user's approval")

    def close(ctx, status, **more):
        record = ctx.pop("record", None)
        if record is not None:
            audit.append(record | {"status": status} | more)

    def finish(ctx):
        close(ctx, "error" if ctx.get("error") else "success", result=str(ctx.get("result") or "")[:200], error=ctx.get("error") or "")

    say = (lambda when: lambda ctx: trace(f"{when} {ctx['tool_name']}")) if trace else lambda when: lambda ctx: None
    for point, hook in (
        (BEFORE, Hook(10, "ask_user", CONTROL, ask)),
        (BEFORE, Hook(15, "audit_begin", OBSERVE, begin)),
        (BEFORE, Hook(20, "policies", CONTROL, check)),
        (BEFORE, Hook(500, "trace_before", OBSERVE, say("call"))),
        (AFTER, Hook(500, "trace_after", OBSERVE, say("done"))),
        (AFTER, Hook(590, "audit_end", OBSERVE, finish)),
        (AFTER, Hook(600, "collector", OBSERVE, lambda ctx: collect.append((ctx["tool_name"], ctx.get("result"))))),
    ):
        hooks.add(point, hook)
    return hooks


RECORDS = "call_id string, subject string, tool_name string, resource string, status string, escalated boolean"


def run_calls(calls: DataFrame, policies: list[Policy], execute: Callable[[str, dict], str | None] | None = None) -> DataFrame:
    """Audit records of calls (call_id, subject, tool_name, args, risk_level, result, error) that pass the hooks one by one.

    ``execute(tool_name, context)`` may run a tool; then the hooks live in the workers, a
    chain a batch. Without it the rows' own result and error stand, and what the chain
    decides is one projection.
    """
    if execute is None:
        known = calls.withColumns({"subject": F.coalesce(F.nullif("subject", F.lit("")), F.lit("unknown")), "error": F.nullif("error", F.lit(""))})
        asked = F.col("tool_name") == "ask_user"
        status = F.when(asked, "asked").otherwise(F.col("status"))
        got = records(known, policies)
        return got.select("call_id", "subject", "tool_name", "resource", status.alias("status"), (F.col("escalated") & ~F.coalesce(asked, F.lit(False))).alias("escalated"))
    rows = calls.select("call_id", "subject", "tool_name", resource_of(F.col("tool_name"), F.col("args")).alias("resource"), "risk_level", "result", "error")

    def run(batches):
        for part in batches:
            audit: list[dict] = []
            hooks = builtin(policies, audit)
            for r in part.to_dict("records"):
                ctx = {"subject": r["subject"], "tool_name": r["tool_name"], "resource": r["resource"], "risk": r["risk_level"]}
                if hooks.fire(BEFORE, ctx).action != ABORT:
                    ctx |= {"result": execute(r["tool_name"], ctx) if execute else r["result"], "error": None if pd.isna(r["error"]) else r["error"]}
                    hooks.fire(AFTER, ctx)
                audit[-1]["call_id"] = r["call_id"]
            yield pd.DataFrame([{"escalated": False, **{k: a.get(k) for k in ("call_id", "subject", "tool_name", "resource", "status")}, **({"escalated": True} if a.get("escalated") else {})} for a in audit], columns=["call_id", "subject", "tool_name", "resource", "status", "escalated"])

    return rows.mapInPandas(run, RECORDS)

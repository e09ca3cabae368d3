"""Ordered first-match access policies as one column expression.

Policies are a short ordered list, known before the query runs: they fold into a
single CASE whose branches keep the order, so a decision costs no join. Where
policies live in a table that changes, ``decide_join`` gives the same answers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.globs import matches_name, matches_path, name_regex, path_regex

NONE = "need_escalation"
FILE_TOOLS = ("read_file", "write_file", "append_file", "delete_file", "file_exists")
DIR_TOOLS = ("list_directory", "delete_directory")
COMMANDS = ("ls", "dir", "pwd", "echo", "cat", "type")


@dataclass(frozen=True)
class Policy:
    subject: str = "*"
    action: str = "*"
    resource: str = "*"
    effect: str = "deny"


def matches_subject(subject: Column, pattern: str) -> Column:
    return F.lit(True) if pattern == "*" else subject == pattern


def matches_resource(resource: Column, pattern: str) -> Column:
    """``file:`` path globs, ``dir:`` a folder and what is below, ``cmd:`` shell globs, else equality."""
    if pattern == "*":
        return F.lit(True)
    resource, pattern = F.replace(resource, F.lit("\\"), F.lit("/")), pattern.replace("\\", "/")
    kind, _, rest = pattern.partition(":")
    body = F.substring(resource, len(kind) + 2, 2**31 - 1)
    if kind == "file":
        return resource.startswith("file:") & matches_path(body, rest)
    if kind == "dir":
        base = rest.rstrip("/")
        return resource.startswith("dir:") & ((F.rtrim(body, F.lit("/")) == base) | body.startswith(base + "/"))
    if kind == "cmd":
        return resource.startswith("cmd:") & matches_name(body, rest)
    return resource == pattern


def decide(policies: list[Policy], subject="subject", action="action", resource="resource") -> Column:
    """The effect of the first policy that matches, or ``need_escalation``."""
    s, a, r = (F.col(c) if isinstance(c, str) else c for c in (subject, action, resource))
    out = None
    for p in policies:
        hit = F.coalesce(matches_subject(s, p.subject) & matches_name(a, p.action) & matches_resource(r, p.resource), F.lit(False))
        out = F.when(hit, p.effect) if out is None else out.when(hit, p.effect)
    return F.lit(NONE) if out is None else out.otherwise(NONE)


def compile_table(spark, policies: list[Policy]) -> DataFrame:
    """The policies with their patterns as regular expressions, in order."""
    rows = []
    for i, p in enumerate(policies):
        res = p.resource.replace("\\", "/")
        kind, _, rest = res.partition(":")
        regex = {"file": lambda r: "^file:" + path_regex(r)[1:], "dir": lambda r: "^dir:\\Q" + r.rstrip("/") + "\\E(/.*)?$", "cmd": lambda r: "^cmd:" + name_regex(r)[1:]}.get(kind)
        rows.append((i, p.subject, name_regex(p.action), "^.*$" if res == "*" else regex(rest) if regex else "^\\Q" + res + "\\E$", p.effect))
    return spark.createDataFrame(rows, "ord int, p_subject string, p_action string, p_resource string, effect string")


def literal_prefix(regex: Column) -> Column:
    """What every text that an anchored expression matches starts with, as far as its plain characters show."""
    head = F.regexp_extract(regex, r"^\^([A-Za-z0-9_:/ -]*)", 1)
    after = F.substring(regex, F.length(head) + 2, F.lit(1))
    head = F.when(after.isin("*", "?", "+", "{"), F.left(head, F.length(head) - 1)).otherwise(head)
    return F.when(F.contains(regex, F.lit("|")) | ~F.startswith(regex, F.lit("^")), "").otherwise(head)


def decide_join(calls: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The same decision with policies in a table, by an equi-join.

    A policy is indexed by its subject, its action, if that is one word, and the plain
    prefix of its resource. A call looks up both its subject and any, its action and any,
    and its resource's prefixes of the lengths that policies have; what it finds is
    verified. Calls that find nothing escalate. What a call leaves open (null) only a
    pattern for anything matches, as in ``decide``.
    """
    word = F.regexp_extract("p_action", r"^\^(?:\(\?s:)?([A-Za-z0-9_]+)\)?\$$", 1)
    known = table.withColumns({"__s": F.col("p_subject"), "__a": F.when(word == "", "*").otherwise(word), "__p": literal_prefix(F.col("p_resource"))})
    lengths = sorted(r[0] for r in known.select(F.length("__p")).distinct().collect())  # no more than the longest pattern has characters
    touched = F.replace("resource", F.lit("\\"), F.lit("/"))
    both = lambda c: F.explode(F.array_distinct(F.array(F.lit("*"), F.col(c))))
    rows = calls.select(key, "subject", "action", touched.alias("resource"))
    rows = rows.withColumn("__s", both("subject")).withColumn("__a", both("action"))
    rows = rows.withColumn("__n", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")))
    head = F.coalesce("resource", F.lit(""))
    rows = rows.where(F.length(head) >= F.col("__n")).withColumn("__p", F.left(head, F.col("__n")))
    fits = lambda c: F.coalesce(F.expr(f"{c} rlike p_{c}"), F.col(f"p_{c}").isin("^.*$", name_regex("*")))
    hits = rows.join(known, ["__s", "__a", "__p"]).where(fits("action") & fits("resource"))
    first = calls.select(key, F.lit(None).cast("int").alias("ord")).unionByName(hits.select(key, "ord")).groupBy(key).agg(F.min("ord").alias("__first"))
    effects = table.groupBy(F.col("ord").alias("__first")).agg(F.first("effect").alias("effect"))
    return first.join(effects, "__first", "left").select(key, F.coalesce("effect", F.lit(NONE)).alias("decision"))


def shadowed(policies: list[Policy]) -> list[tuple[int, int]]:
    """(later, earlier) pairs where an earlier policy takes all that the later would."""
    wide = lambda a, b: a == "*" or a == b
    return [(j, i) for j, b in enumerate(policies) for i, a in enumerate(policies[:j]) if wide(a.subject, b.subject) and wide(a.action, b.action) and wide(a.resource, b.resource) and a.effect != b.effect]


def normal_path(path: Column, cwd: str = "/") -> Column:
    """Absolute form of a path: no empty or ``.`` parts, ``..`` resolved in text."""
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(cwd.rstrip("/") + "/"), path))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def escapes(path: Column) -> Column:
    """Whether a raw path has a ``..`` part."""
    return F.exists(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p == "..")


def resource_of(tool: Column, args: Column, cwd: str = "/") -> Column:
    """What a call touches: file, folder or command, else ``*``.

    Tools name their arguments differently; both the general and the tool's own
    name are read.
    """
    get = lambda *names: F.coalesce(*(F.nullif(F.try_element_at(args, F.lit(n)), F.lit("")) for n in names))
    path = lambda c: F.coalesce(normal_path(c, cwd), F.lit(""))
    return (
        F.when(tool.isin(*FILE_TOOLS), F.concat(F.lit("file:"), path(get("file_path", "check_path"))))
        .when(tool.isin(*DIR_TOOLS), F.concat(F.lit("dir:"), path(get("dir_path"))))
        .when(tool == "run_command", F.concat(F.lit("cmd:"), F.trim(F.coalesce(get("command", "cmd"), F.lit("")))))
        .otherwise("*")
    )


def allowed_command(command: Column) -> Column:
    """Only the words on the list may run; nothing is run here."""
    return F.coalesce(F.get(F.split(F.trim(command), r"\s+"), F.lit(0)).isin(*COMMANDS), F.lit(False))


def granted(calls: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds granted: whether an approved, unexpired token of the session covers the call.

    ``calls``: call_id, session_id, tool_name, resource, ts; ``tokens`` as in the
    schema. An equi-join on session and tool carries the interval and the prefix
    as further conditions.
    """
    t = tokens.where(F.col("approved") & ~F.coalesce("denied", F.lit(False))).select(F.col("session_id").alias("__sid"), F.col("tool_name").alias("__tool"), F.col("resource").alias("__res"), "created_at", "expires_at")
    c = calls.select("event_id" if "call_id" not in calls.columns else "call_id", "session_id", "tool_name", "resource", "ts")
    key = c.columns[0]
    on = (F.col("session_id") == F.col("__sid")) & (F.col("tool_name") == F.col("__tool")) & (F.col("ts") >= F.col("created_at")) & (F.col("ts") <= F.col("expires_at")) & token_covers("tool_name", "resource", "__tool", "__res")
    hits = c.join(t, on).select(F.col(key).alias("__hit")).distinct()
    return calls.join(hits, F.col(key) == F.col("__hit"), "left").withColumn("granted", F.col("__hit").isNotNull()).drop("__hit")


def token_covers(tool="tool_name", resource="resource", token_tool="token_tool", token_resource="token_resource") -> Column:
    """Whether a token is for the tool and for a prefix of the resource."""
    return (F.col(tool) == F.col(token_tool)) & F.startswith(F.col(resource), F.col(token_resource))


def token_expired(as_of: Column, expires="expires_at") -> Column:
    """After its last moment; a token without one has expired."""
    return F.coalesce(as_of.cast("timestamp") > F.col(expires).cast("timestamp"), F.lit(True))


def evaluate(policies: list[Policy], subject: str, action: str, resource: str) -> str:
    """``decide`` for one call on the driver."""
    resource = resource.replace("\\", "/")
    for p in policies:
        kind, _, rest = p.resource.replace("\\", "/").partition(":")
        body = resource[len(kind) + 1 :] if resource.startswith(kind + ":") else None
        if p.resource == "*":
            fits = True
        elif kind == "file":
            fits = body is not None and re.search(path_regex(rest), body) is not None
        elif kind == "dir":
            fits = body is not None and (body.rstrip("/") == rest.rstrip("/") or body.startswith(rest.rstrip("/") + "/"))
        elif kind == "cmd":
            fits = body is not None and re.search(name_regex(rest), body) is not None
        else:
            fits = resource == p.resource.replace("\\", "/")
        if fits and p.subject in ("*", subject) and (p.action == "*" or re.search(name_regex(p.action), action)):
            return p.effect
    return NONE

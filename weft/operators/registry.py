"""Tools, hooks, skills and agents: registries on the driver, matching in Spark."""

from __future__ import annotations

import importlib
import inspect
import pkgutil
import signal
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from weft.functions.text import normalize_skill

from .stored import write
from .substrings import containing

RISKS = ("low", "medium", "high")
TYPES = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}
SQL_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}
#: Seconds that a tool of medium risk may take, and what it says when it takes longer.
LIMIT, OVERTIME = 30, "Error: 工具执行超时（{}s）"


@dataclass
class Tool:
    """``returns`` is a SQL type, with ``table`` the columns of the rows that the tool yields.
    ``sql`` is the tool as an expression over its parameters."""

    name: str
    description: str
    func: Callable
    risk: str = "low"
    returns: str = "string"
    parameters: list[dict[str, Any]] = field(default_factory=list)
    table: bool = False
    sql: str | None = None


def declare(risk: str = "low", returns: str = "string", table: bool = False, sql: str | None = None) -> Callable:
    """Mark a function as a tool, for ``Tools.discover``."""

    def mark(func):
        func.is_tool, func.risk, func.returns, func.table, func.sql = True, risk, returns, table, sql
        return func

    return mark


def limited(func: Callable, seconds: float, text: bool) -> Callable:
    """``func`` with a time limit, for Spark's Python workers, each of which runs one task in its main thread.

    What takes longer, or breaks, gives an error text, or null where the tool gives no text.
    """

    def late(*_):
        raise TimeoutError(OVERTIME.format(f"{seconds:g}"))

    def run(*args):
        before = signal.signal(signal.SIGALRM, late)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return func(*args)
        except TimeoutError as e:
            return str(e) if text else None
        except Exception as e:
            return f"Error: {e}" if text else None
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)

    return run


def table_function(func: Callable, returns: str):
    """A function that yields rows as a table function."""

    class Rows:
        def eval(self, *args):
            yield from func(*args)

    return F.udtf(Rows, returnType=returns)


def parameters_of(func: Callable) -> list[dict[str, Any]]:
    """Name, type and need of each parameter, from the signature."""
    out = []
    for p in inspect.signature(func).parameters.values():
        kind = p.annotation if isinstance(p.annotation, type) else {t.__name__: t for t in TYPES}.get(str(p.annotation), str)
        out.append({"name": p.name, "type": TYPES.get(kind, "string"), "description": "", "required": p.default is p.empty})
    return out


def schema_parameters(schema: dict) -> list[dict[str, Any]]:
    """Parameters from a JSON Schema; "null" leaves type unions."""
    out = []
    need = set(schema.get("required", []))
    for name, s in schema.get("properties", {}).items():
        kind = s.get("type", "string")
        kind = ", ".join(k for k in kind if k != "null") if isinstance(kind, list) else str(kind)
        out.append({"name": name, "type": kind, "description": s.get("description", "")} | ({"required": True} if name in need else {}))
    return out


class Tools:
    """Tools by name; the last registration wins."""

    def __init__(self):
        self._tools: dict[str, Tool] = {}

    def tool(self, name: str | None = None, description: str = "", risk: str = "low", returns: str = "string"):
        def register(func):
            self.add(Tool(name or func.__name__, description or (func.__doc__ or "").strip(), func, risk, returns, parameters_of(func)))
            return func

        return register

    def add(self, tool: Tool) -> None:
        self._tools[tool.name] = tool

    def add_external(self, server: str, name: str, schema: dict, func: Callable, description: str = "", risks: dict[str, str] | None = None) -> Tool:
        """A tool of another server: prefixed name, high risk unless told otherwise."""
        got = Tool(f"mcp__{server}__{name}", description or f"MCP: {name} ({server})", func, (risks or {}).get(name, "high"), "string", schema_parameters(schema))
        self.add(got)
        return got

    def remove(self, name: str) -> None:
        self._tools.pop(name, None)

    def get(self, name: str) -> Tool:
        return self._tools[name]

    def names(self) -> list[str]:
        return list(self._tools)

    def discover(self, module) -> int:
        """Register every public function of a module, or of all public modules of a package, that is marked as a tool."""
        module = importlib.import_module(module) if isinstance(module, str) else module
        parts = [importlib.import_module(f"{module.__name__}.{m.name}") for m in pkgutil.iter_modules(getattr(module, "__path__", [])) if not m.name.startswith("_")]
        found = [f for m in [module, *parts] for _, f in inspect.getmembers(m, inspect.isfunction) if getattr(f, "is_tool", False)]
        for f in found:
            self.add(Tool(f.__name__, (f.__doc__ or "").strip(), f, getattr(f, "risk", "low"), getattr(f, "returns", "string"), parameters_of(f), getattr(f, "table", False), getattr(f, "sql", None)))
        return len(found)

    def as_functions(self, spark: SparkSession, limit: float = LIMIT) -> list[str]:
        """Register the tools as SQL functions, each on the way that its risk asks for.

        Low: a tool with an expression becomes a SQL function, which Catalyst puts into the
        plan; one without runs over Arrow batches. Medium: Arrow batches in a Python worker,
        ``limit`` seconds a call. High: not registered, and what had its name goes, so that
        a query with it fails when it is analysed. Tools that yield rows become table functions.
        """
        done = []
        for t in self._tools.values():
            spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS `{t.name}`")
            if t.risk == "high":
                continue
            if t.table:
                spark.udtf.register(t.name, table_function(t.func, t.returns))
            elif t.risk == "low" and t.sql:
                names = ", ".join(f"`{p['name']}` {SQL_TYPES[p['type']]}" for p in t.parameters)
                spark.sql(f"CREATE TEMPORARY FUNCTION `{t.name}`({names}) RETURNS {t.returns} RETURN {t.sql}")
            else:
                func = limited(t.func, limit, t.returns == "string") if t.risk == "medium" else t.func
                spark.udf.register(t.name, F.udf(func, t.returns, useArrow=True))
            done.append(t.name)
        return done

    def results(self, calls: list[dict]) -> list[dict]:
        """What called tools say; unknown tools and errors become result rows."""
        out = []
        for c in calls:
            try:
                said = str(self.get(c["name"]).func(**c.get("args", {})))
            except KeyError:
                said = f"[ERROR] unknown tool: {c['name']}"
            except Exception as e:
                said = f"[ERROR] {e}"
            out.append({"role": "tool", "name": c["name"], "content": said})
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t.name, t.description, t.risk) for t in self._tools.values()], "name string, description string, risk string")


def sample_tools() -> Tools:
    """Three small tools to try a registry with."""
    tools = Tools()
    tools.add(Tool("echo", "gives back its message", lambda message: f"[test-server echo]: {message}", parameters=[{"name": "message", "type": "string", "description": "", "required": True}]))
    tools.add(Tool("add", "adds two numbers", lambda a, b: f"{a} + {b} = {a + b}", parameters=[{"name": n, "type": "number", "description": "", "required": True} for n in "ab"]))
    tools.add(Tool("get_time", "the moment in UTC", lambda now=None: (now or datetime.now(UTC)).isoformat()))
    return tools


def tool_union(declared, scripts):
    """Tools of a skill: the declared ones, then the names of its scripts, each once."""
    return F.array_union(F.coalesce(declared, F.array().cast("array<string>")), F.coalesce(scripts, F.array().cast("array<string>")))


def agent_configs(skills: DataFrame) -> DataFrame:
    """A configuration of each skill's agent: name, description, skills, tools, max_iterations and source.

    ``skills``: name, type, description, tools (structs with a name), scripts (names;
    they count for the user's own skills only), max_iterations.
    """
    own = F.when(F.col("type") == "user", F.col("scripts"))
    tools = tool_union(F.transform("tools", lambda t: t["name"]), own)
    return skills.select("name", "description", F.array("name").alias("skills"), tools.alias("tools"), F.coalesce("max_iterations", F.lit(5)).alias("max_iterations"), F.concat(F.lit("skill:"), "type").alias("source"))


CONTINUE, SKIP, ABORT = "continue", "skip", "abort"
MODIFY, CONTROL, OBSERVE = "modify", "control", "observe"


@dataclass
class Decision:
    action: str = CONTINUE
    reason: str = ""
    fallback: Any = None


class Refused(Exception):
    """A controlling hook has stopped the run."""


@dataclass(order=True)
class Hook:
    priority: int
    name: str = field(compare=False)
    kind: str = field(compare=False)
    run: Callable = field(compare=False)
    enabled: bool = field(compare=False, default=True)


class Hooks:
    """Hooks by checkpoint, run in ascending priority, equal ones in the order of registration."""

    def __init__(self):
        self._hooks: dict[str, list[Hook]] = {}

    def add(self, point: str, hook: Hook) -> None:
        self._hooks[point] = sorted([*self._hooks.get(point, []), hook], key=lambda h: h.priority)

    def remove(self, name: str) -> None:
        for point, hooks in self._hooks.items():
            self._hooks[point] = [h for h in hooks if h.name != name]

    def at(self, point: str) -> list[Hook]:
        return [h for h in self._hooks.get(point, []) if h.enabled]

    def fire(self, point: str, context: dict) -> Decision:
        """Run a point's hooks on a context. SKIP and ABORT end the chain; a controlling
        hook that breaks aborts, any other is only noted in context["warnings"]."""
        for h in self.at(point):
            try:
                got = h.run(context)
            except Exception as e:
                if h.kind == CONTROL:
                    return Decision(ABORT, f"{h.name}: {e}")
                context.setdefault("warnings", []).append(f"{h.name}: {e}")
                continue
            if h.kind == MODIFY and isinstance(got, dict):
                context.update(got)
            elif h.kind == CONTROL and got is not None and got.action != CONTINUE:
                return got
        return Decision()

    def transform(self, point: str, df: DataFrame) -> DataFrame:
        """The same over a DataFrame: MODIFY maps it, OBSERVE adds named metrics to it,
        CONTROL looks at its schema and may refuse."""
        for h in self.at(point):
            if h.kind == MODIFY:
                df = h.run(df)
            elif h.kind == OBSERVE:
                df = df.observe(h.name, *h.run(df))
            else:
                got = h.run(df)
                if got is not None and got.action == ABORT:
                    raise Refused(got.reason)
        return df


def hook_order(hooks: DataFrame) -> DataFrame:
    """Enabled hooks (point, name, priority, seq, enabled) with n, their place at their point: by priority, equal ones as registered."""
    order = Window.partitionBy("point").orderBy("priority", "seq")
    return hooks.where("enabled").withColumn("n", F.row_number().over(order))


def standing(steps: DataFrame) -> DataFrame:
    """What a log of registrations leaves: (point, name, seq) of the newest registration at each point.

    ``steps``: seq, op ("add" or "remove"), point, name; a removal takes the name from all points.
    """
    gone = steps.where("op = 'remove'").groupBy("name").agg(F.max("seq").alias("gone"))
    held = steps.where("op = 'add'").groupBy("point", "name").agg(F.max("seq").alias("seq"))
    return held.join(gone, "name", "left").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone"))).select("point", "name", "seq")


def route(risk: str | Column) -> Column:
    """How a tool of a risk runs inside a plan."""
    risk = F.col(risk) if isinstance(risk, str) else risk
    return F.when(risk == "low", "expression").when(risk == "medium", "worker").when(risk == "high", "refused").otherwise("expression")


def run_loops(rows: DataFrame, column: str, invoke: Callable[[list[list[dict]]], list[dict]], tools: Tools, most: int = 10) -> DataFrame:
    """``tool_loop`` for every row: adds answer, the last message's text, and n, the number of messages.

    ``invoke(list of conversations) -> list of answers`` is injected; the open conversations
    of a batch of rows are asked together, round by round.
    """
    schema = StructType([*rows.schema.fields, StructField("answer", StringType()), StructField("n", LongType())])

    def run(batches):
        for part in batches:
            talks = [[{"role": "user", "content": t}] for t in part[column]]
            open_ = list(range(len(talks)))
            for _ in range(most):
                if not open_:
                    break
                answers = invoke([talks[i] for i in open_])
                for i, answer in zip(open_, answers, strict=True):
                    talks[i] += [{"role": "assistant", **answer}, *tools.results(answer.get("tool_calls") or [])]
                open_ = [i for i in open_ if talks[i][-1]["role"] == "tool"]
            part["answer"], part["n"] = [t[-1]["content"] for t in talks], [len(t) for t in talks]
            yield part

    return rows.mapInPandas(run, schema)


def match_skill(queries: DataFrame, agents: DataFrame) -> DataFrame:
    """Agents for each asked skill, by the first level that has any.

    ``queries``: query; ``agents``: pos, agent, skill, description. 1: equal names
    (the first agent only); 2: one name inside the other, from three characters on;
    3: the description holds the query or a part of it. Each level only sees what
    the one before left; all are equi-joins, on the name or on indexed n-grams.
    """
    q = write(queries.select("query").distinct().withColumn("q", normalize_skill("query")).where("q != ''"), "asked")
    a = agents.withColumn("s", normalize_skill("skill")).withColumn("d", F.lower("description"))
    found = lambda pairs, level: pairs.select("query", "agent", "pos", F.lit(level).alias("level")).distinct()
    one = found(q.join(a, F.col("q") == F.col("s")), 1)
    rest = write(q.join(one, "query", "left_anti"), "asked")
    names, skills = rest.where(F.length("q") >= 3).select("q"), a.select("s")
    inside = containing(names.select(F.col("q").alias("needle")), skills.select(F.col("s").alias("text"))).toDF("q", "s")
    around = containing(skills.select(F.col("s").alias("needle")), names.select(F.col("q").alias("text"))).toDF("s", "q")
    two = found(inside.unionByName(around).join(rest, "q").join(a, "s"), 2)
    rest = write(rest.join(two, "query", "left_anti"), "asked")
    parts = F.array_union(F.array("q"), F.filter(F.split("q", "-"), lambda w: F.length(w) >= 2))
    parts = rest.select("query", F.explode(parts).alias("needle"))
    told = containing(parts, a.select(F.col("d").alias("text"))).withColumnRenamed("text", "d")
    three = found(told.join(parts, "needle").join(a, "d"), 3)
    w = Window.partitionBy("query").orderBy("pos", "agent")
    best = one.unionByName(two).unionByName(three).withColumn("n", F.row_number().over(w)).where("level > 1 or n = 1")
    return best.select("query", "agent", "level").distinct()


def assign(queries: DataFrame, agents: DataFrame) -> DataFrame:
    """One agent for each asked skill: the best match, else general-purpose, else general,
    else the first agent (null where there is none)."""
    hit = match_skill(queries, agents).join(agents.select("agent", "pos").distinct(), "agent")
    first = hit.groupBy("query").agg(F.min_by("agent", "pos").alias("matched"))
    names = agents.agg(
        F.min_by("agent", "pos").alias("any"),
        F.max(F.when(normalize_skill("agent") == "general-purpose", F.col("agent"))).alias("gp"),
        F.max(F.when(normalize_skill("agent") == "general", F.col("agent"))).alias("g"),
    ).first()
    rest = [F.lit(names[k]) for k in ("gp", "g", "any") if names[k] is not None]
    return queries.select("query").distinct().join(first, "query", "left").select("query", F.coalesce("matched", *rest, F.lit(None).cast("string")).alias("agent"))


def find_skills(skills: DataFrame, query: str) -> DataFrame:
    """The skill of that name, else all whose description or summary holds the query."""
    q = query.lower()
    rank = F.when(F.lower("name") == q, 1).when(F.lower("description").contains(q) | F.lower("summary").contains(q), 2)
    rows = skills.withColumn("__rank", rank).where("__rank is not null")
    best = rows.agg(F.min("__rank").alias("__best"))
    got = rows.join(F.broadcast(best), F.col("__rank") == F.col("__best"))
    return got.drop("__rank", "__best")


def override(builtin: DataFrame, user: DataFrame) -> DataFrame:
    """Both lists by name; a user's row replaces the built-in one at its place.

    Both: name, pos and further columns.
    """
    both = builtin.withColumn("__p", F.lit(0)).unionByName(user.withColumn("__p", F.lit(1)))
    rest = [c for c in builtin.columns if c not in ("name", "pos")]
    got = both.groupBy("name").agg(F.max_by(F.struct(*rest), F.struct("__p", "pos")).alias("x"), F.min(F.struct("__p", "pos")).alias("at"))
    return got.select("name", F.col("at.__p").alias("user_only"), F.col("at.pos").alias("pos"), "x.*")


def available(wanted: DataFrame, registered: DataFrame) -> DataFrame:
    """The tools that a skill names and that exist."""
    return wanted.join(registered.select("name"), "name", "left_semi")


def catalog_text(agents: DataFrame) -> DataFrame:
    """The agents' catalog as one text, a line each."""
    line = F.concat(F.lit("- "), F.col("agent"), F.lit(": "), F.col("description"))
    return agents.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("catalog"))


def skill_prompt(skills: DataFrame) -> DataFrame:
    """The system prompt of each skill: name, description, tools and body."""
    tools = F.array_join(F.transform("tools", lambda t: F.concat(F.lit("- "), t["name"], F.lit(": "), t["description"])), "\n")
    return skills.select("name", F.concat(F.lit("# "), F.col("name"), F.lit("\n\n"), F.col("description"), F.lit("\n\n## Tools\n"), tools, F.lit("\n\n"), F.col("body")).alias("prompt"))


def tool_loop(invoke: Callable[[list[dict]], dict], tools: Tools, messages: list[dict], most: int = 10) -> list[dict]:
    """Ask, run the tools that the answer calls, and ask again, ``most`` times at most.

    ``invoke`` is injected; unknown tools and errors become result rows.
    """
    messages = list(messages)
    for _ in range(most):
        answer = invoke(messages)
        messages.append({"role": "assistant", **answer})
        calls = answer.get("tool_calls") or []
        if not calls:
            break
        messages += tools.results(calls)
    return messages


def with_model(df: DataFrame, column: str, invoke: Callable[[list[str]], list[str]], name: str = "answer") -> DataFrame:
    """Adds the answers of an injected model, a batch of rows a call."""
    schema = StructType([*df.schema.fields, StructField(name, StringType())])

    def run(batches):
        for part in batches:
            part[name] = invoke(part[column].tolist())
            yield part

    return df.mapInPandas(run, schema)

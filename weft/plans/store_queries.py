"""Queries that write to the shared folder and read again: files, stores, tools, streams."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from weft.functions import html
from weft.operators import audit, memory, policy, registry
from weft.operators.stored import folder
from weft.sources import files, repositories, stores, tools
from weft.streaming import events as streams

from . import views
from .registry import query
from .security_queries import DECIDED, POLICIES, TOOL_POLICIES
from .views import CALLS


def _nations(spark, sf_dir):
    """Every nation's name in a file of its own; the folder."""
    path = folder(spark, "nations")
    for r in views.table(spark, sf_dir, "nation").collect():  # 25 rows at every scale
        files.write_file(spark, f"{path}/{r['n_nationkey']}.txt", r["n_name"])
    return path


# Files.


@query("SELECT n_nationkey || '.txt' AS name, n_name AS content, CAST(NULL AS VARCHAR) AS error FROM nation")
def io01_read_files(spark, sf_dir):
    got = files.read_files(spark, _nations(spark, sf_dir))
    return got.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", "error")


@query("SELECT CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority AS line FROM orders")
def io02_write_rows(spark, sf_dir):
    path = folder(spark, "lines")
    files.write_rows(views.table(spark, sf_dir, "orders").select(F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("text")), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT CAST(o_orderkey AS VARCHAR) || ' ' || o_orderstatus AS line FROM orders")
def io03_append(spark, sf_dir):
    """Lines of one status appended after those of another."""
    path, o = folder(spark, "append"), views.table(spark, sf_dir, "orders")
    for status in ("o_orderstatus = 'F'", "o_orderstatus = 'O'", "o_orderstatus not in ('F', 'O')"):
        files.write_rows(o.where(status).select(F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("text")), path, mode="append")
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT n_nationkey || '.txt' AS name, false AS is_dir, CAST(length(n_name) AS BIGINT) AS size FROM nation")
def io04_list(spark, sf_dir):
    return files.list_directory(spark, _nations(spark, sf_dir)).where("name not like '.%'").select("name", "is_dir", "size")


def _part_folders(spark, sf_dir, where="true"):
    """Names of parts as lines in folders k=.../n=...; the folder."""
    path = folder(spark, "parts")
    p = views.table(spark, sf_dir, "part").where(where).select(F.col("p_name").alias("value"), (F.col("p_partkey") % 5).alias("k"), (F.col("p_size") % 10).alias("n"))
    p.repartition("k", "n").write.partitionBy("k", "n").text(path)
    return path


@query("SELECT 'k=' || p_partkey % 5 AS folder, '[DIR]  n=' || p_size % 10 || ' (' || sum(strlen(p_name) + 1) || ' bytes)' AS line, CAST(row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_size % 10) AS INTEGER) AS n FROM part GROUP BY p_partkey % 5, p_size % 10")
def tk06_sorted_listing(spark, sf_dir):
    sizes = files.folder_sizes(files.entries(spark, _part_folders(spark, sf_dir)))
    line = F.concat(F.lit("[DIR]  "), "name", F.lit(" ("), F.col("size").cast("string"), F.lit(" bytes)"))
    return sizes.select(F.element_at(F.split("parent", "/"), -1).alias("folder"), line.alias("line"), "n")


@query("SELECT p_partkey, CASE WHEN EXISTS (SELECT 1 FROM part h WHERE h.p_partkey % 3 = 0 AND h.p_partkey % 5 = p.p_partkey % 5 AND h.p_size % 10 = p.p_size % 10) THEN 'directory' ELSE 'none' END AS kind FROM part p")
def io05_exists(spark, sf_dir):
    """Every part asks for its folder; a third of them has written one."""
    path = _part_folders(spark, sf_dir, "p_partkey % 3 = 0")
    base = path if ":" in path else f"file:{path}"
    found = files.entries(spark, path)
    place = F.regexp_extract("folder", "(/k=.*)$", 1)
    known = found.select(F.concat(F.lit(base), F.regexp_extract("path", "(/k=.*)$", 1)).alias("path"), F.concat(F.lit(base), place).alias("folder"))
    asked = views.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(f"{base}/k="), (F.col("p_partkey") % 5).cast("string"), F.lit("/n="), (F.col("p_size") % 10).cast("string")).alias("path"))
    return files.kinds(asked, known).select("p_partkey", "kind")


@query("SELECT n_nationkey || '.txt' AS name FROM nation WHERE n_nationkey % 2 = 0")
def io06_delete(spark, sf_dir):
    path = _nations(spark, sf_dir)
    for r in views.table(spark, sf_dir, "nation").where("n_nationkey % 2 = 1").collect():
        files.delete(spark, f"{path}/{r['n_nationkey']}.txt")
    return files.list_directory(spark, path).where("name not like '.%'").select("name")


# Stores.


def _sessions(spark, sf_dir):
    path = folder(spark, "sessions")
    stores.write_sessions(views.messages(spark, sf_dir), path)
    return path


@query("SELECT conv_id AS session_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def io07_write_sessions(spark, sf_dir):
    got = stores.read_sessions(spark, _sessions(spark, sf_dir))
    return got.groupBy(F.col("session_id").cast("bigint").alias("session_id")).agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@query("SELECT conv_id AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role, text FROM conversations")
def io08_read_sessions(spark, sf_dir):
    return stores.read_sessions(spark, _sessions(spark, sf_dir)).select(F.col("session_id").cast("bigint").alias("session_id"), "pos", "role", "text")


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, 'idle' AS status, left(arg_min(text, turn), 100) AS preview FROM conversations GROUP BY conv_id")
def io10_list_sessions(spark, sf_dir):
    return stores.list_sessions(spark, _sessions(spark, sf_dir)).select("session_id", "status", "preview")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS subjects FROM events GROUP BY 1")
def io11_audit_sink(spark, sf_dir):
    path = folder(spark, "audit")
    audit.append(audit.records(views.calls(spark, sf_dir), TOOL_POLICIES), path)
    got = spark.read.schema("call_id string, subject string, day string").json(path)
    return got.groupBy("day").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


@query("SELECT source AS \"user\", lang AS category, 'c' || doc_id AS content, doc_id % 2 = 0 AS stale FROM documents")
def io13_profiles(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select(F.col("source").alias("user"), F.col("lang").alias("category"), F.col("doc_id").alias("pos"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("content"), (F.col("doc_id") % 2 == 0).alias("stale"))
    path = folder(spark, "profiles")
    stores.write_profiles(d, path)
    return stores.read_profiles(spark, path).select("user", "category", "content", "stale")


@query("SELECT r_name AS slug, n_name AS title, '2024-01-0' || (r_regionkey + 1) AS date, 'one' || chr(10) || n_name AS lessons FROM nation JOIN region ON n_regionkey = r_regionkey")
def io14_topics(spark, sf_dir):
    n, r = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "region")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    entries = rows.select(F.col("r_name").alias("slug"), F.col("n_nationkey").alias("pos"), F.concat(F.lit("2024-01-0"), (F.col("r_regionkey") + 1).cast("string")).alias("date"), F.col("n_name").alias("title"), F.lit("t").alias("task"), F.lit("a").alias("approach"), F.concat(F.lit("one\n"), "n_name").alias("lessons"), F.lit("").alias("user_feedback"), F.lit("").alias("user_adjustment"))
    path = folder(spark, "topics")
    stores.write_topics(r.select(F.col("r_name").alias("slug"), F.col("r_name").alias("title")), entries, path)
    return stores.read_topics(spark, path).select("slug", "title", "date", "lessons")


@query("SELECT source AS slug, min(doc_id) AS pos, source AS title, array_to_string(list_sort(list(DISTINCT lang || 'thing')), ',') AS keywords, CAST(1 AS INTEGER) AS entry_count FROM documents GROUP BY 1")
def io16_index(spark, sf_dir):
    path = folder(spark, "index")
    stores.write_index(views.topics(spark, sf_dir).select("slug", F.col("topic_pos").alias("pos"), "title", "keywords", F.lit(1).alias("entry_count")), path)
    return stores.read_index(spark, path).select("slug", "pos", "title", F.array_join("keywords", ",").alias("keywords"), "entry_count")


@query("SELECT r_regionkey, 'user' AS role, r_name AS text FROM region UNION ALL SELECT r_regionkey, 'assistant', 'answer to ' || r_name FROM region")
def io28_client(spark, sf_dir):
    from weft.client import Client

    client = Client(spark, folder(spark, "client"), lambda said: f"answer to {said[-1]['text']}")
    out = None
    for r in views.table(spark, sf_dir, "region").collect():
        key = client.create(r["r_name"])
        client.send(key, r["r_name"])
        got = client.load(key).select(F.lit(r["r_regionkey"]).alias("r_regionkey"), "role", "text")
        out = got if out is None else out.unionByName(got)
    return out


# Configuration: read on the driver, applied to rows.


@query(f"WITH {CALLS} SELECT event_id, {DECIDED} AS decision FROM calls")
def io17_policy_file(spark, sf_dir):
    lines = "policies:\n" + "".join(f"  - subject: '{p.subject}'\n    action: '{p.action}'\n    resource: '{p.resource}'\n    effect: {p.effect}\n" for p in POLICIES)
    with tempfile.TemporaryDirectory() as here:  # read by the driver alone
        path = os.path.join(here, "policies.yaml")
        with open(path, "w", encoding="utf-8") as f:
            f.write(lines)
        found = stores.load_policies(path)
    return views.calls(spark, sf_dir).select("event_id", policy.decide(found).alias("decision"))


@query("SELECT 's' || p_partkey AS server, CASE p_partkey % 3 WHEN 0 THEN 'command' ELSE 'url' END AS kind, CASE p_partkey % 3 WHEN 0 THEN p_name END AS command, CASE p_partkey % 3 WHEN 1 THEN p_brand END AS url FROM part WHERE p_partkey % 3 < 2")
def io18_servers(spark, sf_dir):
    """Configurations of fifty servers each, as lines of files; those with neither command nor address drop out."""
    p, path = views.table(spark, sf_dir, "part"), folder(spark, "servers")
    one = F.struct(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("key"), F.struct(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("command"), F.when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).alias("url")).alias("value"))
    configs = p.groupBy(F.expr("p_partkey div 50")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(one)).alias("mcpServers"))).alias("text"))
    files.write_rows(configs, path)
    return stores.server_rows(spark.read.text(path), "value").select("server", "kind", "command", "url")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'hello ' || p_name WHEN 1 THEN p_brand || ' has ' || p_name || ' and {more}' ELSE 'built in for ' || p_name END AS text FROM part")
def io30_prompts(spark, sf_dir):
    """Two templates in files and one built in, for every part."""
    path = folder(spark, "prompts")
    files.write_file(spark, f"{path}/t0.txt", "hello {name}")
    files.write_file(spark, f"{path}/t1.txt", "{brand} has {name} and {more}")
    templates = files.read_files(spark, path).select(F.regexp_extract("path", "([^/]*)[.]txt$", 1).alias("template"), "content")
    p = views.table(spark, sf_dir, "part").withColumn("template", F.concat(F.lit("t"), (F.col("p_partkey") % 3).cast("string")))
    return stores.filled(p, templates, {"name": "p_name", "brand": "p_brand"}, {"t2": "built in for {name}"}).select("p_partkey", "text")


# Pages.


def _page_files(spark, sf_dir):
    """Every nation as a page, reached by a file address."""
    path = folder(spark, "pages")
    for r in views.table(spark, sf_dir, "nation").collect():
        files.write_file(spark, f"{path}/{r['n_nationkey']}.html", f"<html><script>no</script><p>about {r['n_name']}</p><a href='/x'>{r['n_regionkey']}</a></html>")
    return path


@query("SELECT n_nationkey, 200 AS status, 'about ' || n_name || n_regionkey AS text FROM nation")
def io19_fetch(spark, sf_dir):
    path = _page_files(spark, sf_dir).removeprefix("file:")
    n = views.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit(f"file://{path}/"), F.col("n_nationkey").cast("string"), F.lit(".html")).alias("url"))
    got = repositories.fetched(n).select("url", "status", html.first_chars(html.html_text("html")).alias("text"))
    return n.join(got, "url").select("n_nationkey", "status", "text")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 200 ELSE -2 END AS status FROM nation")
def io23_http_get(spark, sf_dir):
    path = _page_files(spark, sf_dir).removeprefix("file:")
    end = F.when(F.col("n_nationkey") % 2 == 0, ".html").otherwise(".gone")
    n = views.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit(f"file://{path}/"), F.col("n_nationkey").cast("string"), end).alias("url"))
    return n.join(repositories.fetched(n), "url").select("n_nationkey", "status")


@query("""SELECT page_id, CAST(i - 1 AS INTEGER) AS rank, replace(replace(l[i], '&amp;', '&'), '&lt;', '<') AS title FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)[1:5] AS l FROM pages), generate_series(1, 5) t(i) WHERE i <= len(l)""")
def io20_search_results(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.html_links("html")).alias("rank", "title"))


@query("SELECT n_nationkey AS page, n_name AS text FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT n_nationkey, '' FROM nation WHERE n_nationkey % 3 = 0")
def pa10_readme(spark, sf_dir):
    k, name = F.col("n_nationkey") % 3, F.col("n_name")
    page = F.when(k == 0, F.concat(F.lit('<div id="readme">'), name, F.lit("</div>"))).when(k == 1, F.concat(F.lit('<article class="markdown-body entry-content">'), name, F.lit("</article>"))).otherwise(F.concat(F.lit('<div itemprop="text"><p>'), name, F.lit("</p></div>")))
    return views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page"), html.html_readme(page).alias("text"))


def _listing(spark, sf_dir):
    """A listing page for each region, a box for each of its nations."""
    n = views.table(spark, sf_dir, "nation")
    box = F.concat(F.lit('<article class="Box-row"><h2><a href="/'), "n_name", F.lit('/r">x</a></h2><a href="/'), "n_name", F.lit('/r/stargazers">'), F.col("n_nationkey").cast("string"), F.lit("</a></article>"))
    boxes = n.select("n_regionkey", F.struct("n_nationkey", box.alias("b")).alias("x")).groupBy("n_regionkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return boxes.select(F.col("n_regionkey").cast("string").alias("url"), F.array_join(F.transform("xs", lambda x: x["b"]), "").alias("html"))


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS page, 'daily' AS since, '2024-05-01' AS day, count(*) AS n,
    '# GitHub Trending Repositories' || chr(10) || chr(10) || '> **时间范围**: Daily（今日）' || chr(10) || '> **编程语言**: 不限' || chr(10) || '> **生成时间**: 2024-05-01 08:00:00 CST' || chr(10) || '> **数据来源**: [GitHub Trending](' || any_value(n_regionkey) || ')' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
    string_agg('## ' || rank || '. [' || n_name || '/r](https://github.com/' || n_name || '/r)' || chr(10) || chr(10) || '- **Stars**: ' || n_nationkey || chr(10) || '- **Forks**: ', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '*共 ' || count(*) || ' 个上榜仓库*' || chr(10) AS markdown
  FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rank FROM nation) GROUP BY 1""")
def io21_trending_report(spark, sf_dir):
    path = folder(spark, "reports")
    repositories.write_report(repositories.trending(_listing(spark, sf_dir)), path, "2024-05-01 08:00:00")
    return repositories.read_reports(spark, path).select("page", "since", F.col("day").cast("string").alias("day"), "n", "markdown")


@query("SELECT n_regionkey AS page, n_name || '/r' AS full_name FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rank FROM nation) WHERE rank <= 2")
def tk05_list_caps(spark, sf_dir):
    return repositories.trending(_listing(spark, sf_dir), limit=2).select(F.col("page").cast("int").alias("page"), "full_name")


@query("SELECT count(*) FILTER (n_nationkey % 4 > 0) AS succeeded, count(*) AS total FROM nation")
def ag13_success(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation")
    url = F.concat(F.lit("https://github.com/o/"), "n_name")
    asked = n.select(F.col("n_nationkey").alias("pos"), url.alias("url"), url.rlike(repositories.URL).alias("valid"))
    pages = n.where("n_nationkey % 4 > 0").select(url.alias("url"), F.lit("<div itemprop=text>t</div>").alias("html"))
    return repositories.success(repositories.readmes(asked, pages))


# Tools, hooks, skills.


def _catalog(spark, sf_dir):
    """Regions as servers, nations as their tools."""
    servers = {}
    for r in views.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        s = servers.setdefault(f"r{r['n_regionkey']}", {"tools": [], "risks": {}})
        s["tools"].append({"name": f"t{r['n_nationkey']}", "description": r["n_name"], "inputSchema": {"properties": {"q": {"type": ["string", "null"]}, "n": {"type": "integer"}}, "required": ["q"]}})
        if r["n_nationkey"] % 2 == 0:
            s["risks"][f"t{r['n_nationkey']}"] = "low"
    return json.dumps(servers)


@query("SELECT 'r' || n_regionkey AS server, 'mcp__r' || n_regionkey || '__t' || n_nationkey AS full_name, n_name AS description, CASE WHEN n_nationkey % 2 = 0 THEN 'low' ELSE 'high' END AS risk FROM nation")
def io24_external_tools(spark, sf_dir):
    return tools.discover(spark, _catalog(spark, sf_dir)).select("server", "full_name", "description", "risk")


@query("""SELECT 'mcp__r' || n_regionkey || '__t' || n_nationkey AS tool, p.name, p.type, p.required FROM nation, (VALUES ('q', 'string', true), ('n', 'integer', false)) p(name, type, required)""")
def sc24_schema_parameters(spark, sf_dir):
    rows = tools.discover(spark, _catalog(spark, sf_dir))
    one = F.explode(F.from_json("parameters", "array<struct<name:string,type:string,required:boolean>>"))
    return rows.select(F.col("full_name").alias("tool"), one.alias("p")).select("tool", "p.*")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'r0:t0:' || p_name ELSE 'r2:t2:' || p_name END AS answer FROM part")
def ud09_external_registry(spark, sf_dir):
    """Tools of two servers, discovered, registered and called for every part."""
    center = registry.Tools()
    tools.register_all(tools.discover(spark, _catalog(spark, sf_dir)), center, lambda server, name, args: f"{server}:{name}:{args['q']}")
    for name in ("mcp__r0__t0", "mcp__r2__t2"):  # an external tool takes named arguments, a SQL function places
        center.add(registry.Tool(name, center.get(name).description, lambda q, call=center.get(name).func: call(q=q), center.get(name).risk))
    center.as_functions(spark)
    return views.table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 2 = 0 THEN mcp__r0__t0(p_name) ELSE mcp__r2__t2(p_name) END").alias("answer"))


def _sample_functions(spark):
    center = registry.sample_tools()
    center.as_functions(spark)
    return center


@query("SELECT p_partkey, '[test-server echo]: ' || p_name AS said FROM part")
def ud14_sample_tools(spark, sf_dir):
    _sample_functions(spark)
    return views.table(spark, sf_dir, "part").select("p_partkey", F.expr("echo(p_name)").alias("said"))


def _tools_of_package(spark):
    center = registry.Tools()
    center.discover("weft.tools")
    center.as_functions(spark)
    return center


def _refused(spark, call):
    """Whether a query with this call fails when it is analysed."""
    try:
        spark.sql(f"SELECT {call}").schema  # noqa: B018
    except AnalysisException:
        return True
    return False


@query("SELECT doc_id, CAST(generate_subscripts(lines, 1) AS INTEGER) AS n, unnest(lines) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)")
def ud02_table_tool(spark, sf_dir):
    """A discovered tool that yields rows, for every document."""
    _tools_of_package(spark)
    views.table(spark, sf_dir, "documents").createOrReplaceTempView("weft_texts")
    return spark.sql("SELECT doc_id, t.n, t.line FROM weft_texts, LATERAL numbered_lines(text) t")


@query("""SELECT p_partkey, p_name || '-' || p_size AS low, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: left(w, 1)), 'string_agg', '') AS medium, true AS high_refused FROM part""")
def ud03_routes(spark, sf_dir):
    """A tool of each risk: an expression in the plan, a worker with a time limit, none at all."""
    _tools_of_package(spark)
    return views.table(spark, sf_dir, "part").select("p_partkey", F.expr("label(p_name, p_size)").alias("low"), F.expr("initials(p_name)").alias("medium"), F.lit(_refused(spark, "run_anything('ls')")).alias("high_refused"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'expression' WHEN 1 THEN 'worker' WHEN 2 THEN 'refused' ELSE 'expression' END AS route FROM part")
def ud03_risk_routing(spark, sf_dir):
    """The route of each call by its tool's risk; an unknown risk runs as a low one does."""
    risk = F.element_at(F.array(*map(F.lit, (*registry.RISKS, "unknown"))), F.col("p_size") % 4 + 1)
    return views.table(spark, sf_dir, "part").select("p_partkey", registry.route(risk).alias("route"))


@query("SELECT p_partkey, p_size || ':' || p_name AS said, p_size * 2 + 1 AS more FROM part")
def ud01_declare(spark, sf_dir):
    """Declared tools, called for every part with the types that their signatures name."""
    center = registry.Tools()

    @center.tool()
    def described(size: int, name: str) -> str:
        """A size and a name."""
        return f"{size}:{name}"

    @center.tool("raised", "twice and one more", returns="int")
    def _raised(size: int, by: int):
        return size * by + 1

    center.as_functions(spark)
    names = {p["name"]: p["type"] for p in center.get("described").parameters}
    cast = F.col("p_size").cast(registry.SQL_TYPES[names["size"]])
    return views.table(spark, sf_dir, "part").withColumn("size", cast).select("p_partkey", F.expr("described(size, p_name)").alias("said"), F.expr("raised(p_size, 2)").alias("more"))


@query("SELECT p_partkey, 'second ' || p_name AS said, true AS gone FROM part")
def ud02_registry(spark, sf_dir):
    """The last registration of a name counts; what is taken out no query finds."""
    center = registry.Tools()
    center.add(registry.Tool("spoken", "", lambda x: f"first {x}"))
    center.add(registry.Tool("dropped", "", str))
    center.add(registry.Tool("spoken", "", lambda x: f"second {x}"))
    center.remove("dropped")
    center.as_functions(spark)
    return views.table(spark, sf_dir, "part").select("p_partkey", F.expr("spoken(p_name)").alias("said"), F.lit(_refused(spark, "dropped('x')")).alias("gone"))


@query("SELECT p_brand AS point, p_partkey AS hook, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS INTEGER) AS n FROM part WHERE p_partkey % 5 <> 0")
def tk04_hook_order(spark, sf_dir):
    """Parts as hooks of their brand, a fifth of them disabled."""
    hooks = views.table(spark, sf_dir, "part").select(F.col("p_brand").alias("point"), F.col("p_name").alias("name"), F.col("p_size").alias("priority"), F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 5 != 0).alias("enabled"))
    return registry.hook_order(hooks).select("point", F.col("seq").alias("hook"), "n")


@query("""SELECT event_type AS point, user_id AS name, max(event_id) AS seq FROM events e WHERE event_type <> 'error'
    GROUP BY 1, 2 HAVING max(event_id) > coalesce((SELECT max(event_id) FROM events x WHERE x.event_type = 'error' AND x.user_id = e.user_id), -1)""")
def ud06_hook_registry(spark, sf_dir):
    """Events as a log of registrations at their type, which an error takes back."""
    e = views.table(spark, sf_dir, "events")
    log = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("op"), F.col("event_type").alias("point"), F.col("user_id").alias("name"))
    return registry.standing(log)


@query("SELECT o_orderkey, o_totalprice * 2 AS price, 'low' AS risk FROM orders WHERE o_orderstatus = 'O'")
def ud05_hook_chain(spark, sf_dir):
    hooks = registry.Hooks()
    hooks.add("plan", registry.Hook(30, "risk", registry.MODIFY, lambda df: df.withColumn("risk", F.lit("low"))))
    hooks.add("plan", registry.Hook(10, "open", registry.MODIFY, lambda df: df.where("o_orderstatus = 'O'")))
    hooks.add("plan", registry.Hook(20, "known", registry.CONTROL, lambda df: None if "o_totalprice" in df.columns else registry.Decision(registry.ABORT, "no price")))
    hooks.add("plan", registry.Hook(40, "seen", registry.OBSERVE, lambda df: [F.count("*").alias("n")]))
    return hooks.transform("plan", views.table(spark, sf_dir, "orders")).select("o_orderkey", (F.col("o_totalprice") * 2).alias("price"), "risk")


def _skills(spark, sf_dir):
    """Parts as skills, with a tool and, for the user's own, scripts."""
    p = views.table(spark, sf_dir, "part")
    tools_ = F.array(F.struct(F.col("p_brand").alias("name"), F.col("p_type").alias("description")))
    return p.select(F.concat_ws("-", "p_name", "p_partkey").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "user").otherwise("builtin").alias("type"), F.col("p_type").alias("description"), tools_.alias("tools"), F.array(F.lit("run"), F.col("p_brand")).alias("scripts"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")).alias("max_iterations"), F.lit("the body").alias("body"))


@query("SELECT p_name || '-' || p_partkey AS name, p_brand || CASE WHEN p_partkey % 2 = 0 THEN ',run' ELSE '' END AS tools, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 5 END AS max_iterations, CASE WHEN p_partkey % 2 = 0 THEN 'skill:user' ELSE 'skill:builtin' END AS source FROM part")
def pf21_agent_configs(spark, sf_dir):
    return registry.agent_configs(_skills(spark, sf_dir)).select("name", F.array_join("tools", ",").alias("tools"), "max_iterations", "source")


@query("SELECT p_name || '-' || p_partkey AS name, '# ' || p_name || '-' || p_partkey || chr(10) || chr(10) || p_type || chr(10) || chr(10) || '## Tools' || chr(10) || '- ' || p_brand || ': ' || p_type || chr(10) || chr(10) || 'the body' AS prompt FROM part")
def ud16_skill_prompt(spark, sf_dir):
    return registry.skill_prompt(_skills(spark, sf_dir)).select("name", "prompt")


@query("SELECT string_agg('- ' || agent || ': ' || description, chr(10) ORDER BY pos) AS catalog FROM (SELECT min(p_partkey) AS pos, lower(p_type) AS agent, 'builds ' || lower(p_type) || ' rings and bolts' AS description FROM part GROUP BY p_type)")
def ag15_catalog_text(spark, sf_dir):
    return registry.catalog_text(views.agents(spark, sf_dir))


@query("SELECT p_type AS name, CASE WHEN min(p_partkey) % 3 = 0 THEN 'both' ELSE 'builtin' END AS origin FROM part GROUP BY 1")
def st08_skill_union(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("pos"))
    return registry.override(p.withColumn("origin", F.lit("builtin")), p.where("pos % 3 = 0").withColumn("origin", F.lit("both"))).select("name", "origin")


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'done at once' ELSE '[test-server echo]: ' || p_name END AS answer, CAST(CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 4 END AS BIGINT) AS n FROM part")
def ud13_tool_loop(spark, sf_dir):
    """A loop of asking and calling tools for every part, a batch of rows at a time."""

    def answer(said):
        told = [m for m in said if m["role"] == "tool"]
        if said[0]["content"] == "":
            return {"content": "done at once"}
        return {"content": told[-1]["content"]} if told else {"content": "", "tool_calls": [{"name": "echo", "args": {"message": said[0]["content"]}}]}

    rows = views.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_name")).alias("text"))
    return registry.run_loops(rows, "text", lambda talks: list(map(answer, talks)), registry.sample_tools()).select("p_partkey", "answer", "n")


@query("""SELECT CAST(conv_id AS VARCHAR) AS session_id, 'preference' AS kind, 'style' AS category, 'likes ' || left(arg_min(text, turn), 5) AS content, NULL AS slug FROM conversations GROUP BY conv_id
  UNION ALL SELECT CAST(conv_id AS VARCHAR), 'topic', NULL, NULL, 'chat_' || count(*) FROM conversations GROUP BY conv_id HAVING count(*) > 2""")
def ud12_extract_memory(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("n"), F.left(F.min_by("text", "turn"), F.lit(5)).alias("head"))
    said = c.select("session_id", F.concat_ws("\u0001", F.col("n").cast("string"), "head").alias("text"))

    def liked(texts):
        return [f"I see:\n```json\n{json.dumps({'preferences': [{'category': 'style', 'content': 'likes ' + t.split(chr(1), 1)[1]}, {'category': 'empty', 'content': ''}]})}\n```" for t in texts]

    def learned(texts):
        return [json.dumps({"has_memory": True, "memory": {"topic_slug": f"chat_{t.split(chr(1))[0]}", "title": "t"}}) if int(t.split(chr(1))[0]) > 2 else None if t[0] == "1" else '{"has_memory": false}' for t in texts]

    return memory.extract(said, liked, learned).select("session_id", "kind", "category", "content", "slug")


# Streams: read from the shared folder, run until nothing is left, and read again.


def _stream(spark, sf_dir, columns):
    """The events as a stream of files."""
    path = folder(spark, "stream")
    views.table(spark, sf_dir, "events").select(*columns).write.parquet(path)
    shape = spark.read.parquet(path).schema
    return spark.readStream.schema(shape).parquet(path)


def _drained(spark, stream, label):
    """The rows that a stream gives until its input ends."""
    path = folder(spark, label)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{folder(spark, label)}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("SELECT event_id, 'push' AS type, event_type AS event, props AS body FROM events")
def io27_line_envelopes(spark, sf_dir):
    from weft.operators import messages

    e, path = views.table(spark, sf_dir, "events"), folder(spark, "envelopes")
    files.write_rows(e.select(messages.encode_envelope(F.lit("push"), F.col("event_type"), F.create_map(F.lit("body"), F.col("props")), F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("text")), path)
    got = streams.from_lines(spark, path).select(F.col("id").cast("bigint").alias("event_id"), "type", "event", F.col("payload")["body"].alias("body"))
    return _drained(spark, got, "decoded")


@query("SELECT event_id, 'x' || user_id AS subscriber FROM events WHERE user_id % 2 = 0")
def ss01_broadcast(spark, sf_dir):
    users = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id")).distinct().where("session_id % 2 = 0").withColumn("subscriber", F.concat(F.lit("x"), F.col("session_id").cast("string")))
    path, stream = folder(spark, "delivered"), _stream(spark, sf_dir, ["event_id", F.col("user_id").alias("session_id")])
    streams.broadcast(stream, users, lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}"), folder(spark, "broadcast"), once=True).awaitTermination()
    return spark.read.parquet(path).select("event_id", "subscriber")


@query("SELECT user_id, count(*) AS n, list_sort(list(event_id))[1] AS first FROM events GROUP BY 1")
def ss02_collect(spark, sf_dir):
    path, stream = folder(spark, "buffer"), _stream(spark, sf_dir, ["event_id", F.col("user_id").alias("session_id")])
    users = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id")).distinct()
    streams.broadcast(stream, users, lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}"), folder(spark, "collect"), once=True).awaitTermination()
    return spark.read.parquet(path).groupBy(F.col("session_id").alias("user_id")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def ss12_audit_stream(spark, sf_dir):
    path = folder(spark, "audited")
    streams.audit_sink(_stream(spark, sf_dir, ["event_id", "ts"]), path, folder(spark, "audit-checkpoint"), once=True).awaitTermination()
    return spark.read.schema("event_id long, day string").json(path).groupBy("day").agg(F.count("*").alias("n"))


@query("""SELECT a.event_id AS asked, b.event_id AS answered FROM events a JOIN events b ON b.user_id = a.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'signup' AND b.event_type = 'purchase'""")
def ss11_replies(spark, sf_dir):
    e = _stream(spark, sf_dir, ["event_id", "event_type", F.col("user_id").alias("session_id"), "ts"])
    asks, answers = e.where("event_type = 'signup'").withColumn("question", F.col("event_id")), e.where("event_type = 'purchase'").withColumn("reply", F.col("event_id"))
    return _drained(spark, streams.replies(asks, answers).select(F.col("question").alias("asked"), F.col("reply").alias("answered")), "replies")


@query("SELECT p_partkey, p_name AS plan, 'interrupt' AS reason FROM part")
def ss08_checkpoints(spark, sf_dir):
    """The state of every part's run written as a snapshot and restored; a line that is none is left out."""
    p, path = views.table(spark, sf_dir, "part"), folder(spark, "snapshots")
    files.write_rows(streams.snapshots(p.select("p_partkey", F.col("p_name").alias("plan")), "interrupt"), path)
    files.write_rows(p.limit(1).select(F.lit("{}").alias("text")), path, mode="append")
    return streams.restored(spark.read.text(path), "p_partkey long, plan string")


@query("SELECT event_id, user_id FROM events")
def ss09_timeout(spark, sf_dir):
    """A stream that is paused when its time is up, and goes on from its checkpoint: every event once."""
    source, path = _stream(spark, sf_dir, ["event_id", "user_id"]), folder(spark, "timeout")
    sink = source.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint")
    streams.run_for(sink.trigger(processingTime="200 milliseconds").start(), 1.0)
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(source.schema).parquet(path)
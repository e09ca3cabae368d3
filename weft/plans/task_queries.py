"""Queries over task graphs, catalogs, pages and expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.calc import calculate
from weft.functions.html import html_links, html_text
from weft.functions.text import normalize_skill, params_block
from weft.operators import graph, messages, registry, sessions
from weft.sources import repositories

from . import views
from .registry import query
from .views import AGENTS, TASKS


@query(f"WITH {TASKS} SELECT CAST(half AS VARCHAR) AS src, task_id AS dst FROM tasks WHERE k > 0")
def gr01_edges(spark, sf_dir):
    return graph.edges(views.tasks(spark, sf_dir))


@query(f"WITH RECURSIVE {TASKS}, walk(k, layer) AS (SELECT k, 0 FROM tasks WHERE k = 0 UNION ALL SELECT t.k, w.layer + 1 FROM walk w JOIN tasks t ON t.half = w.k AND t.k > 0) SELECT CAST(k AS VARCHAR) AS task_id, layer FROM walk")
def gr02_layers(spark, sf_dir):
    return graph.layers(views.tasks(spark, sf_dir))


def _tangled(spark, sf_dir):
    """The same tasks with a second dependency that may be missing or close a cycle."""
    more = F.when(F.col("task_id").cast("bigint") % 7 == 0, F.array((F.col("task_id").cast("bigint") * 3).cast("string"))).otherwise(F.array().cast("array<string>"))
    return views.tasks(spark, sf_dir).withColumn("dependencies", F.concat("dependencies", more))


@query(f"WITH {TASKS} SELECT task_id, CAST(k * 3 AS VARCHAR) AS dep FROM tasks WHERE k % 7 = 0 AND k * 3 NOT IN (SELECT k FROM tasks)")
def jn04_missing(spark, sf_dir):
    return graph.missing(_tangled(spark, sf_dir))


@query(f"""WITH RECURSIVE {TASKS}, e AS (SELECT half AS src, k AS dst FROM tasks WHERE k > 0 UNION SELECT t.k * 3, t.k FROM tasks t WHERE k % 7 = 0 AND k * 3 IN (SELECT k FROM tasks)),
  walk(a, b) AS (SELECT src, dst FROM e UNION SELECT w.a, e.dst FROM walk w JOIN e ON e.src = w.b),
  looped AS (SELECT DISTINCT a AS k FROM walk WHERE a = b), stuck AS (SELECT k FROM looped UNION SELECT w.b FROM walk w JOIN looped l ON l.k = w.a)
  SELECT task_id, 'missing:' || k * 3 AS problem FROM tasks WHERE k % 7 = 0 AND k * 3 NOT IN (SELECT k FROM tasks) UNION ALL SELECT CAST(k AS VARCHAR), 'cycle' FROM stuck""")
def gr03_validate(spark, sf_dir):
    return graph.validate(_tangled(spark, sf_dir))


@query(f"""WITH RECURSIVE {TASKS}, bad(k) AS (SELECT k FROM tasks WHERE status = 'failed' UNION SELECT t.k FROM bad b JOIN tasks t ON t.half = b.k AND t.k > 0)
  SELECT task_id, CASE WHEN b.k IS NOT NULL THEN 'failed' ELSE status END AS status, CASE WHEN b.k IS NOT NULL AND status <> 'failed' THEN '' ELSE result END AS result FROM tasks t LEFT JOIN bad b USING (k)""")
def gr04_cascade(spark, sf_dir):
    return graph.cascade(views.tasks(spark, sf_dir)).select("task_id", "status", "result")


@query(f"""WITH RECURSIVE {TASKS}, run(k, status, result) AS (SELECT k, 'completed', 'did use {{{{0}}}} and {{{{ 0.result }}}} and {{{{zz}}}}' FROM tasks WHERE k = 0
    UNION ALL SELECT t.k, CASE WHEN r.status = 'failed' OR t.k % 50 = 49 THEN 'failed' ELSE 'completed' END, CASE WHEN r.status = 'failed' THEN '' ELSE 'did use ' || r.result || ' and {{{{ ' || t.k || '.result }}}} and {{{{zz}}}}' END FROM run r JOIN tasks t ON t.half = r.k AND t.k > 0)
  SELECT CAST(k AS VARCHAR) AS task_id, status, result FROM run""")
def gr05_run_layers(spark, sf_dir):
    done = lambda df: df.select("task_id", F.concat(F.lit("did "), "description").alias("result"), F.when(F.col("task_id").cast("bigint") % 50 == 49, "broke").alias("error"))
    return graph.run_layers(views.tasks(spark, sf_dir), done).select("task_id", "status", "result")


@query(f"""WITH {TASKS} SELECT t.task_id, CAST(t.half AS VARCHAR) AS dep, CASE WHEN d.k IS NULL THEN 'missing' ELSE d.status END AS state, CASE WHEN d.status = 'completed' THEN d.result END AS preview
  FROM tasks t LEFT JOIN tasks d ON d.k = t.half WHERE t.k > 0""")
def jn02_dependencies(spark, sf_dir):
    return graph.dependency_inputs(views.tasks(spark, sf_dir)).select("task_id", "dep", "state", "preview")


@query(f"WITH {TASKS} SELECT task_id FROM tasks WHERE k > 0 AND half IN (SELECT k FROM tasks WHERE status = 'failed')")
def jn03_blocked(spark, sf_dir):
    return graph.blocked(views.tasks(spark, sf_dir)).select("task_id")


@query(f"WITH {TASKS} SELECT task_id FROM tasks WHERE status = 'pending' AND (k = 0 OR half IN (SELECT k FROM tasks WHERE status = 'completed'))")
def gr05_ready(spark, sf_dir):
    return graph.ready(views.tasks(spark, sf_dir)).select("task_id")


@query(f"""WITH {TASKS} SELECT t.task_id, 'use ' || CASE WHEN d.result IS NOT NULL THEN d.result ELSE '{{{{' || t.half || '}}}}' END || ' and ' || CASE WHEN t.result IS NOT NULL THEN t.result ELSE '{{{{ ' || t.k || '.result }}}}' END || ' and {{{{zz}}}}' AS resolved
  FROM tasks t LEFT JOIN tasks d ON d.k = t.half""")
def jn05_placeholders(spark, sf_dir):
    t = views.tasks(spark, sf_dir)
    return graph.resolve(t.select("task_id", "description"), t.where("status = 'completed'").select("task_id", "result")).select("task_id", "resolved")


@query(f"WITH {TASKS} SELECT plan_id, bool_and(status IN ('completed', 'failed')) AS terminal, bool_or(status IN ('pending', 'running')) AS pending FROM tasks GROUP BY 1")
def ag12_status(spark, sf_dir):
    return views.tasks(spark, sf_dir).groupBy("plan_id").agg(graph.all_terminal(F.col("status")).alias("terminal"), graph.any_pending(F.col("status")).alias("pending"))


@query(f"WITH {TASKS} SELECT plan_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed FROM tasks GROUP BY 1")
def ag08_progress(spark, sf_dir):
    return sessions.progress(views.tasks(spark, sf_dir))


MATCHED = f"""WITH {AGENTS}, q AS (SELECT DISTINCT p_type AS query FROM part UNION SELECT DISTINCT 'make ' || lower(p_type) FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part),
  n AS (SELECT query, replace(replace(lower(query), '_', '-'), ' ', '-') AS q FROM q),
  l AS (SELECT query, agent, pos, CASE WHEN q = replace(replace(lower(skill), '_', '-'), ' ', '-') THEN 1
      WHEN length(q) >= 3 AND (contains(replace(replace(lower(skill), '_', '-'), ' ', '-'), q) OR contains(q, replace(replace(lower(skill), '_', '-'), ' ', '-'))) THEN 2
      WHEN contains(description, q) OR len(list_filter(string_split(q, '-'), lambda w: length(w) >= 2 AND contains(description, w))) > 0 THEN 3 END AS level FROM n, agents),
  b AS (SELECT *, min(level) OVER (PARTITION BY query) AS best, row_number() OVER (PARTITION BY query ORDER BY level, pos) AS r FROM l WHERE level IS NOT NULL)"""


@query(f"{MATCHED} SELECT query, agent, CAST(level AS INTEGER) AS level FROM b WHERE level = best AND (level > 1 OR r = 1)")
def jn06_skill(spark, sf_dir):
    return registry.match_skill(_asked(spark, sf_dir), views.agents(spark, sf_dir))


def _asked(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    return p.select(F.explode(F.array("p_type", F.concat(F.lit("make "), F.lower("p_type")), F.get(F.split("p_name", " "), F.lit(1)))).alias("query")).distinct()


@query(f"""{MATCHED} SELECT query, coalesce(min_by(agent, pos) FILTER (level = best), (SELECT arg_min(agent, pos) FROM agents)) AS agent
  FROM (SELECT query FROM q UNION ALL SELECT 'zz-qq') LEFT JOIN b USING (query) GROUP BY query""")
def jn07_assign(spark, sf_dir):
    return registry.assign(_asked(spark, sf_dir).unionByName(_asked(spark, sf_dir).limit(1).select(F.lit("zz-qq").alias("query"))), views.agents(spark, sf_dir))


@query("SELECT lower(p_type) AS name, min(p_partkey) AS pos FROM part WHERE lower(p_type) = 'promo' GROUP BY p_type")
def ud15_find(spark, sf_dir):
    a = views.agents(spark, sf_dir).select(F.col("agent").alias("name"), "pos", "description", F.lit("").alias("summary"))
    return registry.find_skills(a, "PROMO").select("name", "pos")


@query("SELECT lower(p_type) AS name, CASE WHEN min(p_partkey) % 2 = 0 THEN 'user' ELSE 'builtin' END AS origin FROM part GROUP BY p_type")
def jn13_override(spark, sf_dir):
    a = views.agents(spark, sf_dir).select(F.col("agent").alias("name"), "pos")
    return registry.override(a.withColumn("origin", F.lit("builtin")), a.where("pos % 2 = 0").withColumn("origin", F.lit("user"))).select("name", "origin")


@query("SELECT DISTINCT p_name AS name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 40)")
def jn12_available(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    return registry.available(p.select(F.col("p_name").alias("name")).distinct(), p.where("p_size > 40").select(F.col("p_name").alias("name")))


@query("SELECT p_name, first, CAST(row_number() OVER (ORDER BY first, p_name) AS INTEGER) AS rank FROM (SELECT p_name, min(p_partkey) AS first FROM part GROUP BY 1)")
def st05_distinct(spark, sf_dir):
    return graph.first_seen(views.table(spark, sf_dir, "part"), "p_name", "p_partkey")


@query("SELECT p_partkey, replace(replace(lower(p_name || '_' || p_type), '_', '-'), ' ', '-') AS skill FROM part")
def sc17_normalize(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", normalize_skill(F.concat_ws("_", "p_name", "p_type")).alias("skill"))


@query("SELECT p_partkey, p_name || '\n\n【执行参数】\n- brand: ' || p_brand AS description FROM part")
def sc22_params(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", params_block("p_name", F.create_map(F.lit("brand"), F.col("p_brand"))).alias("description"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS needs FROM part")
def pf19_needs_tool(spark, sf_dir):
    d = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("please write "), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("write 介绍 "), "p_name")).otherwise(F.lit("think"))
    return views.table(spark, sf_dir, "part").select("p_partkey", messages.needs_tool(d).alias("needs"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * (1 - l_discount) - (-7) * 2, 4) AS value FROM lineitem")
def sc12_calculate(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    text = F.concat(F.col("l_quantity").cast("string"), F.lit(" * (1 - "), F.col("l_discount").cast("string"), F.lit(") - (-7) * 2"))
    return li.select("l_orderkey", "l_linenumber", F.round(calculate(text), 4).alias("value"))


CLEAN = r"regexp_replace(html, '(?is)<(script|style|template)\b.*?</(script|style|template)\s*>|<!--.*?-->|<![^>]*>', '<x>', 'g')"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&#x27;": "''", "&nbsp;": "\u00a0", "&eacute;": "é", "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&copy;": "©", "&middot;": "·", "&mdash;": "—", "&amp;": "&"}


def _unescaped(x: str) -> str:
    for name, char in ENTITIES.items():
        x = f"replace({x}, '{name}', '{char}')"
    return x


@query(f"""SELECT page_id, array_to_string(list_transform(string_split_regex({CLEAN}, '<[^>]*>'), lambda x: trim({_unescaped('x')}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '') AS text FROM pages""")
def pa07_text(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", html_text("html").alias("text"))


@query("""SELECT page_id, replace(replace(array_to_string(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)[1:5], '|'), '&amp;', '&'), '&lt;', '<') AS links FROM pages""")
def pa08_links(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", F.array_join(html_links("html"), "|").alias("links"))


@query("""SELECT n_nationkey AS page, n_name || '/r' AS full_name, 'about ' || n_name AS description, CAST(n_regionkey AS VARCHAR) AS stars FROM nation""")
def pa09_repositories(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation")
    html = F.concat(F.lit('<article class="Box-row"><h2 class="h3"><a href="/'), "n_name", F.lit('/r">x</a></h2><p> about '), "n_name", F.lit(' </p><a href="/'), "n_name", F.lit('/r/stargazers"> '), F.col("n_regionkey").cast("string"), F.lit(" </a></article>"))
    got = repositories.trending(n.select(F.col("n_nationkey").alias("url"), html.alias("html")))
    return got.select("page", "full_name", "description", "stars")


@query("SELECT n_nationkey AS pos, true AS ok, n_name || '\nend' AS text FROM nation")
def io22_readmes(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation")
    url = F.concat(F.lit("https://github.com/o/"), "n_name")
    asked = n.select(F.col("n_nationkey").alias("pos"), url.alias("url"), url.rlike(repositories.URL).alias("valid"))
    pages = n.select(url.alias("url"), F.concat(F.lit('<div id="readme"><article class="markdown-body"><p>'), "n_name", F.lit("</p><p>\n\n\n\n</p><p>\nend</p></article></div>")).alias("html"))
    return repositories.readmes(asked, pages).select("pos", "ok", "text")

"""Queries over long-term memory, carried by the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.markdown import profile_rows, slide_rows, topic_rows
from weft.functions.text import char_jaccard, days_since, decay, ellipsis, keyword_match, memory_keywords, summary, task_keywords
from weft.operators import history, memory

from . import views
from .registry import query
from .views import AS_OF, ENTRIES, QUERY, TOPICS

WORDS = "regexp_extract_all(lower({x}), '[a-zA-Z]{{3,}}')"
QWORDS = "['the', 'thing', 'and', 'nation', 'that']"
MATCH = "CASE WHEN len({t}) > 0 THEN len(list_filter(" + QWORDS + ", lambda q: len(list_filter({t}, lambda t: contains(t, q) OR contains(q, t))) > 0)) / 5.0e0 ELSE 0.0e0 END"
FIXED = "The thing of nation"


def match(t: str) -> str:
    return MATCH.format(t=t)


@query(f"SELECT doc_id, CAST(len({WORDS.format(x='text')}) AS BIGINT) AS n, CAST(len(list_distinct({WORDS.format(x='text')})) AS BIGINT) AS n_distinct FROM documents")
def sc02_keywords(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", memory_keywords("text").alias("k"))
    return d.select("doc_id", F.size("k").cast("bigint").alias("n"), F.size(F.array_distinct("k")).cast("bigint").alias("n_distinct"))


@query("SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z0-9_]{2,}'), lambda x: lower(x)))), ' ')) AS keywords FROM documents")
def sc03_task_keywords(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(task_keywords("text"), " ")).alias("keywords"))


@query(f"WITH k AS (SELECT doc_id, list_distinct({WORDS.format(x='text')}) AS ks FROM documents) SELECT doc_id, round({match('ks')}, 6) AS score FROM k")
def sc04_score(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(memory_keywords("text")).alias("k"))
    return d.select("doc_id", F.round(keyword_match(memory_keywords(F.lit(QUERY)), F.col("k")), 6).alias("score"))


@query(f"WITH {ENTRIES} SELECT pos AS doc_id, days, round(exp(-ln(2) / 30 * days), 6) AS decay FROM ent")
def sc05_decay(spark, sf_dir):
    e = views.entries(spark, sf_dir).withColumn("days", days_since("date", AS_OF))
    return e.select(F.col("pos").alias("doc_id"), "days", F.round(decay(F.col("days")), 6).alias("decay"))


SEARCH = f"""WITH {ENTRIES}, {TOPICS},
  k AS (SELECT e.slug, e.pos, e.title, e.date, t.topic_pos, t.keywords, days, list_distinct({WORDS.format(x="e.title || ' ' || e.text")}) AS ks FROM ent e JOIN top t USING (slug)),
  s AS (SELECT *, (0.3e0 * {match('keywords')} + 0.7e0 * {match('ks')}) * exp(-ln(2) / 30 * days) AS raw FROM k)"""


@query(SEARCH + " SELECT slug, pos, title, date, round(raw, 3) AS score FROM s WHERE raw > 0 ORDER BY round(raw, 12) DESC, topic_pos, pos LIMIT 20")
def tk01_search(spark, sf_dir):
    hits = memory.search(views.topics(spark, sf_dir), views.entries(spark, sf_dir), QUERY, AS_OF, 20)
    return hits.select("slug", "pos", "title", "date", "score")


@query(SEARCH + f", hits AS (SELECT slug FROM s WHERE raw > 0 ORDER BY round(raw, 12) DESC, topic_pos, pos LIMIT 5) SELECT slug, CASE WHEN slug IN (SELECT slug FROM hits) THEN '{AS_OF}' END AS last_accessed_at FROM top")
def mg05_touch(spark, sf_dir):
    topics = views.topics(spark, sf_dir)
    hits = memory.search(topics, views.entries(spark, sf_dir), QUERY, AS_OF, 5)
    return memory.touch(topics.withColumn("last_accessed_at", F.lit(None).cast("string")), hits, AS_OF).select("slug", "last_accessed_at")


@query(f"""WITH j AS (SELECT doc_id, list_distinct(string_split(split_part(text, chr(10), 1), '')) AS a, list_distinct(string_split('{FIXED}', '')) AS b, text FROM documents)
  SELECT doc_id, CASE WHEN split_part(text, chr(10), 1) = '' THEN 0.0e0 ELSE round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) END AS similarity FROM j""")
def st06_jaccard(spark, sf_dir):
    return views.entries(spark, sf_dir).select(F.col("pos").alias("doc_id"), F.round(char_jaccard("title", F.lit(FIXED)), 6).alias("similarity"))


MEETS = "lambda a: contains(a.content, x[1].content) OR contains(x[1].content, a.content)"


@query(f"""WITH one AS (SELECT source || '-' || lang AS category, doc_id % 2 AS kind, doc_id, text AS content, CASE WHEN doc_id % 2 = 0 THEN '2024-01-01T00:00:00Z' ELSE '{AS_OF}' END AS updated_at
    FROM documents WHERE doc_id % 2 = 0 OR text <> ''),
  folded AS (SELECT category, list_reduce(list([{{'kind': kind, 'content': content, 'updated_at': updated_at, 'stale': false}}] ORDER BY kind, doc_id), lambda acc, x:
    CASE WHEN x[1].kind = 0 OR len(list_filter(acc, {MEETS})) = 0 THEN list_concat(acc, x)
      ELSE list_concat(list_concat(acc[1:list_position(list_transform(acc, {MEETS}), true) - 1], x), acc[list_position(list_transform(acc, {MEETS}), true) + 1:]) END) AS kept FROM one GROUP BY category)
  SELECT category, i - 1 AS pos, kept[i].content AS content, kept[i].updated_at AS updated_at, kept[i].stale AS stale FROM folded, LATERAL (SELECT unnest(generate_series(1, len(kept))) AS i)""")
def mg01_profile_merge(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    rows = d.select(F.concat_ws("-", "source", "lang").alias("category"), F.col("doc_id").alias("seq"), F.col("text").alias("content"))
    old = rows.where("seq % 2 = 0").select("category", F.col("seq").alias("pos"), "content", F.lit("2024-01-01T00:00:00Z").alias("updated_at"), F.lit(False).alias("stale"))
    return memory.merge_profile(old, rows.where("seq % 2 = 1"), AS_OF)


SIMILARITY = "len(list_intersect(list_distinct(string_split(t.title, '')), list_distinct(string_split(e.title, '')))) / CAST(len(list_distinct(list_concat(string_split(t.title, ''), string_split(e.title, '')))) AS DOUBLE)"


@query(f"""WITH {ENTRIES}, inc AS (SELECT slug, arg_max(title, pos) AS title, 'new' AS task FROM ent GROUP BY slug),
  hit AS (SELECT e.slug, min(e.pos) AS pos FROM ent e JOIN inc t USING (slug) WHERE t.title <> '' AND e.title <> '' AND {SIMILARITY} > 0.8e0 GROUP BY 1),
  merged AS (SELECT e.slug, e.pos, e.title, CASE WHEN h.pos IS NOT NULL THEN 'new' ELSE lang END AS task, CASE WHEN h.pos IS NOT NULL THEN '{AS_OF}' ELSE date END AS date, CASE WHEN h.pos IS NOT NULL THEN 0 ELSE days END AS days
    FROM ent e LEFT JOIN hit h ON h.slug = e.slug AND h.pos = e.pos
    UNION ALL SELECT slug, -1, title, task, '{AS_OF}', 0 FROM inc WHERE slug NOT IN (SELECT slug FROM hit)),
  cap AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY pos, title) - 1 AS n FROM merged)
  SELECT slug, n AS pos, title, task, date FROM cap WHERE n < 10 AND days < 90""")
def mg02_topic_merge(spark, sf_dir):
    e = views.entries(spark, sf_dir)
    inc = e.groupBy("slug").agg(F.max_by("title", "pos").alias("title")).withColumn("task", F.lit("new"))
    return memory.merge_topics(e.select("slug", "pos", "title", F.col("lang").alias("task"), "date"), inc, AS_OF)


@query(f"WITH {ENTRIES} SELECT pos, days > 90 AS stale, CASE WHEN days > 90 THEN 0.5e0 ELSE 1.0e0 END AS confidence FROM ent")
def mg03_stale(spark, sf_dir):
    p = views.entries(spark, sf_dir).select("pos", F.col("date").alias("updated_at"), F.lit(False).alias("stale"), F.lit(1.0).alias("confidence"))
    return memory.mark_stale(p, AS_OF).select("pos", "stale", "confidence")


@query(f"""WITH {TOPICS}, n AS (SELECT source AS slug, count(*) AS c FROM documents GROUP BY 1)
  SELECT slug, CASE WHEN topic_pos % 3 > 0 THEN topic_pos ELSE -1 END AS pos, CASE WHEN topic_pos % 3 < 2 THEN 'new ' || slug ELSE title END AS title, CASE WHEN topic_pos % 3 < 2 THEN c ELSE 1 END AS entry_count FROM top JOIN n USING (slug)""")
def mg04_index(spark, sf_dir):
    t = views.topics(spark, sf_dir)
    index = t.where("topic_pos % 3 > 0").select("slug", F.col("topic_pos").alias("pos"), "title", "keywords", F.lit(1).cast("bigint").alias("entry_count"))
    n = views.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("slug")).agg(F.count("*").alias("entry_count"))
    changed = t.where("topic_pos % 3 < 2").join(n, "slug").select("slug", F.concat(F.lit("new "), "slug").alias("title"), "keywords", "entry_count")
    return memory.upsert_index(index, changed).select("slug", F.coalesce("pos", F.lit(-1).cast("bigint")).alias("pos"), "title", "entry_count")


@query("SELECT source AS session_id, max(doc_id) AS seq, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source")
def mg06_consolidate(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("seq"), "lang")
    return memory.consolidate(d)


@query(f"WITH {ENTRIES} SELECT slug, n AS pos, title FROM (SELECT slug, row_number() OVER (PARTITION BY slug ORDER BY pos, title) - 1 AS n, title FROM ent) WHERE n < 10")
def wn07_cap(spark, sf_dir):
    return memory.newest(views.entries(spark, sf_dir).select("slug", "pos", "title"))


@query(f"""WITH {ENTRIES} SELECT slug, pos FROM (SELECT slug, pos, sum(length(left(text, 500))) OVER (PARTITION BY slug ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM ent) WHERE used <= 3000""")
def wn03_inject(spark, sf_dir):
    e = views.entries(spark, sf_dir)
    return history.budget(e, ["slug"], "pos", F.length(F.left("text", F.lit(500))), 3000, overshoot=False).select("slug", "pos")


@query(f"""WITH {ENTRIES}, items AS (SELECT slug AS "user", list({{'used': 0::BIGINT, 'shut': -1::BIGINT, 'cat': pos % 7, 'lines': ['## c' || pos % 7, '- ' || CASE WHEN pos % 5 = 0 THEN '⚠️ [可能已过时] ' ELSE '' END || title]}} ORDER BY pos % 7, pos) AS xs FROM ent GROUP BY 1),
  folded AS (SELECT "user", list_reduce(list_prepend({{'used': 0::BIGINT, 'shut': -1::BIGINT, 'cat': -1::BIGINT, 'lines': ['', ''][1:0]}}, xs), lambda a, x: {{
    'used': CASE WHEN a.shut <> x.cat AND NOT (x.cat <> a.cat AND a.used > 1000) AND a.used + length(x.lines[2]) <= 1000 THEN a.used + length(x.lines[2]) ELSE a.used END,
    'shut': CASE WHEN a.shut <> x.cat AND NOT (x.cat <> a.cat AND a.used > 1000) AND a.used + length(x.lines[2]) <= 1000 THEN a.shut ELSE x.cat END,
    'cat': x.cat,
    'lines': list_concat(list_concat(a.lines, CASE WHEN x.cat <> a.cat AND a.used <= 1000 THEN [x.lines[1]] ELSE x.lines[1:0] END),
      CASE WHEN a.shut = x.cat OR x.cat <> a.cat AND a.used > 1000 THEN x.lines[1:0] WHEN a.used + length(x.lines[2]) <= 1000 THEN [x.lines[2]] ELSE ['- (...更多偏好已省略)'] END)}}) AS f FROM items)
  SELECT "user", array_to_string(f.lines, chr(10)) AS block FROM folded""")
def wn04_profile_block(spark, sf_dir):
    e = views.entries(spark, sf_dir)
    rows = e.select(F.col("slug").alias("user"), (F.col("pos") % 7).alias("cat_pos"), F.concat(F.lit("c"), (F.col("pos") % 7).cast("string")).alias("category"), "pos", F.col("title").alias("content"), (F.col("pos") % 5 == 0).alias("stale"))
    return memory.profile_block(rows)


@query(f"WITH {TOPICS} SELECT slug, array_to_string(list_sort(list_distinct(list_concat(keywords, ['aaa', 'enthing']))), ',') AS keywords FROM top")
def ag11_keyword_union(spark, sf_dir):
    return views.topics(spark, sf_dir).select("slug", F.array_join(memory.merge_keywords(F.col("keywords"), F.array(F.lit("aaa"), F.lit("enthing"))), ",").alias("keywords"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS short FROM documents")
def tk07_caps(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", ellipsis("text", 100).alias("short"))


@query("SELECT doc_id, trim(left(text, 200), ' ') AS summary FROM documents")
def pa05_summary(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", summary("text").alias("summary"))


@query("""SELECT doc_id, lang AS category, 'a' || source AS content, doc_id % 2 = 0 AS stale FROM documents
  UNION ALL SELECT doc_id, lang, 'second', false FROM documents""")
def pa01_profile(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    mark = F.when(F.col("doc_id") % 2 == 0, F.lit("⚠️ ")).otherwise(F.lit(""))
    body = F.concat(F.lit("intro\n- lost\n## "), "lang", F.lit("\n- "), mark, F.lit("a"), "source", F.lit("\ntext\n* second\n"))
    return profile_rows(d.select("doc_id", body.alias("body")), "doc_id").select("doc_id", "category", "content", "stale")


@query("SELECT doc_id, 0 AS pos, '2024-01-02' AS date, source AS title, lang AS task, 'first\nsecond' AS lessons FROM documents")
def pa02_topic_entries(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    body = F.concat(F.lit("# T\n\n### 2024-01-02 — "), "source", F.lit("\n- **任务**: "), "lang", F.lit("\n- **经验**: \n  first\n  second\n"))
    return topic_rows(d.select("doc_id", body.alias("body")), "doc_id").select("doc_id", "pos", "date", "title", "task", "lessons")


LINES = """raw AS (SELECT doc_id, '# ' || source || chr(10) || '## ' || lang || chr(10) || '## part' || chr(10) || '- one' || chr(10) || chr(9) || '- two' || chr(10) || '### page' || chr(10) || coalesce(text, '') AS body FROM documents),
  cut AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM raw),
  lines AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS s FROM cut WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
  kinds AS (SELECT *, CASE WHEN s IN ('---', '***', '___') THEN 'rule' WHEN starts_with(s, '# ') AND n = 1 THEN 'title' WHEN n = 2 THEN 'subtitle' WHEN starts_with(s, '## ') THEN 'section' WHEN starts_with(s, '### ') THEN 'content' ELSE 'item' END AS part FROM lines),
  marked AS (SELECT *, part IN ('title', 'section', 'content') AS headed, lag(part) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM kinds),
  numbered AS (SELECT *, sum(CASE WHEN headed OR part = 'item' AND before = 'rule' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS slide FROM marked),
  placed AS (SELECT *, count(*) FILTER (part = 'item') OVER w AS items, count(*) FILTER (part = 'item') OVER (PARTITION BY doc_id, slide ORDER BY n) - 1 AS item, max(CASE WHEN headed THEN part END) OVER w AS slide_type,
    max(CASE WHEN headed THEN trim(regexp_replace(s, '^#+ ', ''), ' ') END) OVER w AS title, max(CASE WHEN part = 'subtitle' THEN trim(s[4:], ' ') END) OVER w AS subtitle FROM numbered WHERE part <> 'rule' WINDOW w AS (PARTITION BY doc_id, slide))"""


@query(f"""WITH {LINES} SELECT doc_id, CAST(slide AS INTEGER) AS slide_no, CASE WHEN part = 'item' THEN CAST(item AS INTEGER) ELSE -1 END AS item_no, coalesce(slide_type, 'content') AS slide_type, coalesce(title, '') AS title, coalesce(subtitle, '') AS subtitle,
    CASE WHEN part <> 'item' THEN NULL WHEN regexp_matches(s, '^[-*]\\s') THEN 'bullet' WHEN regexp_matches(s, '^\\d+[.)]\\s+.') THEN 'numbered' WHEN starts_with(s, '> ') THEN 'quote' WHEN regexp_matches(s, '^!\\[[^\\]]*\\]\\([^)]+\\)$') THEN 'image' ELSE 'paragraph' END AS type,
    CASE WHEN part <> 'item' THEN NULL WHEN regexp_matches(s, '^[-*]\\s') THEN regexp_replace(s, '^[-*]\\s+', '') WHEN regexp_matches(s, '^\\d+[.)]\\s+.') THEN regexp_replace(s, '^\\d+[.)]\\s+', '') WHEN starts_with(s, '> ') THEN trim(s[3:], ' ')
      WHEN regexp_matches(s, '^!\\[[^\\]]*\\]\\([^)]+\\)$') THEN regexp_extract(s, '\\(([^)]+)\\)$', 1) ELSE s END AS text,
    CASE WHEN part = 'item' AND regexp_matches(s, '^[-*]\\s') THEN CAST((length(regexp_extract(line, '^[ \\t]*')) + length(regexp_replace(regexp_extract(line, '^[ \\t]*'), ' ', '', 'g'))) // 2 AS INTEGER) ELSE -1 END AS level
  FROM placed WHERE part = 'item' OR headed AND items = 0""")
def pa11_slides(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    body = F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n## part\n- one\n\t- two\n### page\n"), F.coalesce("text", F.lit("")))
    return slide_rows(d.select("doc_id", body.alias("body")), "doc_id").fillna(-1, ["item_no", "level"])

"""Markdown as rows: profiles, topic entries, front matter and slides."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import indent_level

# The labels of an entry's fields.
FIELDS = {"任务": "task", "方案": "approach", "经验": "lessons", "用户反馈": "user_feedback", "用户调整": "user_adjustment"}
EDGES = r"(?U)^\s+|\s+$"
# How lines of a deck begin.
MARKS = {
    "rule": r"^(?:---|\*\*\*|___)$",
    "h1": "^# (.*)",
    "h2": "^## (.*)",
    "h3": "^### (.*)",
    "bullet": r"^[-*]\s+(.*)",
    "numbered": r"^\d+[.)]\s+(.+)$",
    "quote": "^> (.*)",
    "image": r"^!\[[^\]]*\]\(([^)]+)\)$",
}
SLIDES = "slide_no int, item_no int, slide_type string, title string, subtitle string, type string, text string, level int"


def lines(docs: DataFrame, key: str, column: str = "body") -> DataFrame:
    """(key, line_no, line)."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(column, F.lit("")), "\n")).alias("line_no", "line"))


def numbered_lines(docs: DataFrame, key: str, column: str = "body") -> DataFrame:
    """(key, doc_row, line_no, line); doc_row tells documents apart that share a key."""
    rows = docs.select(key, F.monotonically_increasing_id().alias("doc_row"), F.split(F.coalesce(column, F.lit("")), "\n").alias("lines"))
    return rows.select(key, "doc_row", F.posexplode("lines").alias("line_no", "line"))


def segment(rows: DataFrame, marker: Column, name: str = "segment") -> DataFrame:
    """Adds the number of the segment that each line of its document belongs to: markers
    so far, 0 before the first."""
    so_far = Window.partitionBy("doc_row").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(marker.cast("int")).over(so_far))


def _joined(order: str, text: Column) -> Column:
    """Aggregate: the texts that are not null, in order, a line each."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(order, text.alias("t"))))), lambda x: x["t"]), "\n")


# How a profile's headings and items are written.
PROFILE_HEAD, PROFILE_ITEM = r"^##\s+(.+)", r"^[-*]\s+(?:⚠️\s*)?(.+)"


def profile_rows(docs: DataFrame, key: str, column: str = "body") -> DataFrame:
    """(key, category, pos, content, stale, confidence): items under their last heading.

    One profile is one document; its lines are rows, each read once.
    """
    lines = numbered_lines(docs, key, column)
    head, item = F.regexp_extract("line", PROFILE_HEAD, 1), F.trim(F.regexp_extract("line", PROFILE_ITEM, 1))
    so_far = Window.partitionBy("doc_row").orderBy("line_no")
    rows = lines.select(key, "doc_row", "line_no", F.when(head != "", F.trim(head)).alias("head"), item.alias("content"), F.col("line").contains("⚠️").alias("stale"))
    rows = rows.where("head is not null or content != ''").withColumn("category", F.last("head", ignorenulls=True).over(so_far))
    got = rows.where("head is null and category != ''").withColumn("pos", F.row_number().over(so_far).cast("long") - 1)
    return got.select(key, "category", "pos", "content", "stale", F.when(F.col("stale"), 0.5).otherwise(1.0).alias("confidence"))


def profile_text(items: DataFrame, key: str) -> DataFrame:
    """Profile rows back as markdown."""
    line = F.concat(F.lit("- "), F.when(F.col("stale"), "⚠️ ").otherwise(""), F.col("content"))
    cats = items.groupBy(key, "category").agg(F.min("pos").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("ls"))
    text = F.concat(F.lit("## "), F.col("category"), F.lit("\n"), F.col("ls"), F.lit("\n"))
    return cats.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", text.alias("t")))), lambda x: x["t"]), "\n").alias("body"))


def topic_text(title: str, entries: list[dict]) -> str:
    """A topic's markdown, in the form that ``topic_entries`` reads."""
    out = [f"# {title}", "", "## 记忆条目", ""]
    for e in entries:
        out += [f"### {e.get('date', '')} — {e.get('title', '')}"]
        for label, name in FIELDS.items():
            value = e.get(name) or ""
            if name == "lessons":
                out += [f"- **{label}**: ", *(f"  {x}" for x in value.split("\n"))]
            elif value or name in ("task", "approach"):
                out.append(f"- **{label}**: {value}")
        out.append("")
    return "\n".join(out)


def topic_rows(docs: DataFrame, key: str, column: str = "body") -> DataFrame:
    """(key, pos, date, title and the fields of FIELDS) of each entry of a topic's markdown.

    An entry goes from its heading "### date — title" to the next; a field goes from its
    labelled line to the next, and its further lines follow on, also where the first is
    empty. Of equal labels in one entry the last counts; entries without a title drop out.
    """
    rows = numbered_lines(docs, key, column)
    head, label = F.regexp_extract("line", r"^###\s+(.+)", 1), F.regexp_extract("line", r"^[-*]\s+\*\*(.+?)\*\*:", 1)
    rows = rows.withColumns({"head": F.trim(head), "label": F.trim(label)})
    rows = segment(rows, F.col("head") != "", "entry")
    rows = segment(rows, (F.col("head") != "") | (F.col("label") != ""), "field").where("entry > 0")
    said = F.when(F.col("label") != "", F.regexp_extract("line", r"^[-*]\s+\*\*.+?\*\*:\s*(.*)", 1)).when(~F.col("line").startswith("#"), F.col("line"))
    rows = rows.withColumn("said", F.regexp_replace(said, EDGES, ""))
    parts = rows.groupBy(key, "doc_row", "entry", "field").agg(F.max("head").alias("head"), F.max("label").alias("label"), _joined("line_no", F.when(F.col("said") != "", F.col("said"))).alias("value"))
    cut = F.split("head", " — ", 2)
    made = parts.groupBy(key, "doc_row", "entry").agg(F.max("head").alias("head"), *(F.coalesce(F.max_by("value", F.when(F.col("label") == text, F.col("field"))), F.lit("")).alias(name) for text, name in FIELDS.items()))
    made = made.withColumns({"date": F.when(F.size(cut) == 2, cut[0]).otherwise(""), "title": F.element_at(cut, -1)}).where("title != ''")
    pos = F.row_number().over(Window.partitionBy("doc_row").orderBy("entry")) - 1
    return made.select(key, pos.alias("pos"), "date", "title", *FIELDS.values())


def _scalar(v: str):
    v = v.strip()
    if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'":
        return v[1:-1]
    if v.startswith("[") and v.endswith("]"):
        return [_scalar(x) for x in v[1:-1].split(",") if x.strip()]
    if re.fullmatch(r"-?\d+", v):
        return int(v)
    return {"true": True, "false": False, "null": None, "": None}.get(v, v)


def plain_yaml(text: str):
    """The YAML of front matter: keys with scalars or flat lists; the full parser where installed."""
    try:
        import yaml
    except ImportError:
        return {k.strip(): _scalar(v) for k, _, v in (x.partition(":") for x in text.split("\n") if ":" in x and not x.startswith((" ", "#")))}
    return yaml.safe_load(text) or {}


#: Head and body of a document: any fence at its very start, or one that has its lines to itself.
FENCED = {
    False: re.compile(r"---(?P<head>.*?)---(?P<body>.*)", re.S),
    True: re.compile(r"---\s*\n(?P<head>.*?)\n---\s*\n?(?P<body>.*)", re.S),
}


def front_matter(text: str, strict: bool = False) -> tuple[dict, str]:
    """(front matter, body). Lenient: without one, all is body; strict: that is an error."""
    found = FENCED[strict].match(text)
    if found:
        return plain_yaml(found["head"]), found["body"].strip()
    if strict:
        raise ValueError("no front matter")
    return {}, text


def skill(text: str) -> dict:
    """A skill document: name, type and description are needed, type is builtin or user."""
    meta, body = front_matter(text, strict=True)
    for k in ("name", "type", "description"):
        if not meta.get(k):
            raise ValueError(f"skill without {k}")
    if meta["type"] not in ("builtin", "user"):
        raise ValueError(f"unknown skill type {meta['type']}")
    return meta | {"tools": meta.get("tools") or [], "max_iterations": meta.get("max_iterations") or 10, "body": body}


def slide_rows(docs: DataFrame, key: str, column: str = "body") -> DataFrame:
    """The slides of each document as rows: key and the columns of ``SLIDES``.

    Lines are told apart by their marks (``MARKS``); a slide begins at a heading, or at
    a line with no slide open: the first, or one after a rule. The first "#" is the
    deck's title, a "##" right below it the subtitle, later "#" lines are text. A slide
    without items has one row with item_no null.
    """
    rows = numbered_lines(docs, key, column).withColumn("text", F.regexp_replace("line", EDGES, "")).where("text != ''")
    kind = F.lit("paragraph")
    for name, mark in reversed(MARKS.items()):
        kind = F.when(F.col("text").rlike(mark), name).otherwise(kind)
    order = Window.partitionBy("doc_row").orderBy("line_no")
    first = F.min(F.when(F.col("kind") == "h1", F.col("line_no"))).over(Window.partitionBy("doc_row"))
    rows = rows.withColumn("kind", kind).withColumn("first", first)
    title = F.col("line_no").eqNullSafe(F.col("first"))
    after_title = F.lag("line_no").over(order).eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    part = F.when(title, "title").when((F.col("kind") == "h2") & after_title, "subtitle").when(F.col("kind") == "h2", "section").when(F.col("kind") == "h3", "content").when(F.col("kind") == "rule", "rule").otherwise("item")
    rows = rows.withColumn("part", part)
    loose = (F.col("part") == "item") & F.coalesce(F.lag("part").over(order) == "rule", F.lit(True))
    headed = F.col("part").isin("title", "section", "content")
    rows = segment(rows.withColumn("loose", loose), headed | F.col("loose"), "slide").where("slide > 0 and part != 'rule'")
    inner = lambda mark: F.regexp_replace(F.regexp_extract("text", mark, 1), EDGES, "")
    own = F.col("text")
    for name, mark in MARKS.items():
        if name not in ("rule", "h1"):
            own = F.when(F.col("kind") == name, inner(mark)).otherwise(own)
    own = F.when((F.col("kind") == "h1") & (F.col("part") == "title"), inner(MARKS["h1"])).otherwise(own)
    rows = rows.withColumn("own", own)
    slide = Window.partitionBy("doc_row", "slide")
    of = lambda *parts: F.max(F.when(F.col("part").isin(*parts), F.col("own"))).over(slide)
    is_item = F.col("part") == "item"
    rows = rows.withColumns({
        "slide_type": F.coalesce(F.max(F.when(headed, F.col("part"))).over(slide), F.lit("content")),
        "title": F.coalesce(of("title", "section", "content"), F.lit("")),
        "subtitle": F.coalesce(of("subtitle"), F.lit("")),
        "items": F.count_if(is_item).over(slide),
        "nth": F.count_if(is_item).over(slide.orderBy("line_no")),
    })
    rows = rows.where(is_item | (headed & (F.col("items") == 0)))
    mine = lambda c: F.when(is_item, c)
    kind = F.when(F.col("kind") == "h1", "paragraph").otherwise(F.col("kind"))
    return rows.select(
        key,
        (F.col("slide") - 1).cast("int").alias("slide_no"),
        mine(F.col("nth") - 1).cast("int").alias("item_no"),
        "slide_type",
        "title",
        "subtitle",
        mine(kind).alias("type"),
        mine(F.col("own")).alias("text"),
        F.when(is_item & (F.col("kind") == "bullet"), indent_level("line")).alias("level"),
    )


def front_matter_rows(docs: DataFrame, key: str, column: str = "body") -> DataFrame:
    """(key, meta, body): front matter as texts by name (empty without one), and what follows it."""
    return _parsed(docs, key, column, front_matter, lambda found: {"meta": {k: None if v is None else str(v) for k, v in found[0].items()}, "body": found[1]}, "meta map<string,string>, body string, error string")


def skill_rows(docs: DataFrame, key: str, column: str = "body") -> DataFrame:
    """(key, name, type, description, max_iterations, body, error): skill documents; a broken one has only its error."""
    take = lambda s: {"name": str(s["name"]), "type": s["type"], "description": str(s["description"]), "max_iterations": int(s["max_iterations"]), "body": s["body"]}
    return _parsed(docs, key, column, skill, take, "name string, type string, description string, max_iterations bigint, body string, error string")


def _parsed(docs, key, column, parse, take, shape):
    kinds = dict(docs.dtypes)
    names = [c.split()[0] for c in shape.split(", ")]

    def run(batches):
        for part in batches:
            rows = []
            for k, doc in zip(part[key], part[column], strict=True):
                try:
                    rows.append(dict.fromkeys(names) | {key: k, **take(parse(doc or ""))})
                except ValueError as e:
                    rows.append(dict.fromkeys(names) | {key: k, "error": str(e)})
            yield pd.DataFrame(rows, columns=[key, *names]).astype(object)

    return docs.select(key, column).mapInPandas(run, f"{key} {kinds[key]}, {shape}")

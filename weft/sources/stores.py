"""Stores of sessions, memory and configuration, as files that Spark reads and writes."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.markdown import FIELDS, plain_yaml, profile_rows, profile_text, topic_rows, topic_text
from weft.operators.messages import decode_document, encode_document
from weft.operators.policy import Policy
from weft.sources import files


# Sessions: one JSON document each.


def write_sessions(messages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Session documents under session_id=...; Spark's commit makes each write whole or nothing."""
    docs = encode_document(messages).withColumn("part", F.pmod(F.xxhash64("session_id"), F.lit(64)))
    docs.select("part", F.col("document").alias("value")).write.mode(mode).partitionBy("part").text(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return decode_document(spark.read.text(path).select(F.col("value").alias("document")))


def list_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Summaries of readable documents, newest file first."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("modified"))
    d = F.try_parse_json("value")
    rows = raw.where(d.isNotNull()).select(F.get_json_object("value", "$.session_id").alias("session_id"), F.get_json_object("value", "$.status").alias("status"), F.left(F.get_json_object("value", "$.messages[0].content"), F.lit(100)).alias("preview"), "modified")
    return rows.where("session_id is not null").orderBy(F.desc("modified"), "session_id")


# Memory: markdown with front matter, and an index.


def write_profiles(items: DataFrame, path: str, key: str = "user") -> None:
    profile_text(items, key).write.mode("overwrite").json(path)


def read_profiles(spark: SparkSession, path: str, key: str = "user") -> DataFrame:
    return profile_rows(spark.read.schema(f"{key} string, body string").json(path), key)


def write_topics(topics: DataFrame, entries: DataFrame, path: str) -> None:
    """One markdown body a topic (a topic holds ten entries at most)."""
    one = F.struct("pos", *[F.col(c) for c in ("date", "title", *FIELDS.values())])
    rows = entries.groupBy("slug").agg(F.array_sort(F.collect_list(one)).alias("es")).join(topics.select("slug", F.col("title").alias("topic")), "slug")

    def run(batches):
        for part in batches:
            part["body"] = [topic_text(t, [dict(e.items()) if isinstance(e, dict) else e.asDict() for e in es]) for t, es in zip(part["topic"], part["es"], strict=True)]
            yield part[["slug", "topic", "body"]]

    rows.mapInPandas(run, "slug string, topic string, body string").write.mode("overwrite").json(path)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    return topic_rows(spark.read.schema("slug string, topic string, body string").json(path), "slug")


def archive_entries(entries: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes to the archive) by a table of (slug, pos)."""
    keys = asked.select("slug", "pos").distinct()
    return entries.join(keys, ["slug", "pos"], "left_anti").select(*entries.columns), entries.join(keys, ["slug", "pos"], "left_semi").select(*entries.columns)


def archive_entry(entries: DataFrame, slug: str, pos: int) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes to the archive)."""
    hit = F.coalesce((F.col("slug") == slug) & (F.col("pos") == pos), F.lit(False))
    return entries.where(~hit), entries.where(hit)


INDEX = "slug string, pos bigint, title string, keywords array<string>, entry_count int, embedding array<float>"


def write_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index; broken rows drop out, a missing one is empty."""
    if files.kind(spark, path) == "none":
        return spark.createDataFrame([], INDEX)
    raw = spark.read.schema(INDEX + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.where("_corrupt_record is null and slug is not null").drop("_corrupt_record")


# Configuration on the driver.


@dataclass
class SessionConfig:
    context_window_tokens: int = 65_536
    normal_threshold: float = 0.6
    aggressive_threshold: float = 0.8
    keep_recent_turns: int = 3


def load_yaml(path: str, default: Any = None) -> Any:
    p = Path(path)
    return plain_yaml(p.read_text("utf-8")) if p.exists() else default


def load_policies(path: str) -> list[Policy]:
    """The ordered policies of a file; a missing file has none, a missing effect denies."""
    found = load_yaml(path, {}) or {}
    rows = found.get("policies", []) if isinstance(found, dict) else found
    return [Policy(str(r.get("subject", "*")), str(r.get("action", "*")), str(r.get("resource", "*")), str(r.get("effect", "deny"))) for r in rows]


def load_session_config(path: str) -> SessionConfig:
    found = load_yaml(path, {}) or {}
    flat = {k: v for part in [found, *(v for v in found.values() if isinstance(v, dict))] for k, v in part.items()}
    return SessionConfig(**{f.name: flat[f.name] for f in fields(SessionConfig) if f.name in flat})


def load_servers(path: str) -> dict[str, dict]:
    """Tool servers by name: a command with arguments, or a url."""
    p = Path(path)
    found = json.loads(p.read_text("utf-8")) if p.exists() else {}
    return {k: v for k, v in found.get("mcpServers", found).items() if isinstance(v, dict) and ("command" in v or "url" in v)}


def server_rows(configs: DataFrame, column: str = "content") -> DataFrame:
    """(server, kind, command, args, url) of every usable server of many configurations, texts of JSON; broken ones have none."""
    shape = "map<string,struct<command:string,args:array<string>,url:string>>"
    wrapped = F.from_json(column, f"struct<mcpServers:{shape}>")["mcpServers"]
    each = configs.select(F.explode(F.coalesce(wrapped, F.from_json(column, shape))).alias("server", "s")).select("server", "s.*")
    kind = F.when(F.col("command").isNotNull(), "command").when(F.col("url").isNotNull(), "url")
    return each.withColumn("kind", kind).where("kind is not null").select("server", "kind", "command", "args", "url")


def filled(rows: DataFrame, templates: DataFrame, values: dict[str, str], builtin: dict[str, str]) -> DataFrame:
    """Adds text: each row's template (column template) with ``{name}`` replaced by the columns in ``values``.

    ``templates``: template, content; names that it lacks fall back to ``builtin``.
    """
    own = F.create_map(*(F.lit(x) for kv in builtin.items() for x in kv)) if builtin else F.create_map().cast("map<string,string>")
    text = F.coalesce("content", F.try_element_at(own, F.col("template")))
    for name, column in values.items():
        text = F.replace(text, F.lit(f"{{{name}}}"), F.col(column))
    return rows.join(templates.select("template", "content"), "template", "left").withColumn("text", text).drop("content")


class Prompts:
    """Prompt templates: file, then cache, then built-in text; ``{name}`` is filled in."""

    def __init__(self, folder: str, builtin: dict[str, str] | None = None):
        self.folder, self.builtin, self.cache = Path(folder), builtin or {}, {}

    def load(self, name: str) -> str:
        if name not in self.cache:
            p = self.folder / f"{name}.txt"
            if p.exists():
                self.cache[name] = p.read_text("utf-8")
            elif name in self.builtin:
                self.cache[name] = self.builtin[name]
            else:
                raise KeyError(f"no prompt {name}")
        return self.cache[name]

    def fill(self, template: str, /, **values) -> str:
        text = self.load(template)
        try:
            return text.format(**values)
        except (KeyError, IndexError) as e:
            return f"{text}\n[warning: no value for {e}]"

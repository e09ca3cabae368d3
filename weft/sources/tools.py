"""Tools of other servers as a Spark data source, and their registration.

A catalog is a JSON file {server: {"tools": [{"name", "description", "inputSchema"}]}},
as servers answer when asked what they offer; ``risks`` may name a risk for a tool.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SHAPE = "server string, name string, full_name string, description string, risk string, parameters string"


class Server(InputPartition):
    def __init__(self, name: str, answer: dict):
        super().__init__(name)
        self.name, self.answer = name, answer


class ToolCatalog(DataSource):
    """``spark.read.format("weft_tools").option("catalog", text).load()``; a server a task."""

    @classmethod
    def name(cls) -> str:
        return "weft_tools"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema):
        return _Reader(self.options.get("catalog", "{}"))


class _Reader(DataSourceReader):
    def __init__(self, catalog: str):
        self.catalog = catalog

    def partitions(self):
        return [Server(k, v) for k, v in sorted(json.loads(self.catalog).items())]

    def read(self, partition):
        risks = partition.answer.get("risks", {})
        for t in partition.answer.get("tools", []):
            yield partition.name, t["name"], f"mcp__{partition.name}__{t['name']}", t.get("description") or f"MCP: {t['name']} ({partition.name})", risks.get(t["name"], "high"), json.dumps(_parameters(t.get("inputSchema", {})), sort_keys=True)


def _parameters(schema: dict) -> list[dict]:
    need = set(schema.get("required", []))
    kind = lambda s: ", ".join(k for k in s if k != "null") if isinstance(s, list) else str(s)
    return [{"name": k, "type": kind(s.get("type", "string")), "required": k in need} for k, s in schema.get("properties", {}).items()]


def discover(spark: SparkSession, catalog: str):
    """The tools of a catalog (JSON text) as rows."""
    spark.dataSource.register(ToolCatalog)
    return spark.read.format("weft_tools").option("catalog", catalog).load()


def register_all(rows, tools, call: Callable[[str, str, dict], str]) -> int:
    """Add discovered tools to a registry; ``call(server, name, arguments)`` reaches the server."""
    from weft.operators.registry import Tool

    found = rows.orderBy("full_name").collect()  # a catalog, known to the driver already
    for r in found:
        tools.add(Tool(r["full_name"], r["description"], lambda server=r["server"], name=r["name"], **args: call(server, name, args), r["risk"], "string", json.loads(r["parameters"])))
    return len(found)

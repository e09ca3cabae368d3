"""Event-stream text (``text/event-stream``) as a streaming source and sink.

The sink writes each task's events of a micro-batch to a file of its own; when all are
there, the batch's manifest is written, which names them. A batch that is run again finds
its manifest and throws its new files away. The source reads only what manifests name; its
offset is the number of the last batch it took. So whatever is restarted, no event is lost
and none comes twice.

An event has an id, a name and data; the lines of data become ``data:`` fields, an empty
line ends the event. Comments (lines that start with a colon, such as heartbeats), unknown
fields and events without data are skipped. Paths are what pyarrow's file systems reach:
local or mounted folders, and hdfs:// or s3:// where their libraries are installed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

SHAPE = "id string, event string, data string"
MANIFESTS = "_batches"


def encode(id_: str | None, event: str | None, data: str | None) -> str:
    """One event as text."""
    head = [f"{k}: {' '.join((v or '').splitlines())}" for k, v in (("id", id_), ("event", event))]
    return "\n".join([*head, *(f"data: {x}" for x in (data or "").split("\n")), "", ""])


def decode(lines: Iterable[str]) -> Iterator[tuple[str | None, str, str]]:
    """(id, event, data) of each event; the last id holds on until another or an empty one, the name is "message" unless given."""
    id_, event, data = None, "", []
    for line in lines:
        if not line:
            if data:
                yield id_, event or "message", "\n".join(data)
            event, data = "", []
            continue
        name, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if name == "data":
            data.append(value)
        elif name == "event":
            event = value
        elif name == "id":
            id_ = value or None


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _batches(path: str) -> list[int]:
    where, base = _open(path)
    found = where.get_file_info(fs.FileSelector(f"{base}/{MANIFESTS}", allow_not_found=True))
    return sorted(int(f.base_name) for f in found if f.base_name.isdigit())


@dataclass
class Written(WriterCommitMessage):
    file: str | None


@dataclass
class Segment(InputPartition):
    file: str


class EventStream(DataSource):
    """``format("weft_events")`` with option ``path``; columns id, event and data."""

    @classmethod
    def name(cls) -> str:
        return "weft_events"

    def schema(self) -> str:
        return SHAPE

    def streamReader(self, schema):
        return _Reader(self.options["path"])

    def streamWriter(self, schema, overwrite):
        return _Writer(self.options["path"], [f.name for f in schema.fields])


class _Writer(DataSourceStreamWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.at = path, [columns.index(c) for c in ("id", "event", "data")]

    def write(self, iterator) -> Written:
        where, base = _open(self.path)
        where.create_dir(base)
        name, out = f"{uuid.uuid4().hex}.sse", None
        for row in iterator:
            out = out or where.open_output_stream(f"{base}/{name}")
            out.write(encode(*(row[i] for i in self.at)).encode())
        if out:
            out.close()
        return Written(name if out else None)

    def commit(self, messages, batchId: int) -> None:
        where, base = _open(self.path)
        where.create_dir(f"{base}/{MANIFESTS}")
        if batchId in _batches(self.path):
            self.abort(messages, batchId)
            return
        part = f"{base}/{MANIFESTS}/{batchId}.{uuid.uuid4().hex}"
        with where.open_output_stream(part) as out:
            out.write(json.dumps([m.file for m in messages if m and m.file]).encode())
        where.move(part, f"{base}/{MANIFESTS}/{batchId}")

    def abort(self, messages, batchId: int) -> None:
        where, base = _open(self.path)
        for m in messages:
            if m and m.file:
                where.delete_file(f"{base}/{m.file}")


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        return {"batch": max(_batches(self.path), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        where, base = _open(self.path)
        out = []
        for n in _batches(self.path):
            if start["batch"] < n <= end["batch"]:
                with where.open_input_stream(f"{base}/{MANIFESTS}/{n}") as f:
                    out += [Segment(x) for x in json.loads(f.read())]
        return out

    def read(self, partition: Segment):
        where, base = _open(self.path)
        with where.open_input_stream(f"{base}/{partition.file}") as f:
            yield from decode(_lines(f))


def _lines(f) -> Iterator[str]:
    """Lines of a file, a piece of it in memory at a time."""
    rest = b""
    while piece := f.read(1 << 20):
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            yield line.decode()
    if rest:
        yield rest.decode()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventStream)

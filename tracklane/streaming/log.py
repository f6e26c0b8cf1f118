"""A log of keyed messages in shared folders, as a data source: df.write / df.writeStream / spark.read / spark.readStream
.format("messages").

A topic is a folder with a folder for each partition, whose files hold messages as lines of JSON and are named by their
first offset and their number of messages; a key's messages share a partition and keep their order. Readers plan by offsets, and what a group has finished is
kept beside the topics, so a reading can be started again from any place. It stands where a broker's connector is absent; the messages are the same.

Files are opened by pyarrow's file systems, as those of the data source of arrays.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator, Sequence

from pyarrow import fs as files
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..sources.arrays import opened

MESSAGE = "key string, value string, topic string, partition int, offset bigint"
#: Messages of a file that a task writes.
LINES = 100_000


def _files(f: files.FileSystem, folder: str) -> list[tuple[int, int, str]]:
    """(first offset, messages, path) of a partition's files, in order."""
    found = f.get_file_info(files.FileSelector(folder, allow_not_found=True))
    names = [x for x in found if x.base_name.endswith(".jsonl")]
    return sorted((int(x.base_name[:20]), int(x.base_name[21:31]), x.path) for x in names)


def ends(path: str, topics: list[str]) -> dict[str, dict[str, int]]:
    """The next offset of each partition of each topic."""
    f, root = opened(path)
    out: dict[str, dict[str, int]] = {}
    for t in topics:
        parts = [x.base_name for x in f.get_file_info(files.FileSelector(f"{root}/{t}", allow_not_found=True)) if x.base_name.isdigit()]
        out[t] = {p: (last[-1][0] + last[-1][1] if (last := _files(f, f"{root}/{t}/{p}")) else 0) for p in sorted(parts, key=int)}
    return out


class Span(InputPartition):
    def __init__(self, topic: str, partition: int, first: int, end: int, path: str, base: int):
        self.topic, self.partition, self.first, self.end, self.path, self.base = topic, partition, first, end, path, base


def spans(path: str, start: dict, end: dict) -> list[Span]:
    """A part to read for each file that has messages from start to end."""
    f, root = opened(path)
    out = []
    for t, parts in end.items():
        for p, last in parts.items():
            first = start.get(t, {}).get(p, 0)
            if first < last:
                out += [Span(t, int(p), max(first, base), min(last, base + n), where, base) for base, n, where in _files(f, f"{root}/{t}/{p}") if base < last and base + n > first]
    return out


def lines(path: str, span: Span) -> Iterator[tuple]:
    f, _ = opened(path)
    with f.open_input_stream(span.path) as s:
        for k, line in enumerate(s.read().decode("utf-8").splitlines()):
            if span.first <= span.base + k < span.end:
                m = json.loads(line)
                yield m["key"], m["value"], span.topic, span.partition, span.base + k


class BatchReader(DataSourceReader):
    def __init__(self, path: str, topics: list[str]):
        self.path, self.topics = path, topics

    def partitions(self) -> Sequence[InputPartition]:
        return spans(self.path, {}, ends(self.path, self.topics))

    def read(self, partition: Span) -> Iterator[tuple]:
        return lines(self.path, partition) if partition is not None else iter(())


class StreamReader(DataSourceStreamReader):
    """Offsets are those of Spark's checkpoint; a new query starts at the earliest, the latest or where its group has
    come to. A batch takes at most so many messages of a partition. Spark doesn't tell a source where it starts again
    before it asks how far to go, so a group's plan is kept beside the log: what a group goes on from is never
    before what it has planned."""

    def __init__(self, path: str, topics: list[str], group: str | None, starting: str, most: int | None):
        self.path, self.topics, self.group, self.starting, self.most = path, topics, group, starting, most
        self.planned: dict | None = None

    def _told(self, kind: str) -> dict | None:
        """What is kept of the group: its plan, or what it has finished."""
        if not self.group:
            return None
        f, root = opened(self.path)
        name = f"{root}/_groups/{self.group}.{kind}"
        return json.loads(f.open_input_stream(name).read()) if f.get_file_info(name).type == files.FileType.File else None

    def _keep(self, kind: str, offsets: dict) -> None:
        if self.group:
            f, root = opened(self.path)
            f.create_dir(f"{root}/_groups", recursive=True)
            with f.open_output_stream(f"{root}/_groups/{self.group}.{kind}") as s:
                s.write(json.dumps(offsets).encode())

    def initialOffset(self) -> dict:
        now = ends(self.path, self.topics)
        if self.starting == "latest":
            return now
        told = (self._told("done") or {}) if self.starting == "group" else {}
        return {t: {p: told.get(t, {}).get(p, 0) for p in parts} for t, parts in now.items()}

    def latestOffset(self) -> dict:
        now = ends(self.path, self.topics)
        if self.most is not None:
            at = self.planned or self._told("plan") or self.initialOffset()
            now = {t: {p: min(n, at.get(t, {}).get(p, 0) + self.most) for p, n in parts.items()} for t, parts in now.items()}
            self._keep("plan", now)
        self.planned = now
        return now

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return spans(self.path, start, end)

    def read(self, partition: Span) -> Iterator[tuple]:
        return lines(self.path, partition)

    def commit(self, end: dict) -> None:
        self._keep("done", end)


class Staged(WriterCommitMessage):
    def __init__(self, parts: list[tuple[int, str, int]]):
        self.parts = parts


class _Writer:
    """Tasks stage files by partition; the commit gives them offsets, in the order of tasks."""

    def __init__(self, path: str, topic: str, partitions: int):
        self.path, self.topic, self.partitions, self.job = path, topic, partitions, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        f, root = opened(self.path)
        folder = f"{root}/_staged/{self.job}"
        f.create_dir(folder, recursive=True)
        held: dict[int, list[str]] = {}
        parts: list[tuple[int, str, int]] = []

        def put(p: int) -> None:
            name = f"{folder}/{uuid.uuid4().hex}"
            with f.open_output_stream(name) as s:
                s.write("".join(held[p]).encode("utf-8"))
            parts.append((p, name, len(held.pop(p))))

        for key, value in iterator:
            # messages without a key are spread by what they say
            p = zlib.crc32((key if key is not None else value or "").encode("utf-8", "surrogatepass")) % self.partitions
            held.setdefault(p, []).append(json.dumps({"key": key, "value": value}) + "\n")
            if len(held[p]) >= LINES:
                put(p)
        for p in sorted(held):
            put(p)
        return Staged(parts)

    def _moves(self, messages: Sequence[Staged | None]) -> list[tuple[str, str]]:
        f, root = opened(self.path)
        at: dict[int, int] = {}
        out = []
        for p in range(self.partitions):
            f.create_dir(f"{root}/{self.topic}/{p}", recursive=True)
            last = _files(f, f"{root}/{self.topic}/{p}")
            at[p] = last[-1][0] + last[-1][1] if last else 0
        for m in messages:
            for p, name, n in m.parts if m else ():
                out.append((name, f"{root}/{self.topic}/{p}/{at[p]:020d}_{n:010d}.jsonl"))
                at[p] += n
        return out

    def _move(self, moves: list) -> None:
        f, _ = opened(self.path)
        for name, to in moves:
            if f.get_file_info(name).type == files.FileType.File:
                f.move(name, to)

    def _cleared(self) -> None:
        f, root = opened(self.path)
        if f.get_file_info(f"{root}/_staged/{self.job}").type == files.FileType.Directory:
            f.delete_dir(f"{root}/_staged/{self.job}")


class BatchWriter(_Writer, DataSourceWriter):
    def commit(self, messages: Sequence[Staged | None]) -> None:
        self._move(self._moves(messages))
        self._cleared()

    def abort(self, messages: Sequence[Staged | None]) -> None:
        self._cleared()


class StreamWriter(_Writer, DataSourceStreamWriter):
    """A batch's moves are written down under its number first. A batch that comes again finishes those and drops what
    it has staged anew, so it takes effect once. query names the sender."""

    def __init__(self, path: str, topic: str, partitions: int, query: str):
        super().__init__(path, topic, partitions)
        self.query = query

    def commit(self, messages: Sequence[Staged | None], batchId: int) -> None:
        f, root = opened(self.path)
        plan = f"{root}/_senders/{self.query}/{batchId:020d}"
        f.create_dir(f"{root}/_senders/{self.query}", recursive=True)
        if f.get_file_info(plan).type == files.FileType.File:
            self._move(json.loads(f.open_input_stream(plan).read()))
            self._cleared()
            return
        moves = self._moves(messages)
        with f.open_output_stream(f"{plan}.tmp") as s:
            s.write(json.dumps(moves).encode())
        f.move(f"{plan}.tmp", plan)
        self._move(moves)

    def abort(self, messages: Sequence[Staged | None], batchId: int) -> None:
        self._cleared()


class Messages(DataSource):
    """Options: path; for reading subscribe (topics with commas), group, startingOffsets (earliest, latest or group) and
    maxOffsetsPerTrigger (of each partition); for writing topic, partitions and, for streams, query."""

    @classmethod
    def name(cls) -> str:
        return "messages"

    def schema(self) -> str:
        return MESSAGE

    def _topics(self) -> list[str]:
        return [t.strip() for t in self.options["subscribe"].split(",") if t.strip()]

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(self.options["path"], self._topics())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        most, starting = self.options.get("maxOffsetsPerTrigger"), self.options.get("startingOffsets", "earliest").lower()
        if starting not in ("earliest", "latest", "group"):
            raise ValueError(f"startingOffsets is earliest, latest or group, not {starting}")
        if most and not self.options.get("group"):
            raise ValueError("maxOffsetsPerTrigger needs a group, whose plan is kept")
        return StreamReader(self.options["path"], self._topics(), self.options.get("group"), starting, int(most) if most else None)

    def _checked(self, schema: StructType) -> StructType:
        if [(x.name, x.dataType.simpleString()) for x in schema] != [("key", "string"), ("value", "string")]:
            raise ValueError(f"messages are (key string, value string), not {schema.simpleString()}")
        return schema

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        self._checked(schema)
        if overwrite:
            raise ValueError("a log is only appended to")
        return BatchWriter(self.options["path"], self.options["topic"], int(self.options.get("partitions", 8)))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        self._checked(schema)
        return StreamWriter(self.options["path"], self.options["topic"], int(self.options.get("partitions", 8)), self.options["query"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Messages)

"""Topics as a data source of Spark: ``format("topic")`` reads and writes messages in partitions, by offsets.

A topic is a folder that driver and executors share (any file system that Arrow knows). Messages (key,
value) go to the partition their key's hash names, so a key's messages stay in order; a partition is a row of files, each
named by the offset of its first message. Files appear under their names only when the driver commits a
batch: writers leave them in a staging folder and tell where, the driver writes down which offsets they get, then moves
them. A driver that dies between leaves that note, and the next one finishes it; a batch that is committed again is known
by its note and adds nothing. What a failed batch staged is removed.

Options: ``path``; ``partitions`` (of a topic that is new, 4 by default); ``query`` (tells the writer's batches from
those of other queries; needed for writing a stream that may be restarted); ``maxOffsetsPerTrigger`` (messages of a
micro-batch, over all partitions).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "topic_partition int, offset bigint, key string, value string"
MESSAGE = pa.schema([("key", pa.string()), ("value", pa.string())])
#: Messages of a file, and of a task that reads.
ROWS = 100_000


@dataclass
class Staged(WriterCommitMessage):
    """What one task has written: by partition, files and how many messages each holds."""

    files: list[tuple[int, str, int]] = field(default_factory=list)


@dataclass
class Stretch(InputPartition):
    """Offsets [begin, end) of a partition."""

    number: int
    begin: int
    end: int


class Topic:
    """A topic's folder."""

    def __init__(self, options) -> None:
        self.options = dict(options)
        self.files, self.root = fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] or self.options["path"].startswith("file:") else (fs.LocalFileSystem(), self.options["path"])

    def names(self, folder: str) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found if not f.base_name.startswith("."))

    def read_json(self, name: str):
        with self.files.open_input_stream(f"{self.root}/{name}") as f:
            return json.loads(f.read())

    def write_json(self, name: str, value) -> None:
        """Whole or not at all."""
        self.files.create_dir(f"{self.root}/{name}".rsplit("/", 1)[0])
        beside = f"{self.root}/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(beside) as f:
            f.write(json.dumps(value).encode())
        self.files.move(beside, f"{self.root}/{name}")

    def partitions(self) -> int:
        if "topic.json" not in self.names(""):
            self.write_json("topic.json", {"partitions": int(self.options.get("partitions", 4))})
        return self.read_json("topic.json")["partitions"]

    def held(self, number: int) -> list[tuple[int, int, str]]:
        """Files of a partition: first offset, end, name."""
        out = []
        for name in self.names(f"p={number}"):
            first, n = name.split(".")[0].split("-")[:2]
            out.append((int(first), int(first) + int(n), f"p={number}/{name}"))
        return out

    def ends(self) -> dict[str, int]:
        self.finish()
        return {str(p): max((end for _, end, _ in self.held(p)), default=0) for p in range(self.partitions())}

    # writing

    def stage(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        n, out, held = self.partitions(), Staged(), {}
        self.files.create_dir(f"{self.root}/staging")

        def put(number: int) -> None:
            table = pa.Table.from_batches(held.pop(number), MESSAGE)
            name = f"staging/{uuid.uuid4().hex}.parquet"
            with self.files.open_output_stream(f"{self.root}/{name}") as f:
                pq.write_table(table, f)
            out.files.append((number, name, table.num_rows))

        for batch in batches:
            whole = batch.select(["key", "value"]).cast(MESSAGE)
            number = [zlib.crc32((k or "").encode()) % n for k in whole.column(0).to_pylist()]
            for p in set(number):
                some = whole.take(pa.array([k for k, x in enumerate(number) if x == p]))
                held.setdefault(p, []).append(some)
                if sum(b.num_rows for b in held[p]) >= ROWS:
                    put(p)
        for p in list(held):
            put(p)
        return out

    def commit(self, messages: list, batch: str) -> None:
        self.finish()
        if f"{batch}.json" in self.names("commits"):
            self.drop(messages)
            return
        at, moves = self.ends(), []
        for number, name, n in (f for m in messages if m is not None for f in m.files):
            begin = at[str(number)]
            moves.append((name, f"p={number}/{begin:020}-{n}.parquet"))
            at[str(number)] = begin + n
        self.write_json(f"commits/{batch}.json", moves)
        self.write_json("last.json", batch)
        self.finish()

    def finish(self) -> None:
        """Move what the last note names and what hasn't been moved yet."""
        if "last.json" not in self.names(""):
            return
        staged = set(self.names("staging"))
        for name, target in self.read_json(f"commits/{self.read_json('last.json')}.json"):
            if name.split("/")[1] in staged:
                self.files.create_dir(f"{self.root}/{target}".rsplit("/", 1)[0])
                self.files.move(f"{self.root}/{name}", f"{self.root}/{target}")

    def drop(self, messages: list) -> None:
        there = set(self.names("staging"))
        for _, name, _ in (f for m in messages if m is not None for f in m.files):
            if name.split("/")[1] in there:
                self.files.delete_file(f"{self.root}/{name}")

    # reading

    def stretches(self, begin: dict[str, int], end: dict[str, int]) -> list[Stretch]:
        return [Stretch(int(p), a, min(a + ROWS, end[p])) for p in end for a in range(begin.get(p, 0), end[p], ROWS)]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        for first, last, name in self.held(part.number):
            if first < part.end and part.begin < last:
                with self.files.open_input_file(f"{self.root}/{name}") as f:
                    table = pq.read_table(f)
                a, b = max(part.begin, first), min(part.end, last)
                some = table.slice(a - first, b - a)
                out = pa.table({"topic_partition": pa.array([part.number] * (b - a), pa.int32()), "offset": pa.array(range(a, b), pa.int64()), "key": some["key"], "value": some["value"]})
                yield from out.to_batches()


class TopicReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = options

    def partitions(self) -> list[Stretch]:
        topic = Topic(self.options)
        return topic.stretches({}, topic.ends()) or [Stretch(0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return Topic(self.options).read(partition)


class TopicStreamReader(DataSourceStreamReader):
    """Offsets by partition; a micro-batch takes no more messages than it may, from all partitions alike.

    Where a restarted query has no micro-batch to repeat, the reader learns its place with the first one, which isn't bounded.
    """

    def __init__(self, options) -> None:
        self.options, self.at = options, None

    def initialOffset(self) -> dict:
        self.at = dict.fromkeys(Topic(self.options).ends(), 0)
        return self.at

    def latestOffset(self) -> dict:
        ends = Topic(self.options).ends()
        most = int(self.options.get("maxOffsetsPerTrigger", 0))
        if most and self.at is not None:
            waiting = {p: end - self.at.get(p, 0) for p, end in ends.items()}
            share = min(1.0, most / max(1, sum(waiting.values())))
            ends = {p: self.at.get(p, 0) + min(n, max(1, int(n * share))) for p, n in waiting.items()}
        return ends

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.at = end
        return Topic(self.options).stretches(start, end)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return Topic(self.options).read(partition)


class TopicWriter(DataSourceArrowWriter):
    def __init__(self, options) -> None:
        self.options, self.name = options, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return Topic(self.options).stage(iterator)

    def commit(self, messages: list) -> None:
        Topic(self.options).commit(messages, self.name)

    def abort(self, messages: list) -> None:
        Topic(self.options).drop(messages)


class TopicStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options) -> None:
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return Topic(self.options).stage(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        Topic(self.options).commit(messages, f"{self.options['query']}-{batchId}")

    def abort(self, messages: list, batchId: int) -> None:
        Topic(self.options).drop(messages)


class TopicSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TopicReader:
        return TopicReader(self.options)

    def streamReader(self, schema) -> TopicStreamReader:
        return TopicStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> TopicWriter:
        if overwrite:
            raise ValueError("a topic is only appended to")
        Topic(self.options).partitions()
        return TopicWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> TopicStreamWriter:
        if "query" not in self.options:
            raise ValueError("query: a name that this query keeps when it is restarted")
        Topic(self.options).partitions()
        return TopicStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TopicSource)

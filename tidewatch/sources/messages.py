"""A stream of landed messages: an append-only log in numbered segments, one JSON message a line, read by offset.

Whoever receives messages (a socket, a poll) appends segments `<first number>.jsonl`, each under its final name in one step, numbered by the
number of its first message. The source gives every message its number (`offset`), keeps in the stream's checkpoint how far it
came, and reads what is new in partitions of one segment part each, on the executors. A restart goes on after the last committed number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Messages of one partition at most.
PART = 50_000
BATCH = 5_000
SCHEMA = "offset long, channel string, message_id long, seen timestamp, text string"


@dataclass
class Segment(InputPartition):
    """Messages start up to (not including) end; `first` is the number of the file's first one."""

    file: str
    first: int
    start: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Messages(DataSource):
    """spark.readStream.format("message_log").option("path", folder).load()

    A batch takes all that has landed, in partitions of at most PART messages."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> Log:
        return Log(self.options["path"])


class Log(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def segments(self) -> list[tuple[int, str]]:
        """First number and file of each segment: names alone, in order."""
        at, folder = opened(self.path)
        found = at.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted((int(f.base_name.removesuffix(".jsonl")), f.path) for f in found if f.base_name.removesuffix(".jsonl").isdigit() and f.base_name.endswith(".jsonl"))

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        """One past the last message there is. Segments are whole, so only the last one is read for it."""
        found = self.segments()
        if not found:
            return {"next": 0}
        first, file = found[-1]
        with opened(self.path)[0].open_input_stream(file) as f:
            end = first + sum(part.count(b"\n") for part in iter(lambda: f.read(1 << 20), b""))
        return {"next": end}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        found = self.segments()
        out = []
        for (first, file), stop in zip(found, [*(f for f, _ in found), end["next"]][1:], strict=True):
            lo, hi = max(first, start["next"]), min(stop, end["next"])
            out += [Segment(file, first, i, min(i + PART, hi)) for i in range(lo, hi, PART)]
        return out

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        with opened(self.path)[0].open_input_stream(partition.file) as f:
            for at, line in enumerate(split(f), partition.first):
                if at >= partition.end:
                    break
                if at >= partition.start:
                    rows.append(parsed(at, line))
                if len(rows) >= BATCH:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    def commit(self, end: dict) -> None:
        """Nothing to give back: the log stays."""


def split(stream) -> Iterator[bytes]:
    rest = b""
    while part := stream.read(1 << 20):
        *whole, rest = (rest + part).split(b"\n")
        yield from whole


def parsed(at: int, line: bytes) -> tuple:
    """A line that cannot be read keeps its number, with nothing in it: it is dropped by the gate, not by the source."""
    try:
        m = json.loads(line)
    except ValueError:
        m = None
    m = m if isinstance(m, dict) else {}
    whole = lambda x: x if isinstance(x, int) and not isinstance(x, bool) else None
    word = lambda x: x if isinstance(x, str) else None
    return at, word(m.get("channel")), whole(m.get("message_id")), whole(m.get("seen")), word(m.get("text"))


def batch(rows: list[tuple]) -> pa.RecordBatch:
    at, channel, message, seen, text = zip(*rows, strict=True)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.string()]
    seen = [None if s is None else s * 1_000_000 for s in seen]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((at, channel, message, seen, text), kinds, strict=True)], names=["offset", "channel", "message_id", "seen", "text"])


def land(messages: DataFrame, path: str, first: int = 0, order: str = "id") -> int:
    """Append messages (channel, message_id, seen, text) in the given order to the log, numbered from `first`; the next free number.

    Each range of the order is a segment, written by a task; numbers come from the rows of the ranges before. Ranges are cut and counted
    by the order alone, so texts move once, to the task that writes them."""
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = messages.select(F.percentile_approx(order, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0]
    ends = sorted(set(places or []))
    part = F.lit(0)
    for i, end in enumerate(ends):  # a bound per task
        part = F.when(F.col(order) > F.lit(end), i + 1).otherwise(part)
    sizes = {r["part"]: r["count"] for r in messages.groupBy(part.alias("part")).count().collect()}  # a row per task
    starts, next_ = {}, first
    for p in sorted(sizes):
        starts[p], next_ = next_, next_ + sizes[p]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, folder = opened(path)
        own = f = None
        for lines in batches:
            if own is None and lines.num_rows:
                at.create_dir(folder)
                own, hidden = lines.column("part")[0].as_py(), f"{folder}/.{uuid.uuid4().hex}"
                f = at.open_output_stream(hidden)
            for x in lines.column("line").to_pylist():
                f.write(x.encode() + b"\n")
        if f:
            f.close()
            at.move(hidden, f"{folder}/{starts[own]}.jsonl")
            yield pa.record_batch({"part": pa.array([own], pa.int32())})

    rows = messages.select(part.alias("part"), order, F.to_json(F.struct("channel", "message_id", F.unix_timestamp("seen").alias("seen"), "text")).alias("line"))
    ranges = rows.repartitionById(len(ends) + 1, F.col("part")).sortWithinPartitions(order)
    assert ranges.mapInArrow(segments, "part int").count() == len(sizes)
    return next_

"""One large JSON array as a source that many tasks read, and a sink that makes one.

Where an element of an array begins depends on all text before it, so a file can't just be
cut. A first job looks at each range of bytes by itself: what it does to the state (inside a
string or not, nesting depth) for either state that it may begin in. Put one after
another, a few numbers a range, these say in which state each range begins and how many
elements came before it; then every task reads the elements that begin in its own range.

The sink's tasks write parts, and the commit joins those of the attempts that were
committed between a head and a tail; what a failed write has left is removed.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a range; of what is read or copied at a time.
RANGE_BYTES, BLOCK = 32 << 20, 1 << 20
_QUOTE, _BACK, _COMMA = 34, 92, 44
_OPEN, _CLOSE = (91, 123), (93, 125)
_SPACE = b" \t\r\n"


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or address (local, HDFS, S3, GCS), and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pyarrow.fs.LocalFileSystem(), path)


def quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Places of quotes that no backslash escapes. escaped: whether the first byte is."""
    at = np.flatnonzero(data == _QUOTE)
    if not len(at):
        return at
    other = np.where(data == _BACK, -1, np.arange(len(data)))
    last = np.concatenate(([-1], np.maximum.accumulate(other)))[at]  # the last byte before that is no backslash
    run = at - 1 - last
    return at[(run + (escaped & (last < 0))) % 2 == 0]


def structure(data: np.ndarray, escaped: bool, inside: bool) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Places and relative depths of commas outside strings, the depth at the end relative to the
    start, and whether the end is inside a string. A comma's depth is that around it."""
    mark = np.zeros(len(data), np.int64)
    mark[quotes(data, escaped)] = 1
    string = (np.cumsum(mark) + inside) % 2 == 1
    change = np.where(string, 0, np.isin(data, _OPEN).astype(np.int64) - np.isin(data, _CLOSE))
    depth = np.cumsum(change)
    commas = np.flatnonzero((data == _COMMA) & ~string)
    return commas, depth[commas], int(depth[-1]) if len(data) else 0, bool(string[-1]) if len(data) else inside


def _escaped_at(f, start: int) -> bool:
    """Whether the byte at start follows an odd run of backslashes."""
    run, at = 0, start
    while at:
        size = min(BLOCK, at)
        f.seek(at - size)
        raw = f.read(size)
        more = len(raw) - len(raw.rstrip(b"\\"))
        run, at = run + more, at - size
        if more < size:
            break
    return run % 2 == 1


_EFFECTS = pa.schema([("i", pa.int64()), ("inside", pa.bool_()), ("change", pa.int64()), ("after", pa.bool_()), ("levels", pa.list_(pa.int64())), ("count", pa.list_(pa.int64()))])


def effects(path: str, start: int, end: int) -> list[dict]:
    """What a range does to either state that it may begin in: the change of depth, whether it ends
    inside a string, and its commas by relative depth. A block is looked at at a time."""
    fs, at = opened(path)
    out = [{"inside": inside, "change": 0, "after": inside, "levels": Counter()} for inside in (False, True)]
    with fs.open_input_file(at) as f:
        escaped = _escaped_at(f, start)
        f.seek(start)
        while start < end and (raw := f.read(min(BLOCK, end - start))):
            for r in out:
                _, depths, change, after = structure(np.frombuffer(raw, np.uint8), escaped, r["after"])
                levels, count = np.unique(depths + r["change"], return_counts=True)
                r["levels"].update(dict(zip(levels.tolist(), count.tolist())))
                r["change"], r["after"] = r["change"] + change, after
            escaped, start = _odd_tail(raw, escaped), start + len(raw)
    return [r | {"levels": list(r["levels"].keys()), "count": list(r["levels"].values())} for r in out]


@dataclass
class Range(InputPartition):
    """A range of bytes: where it begins and ends, the state at its start, and the elements that
    begin before it."""

    start: int
    end: int
    inside: bool
    depth: int
    before: int


def composed(path: str, size: int, range_bytes: int, does: dict) -> list[Range]:
    """Ranges with their states, from the effects of each."""
    out, inside, depth, before = [], False, 0, 0
    for i in range(max(1, -(-size // range_bytes))):
        out.append(Range(i * range_bytes, min(size, (i + 1) * range_bytes), inside, depth, before))
        r = does[i, inside]
        before += sum(c for level, c in zip(r["levels"], r["count"]) if depth + level == 1)
        inside, depth = r["after"], depth + r["change"]
    if inside or depth:
        raise ValueError(f"{path} is no whole JSON array")
    return out


def ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> list[Range]:
    """Ranges of a file with their states, from one job over all of them."""
    fs, at = opened(path)
    size = fs.get_file_info(at).size

    def look(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                found = [{"i": i, **x} for x in effects(path, i * range_bytes, min(size, (i + 1) * range_bytes))]
                yield pa.RecordBatch.from_pylist(found, schema=_EFFECTS)

    n = max(1, -(-size // range_bytes))
    rows = spark.range(0, n, 1, n).mapInArrow(look, "i long, inside boolean, change long, after boolean, levels array<long>, count array<long>").collect()  # two a range
    return composed(path, size, range_bytes, {(r["i"], r["inside"]): r for r in rows})


class JsonArray(DataSource):
    """Elements of an array, as text: at (its place, from 0) and value. Read it through elements(),
    which looks at the ranges first."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "at long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], json.loads(self.options["ranges"]))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        o = self.options
        return _Writer(o["path"], schema.names.index(o.get("column", "value")), o.get("head", "["), o.get("tail", "]"))


class _Reader(DataSourceReader):
    def __init__(self, path: str, given: list):
        self.path, self.given = path, given

    def partitions(self) -> list[Range]:
        return [Range(*x) for x in self.given]

    def read(self, partition: Range) -> Iterator[tuple]:
        """Elements that begin in the range: after a comma in it, or, in the first, after the opening
        bracket. The last one is read on to its end."""
        fs, at = opened(self.path)
        with fs.open_input_file(at) as f:
            escaped = _escaped_at(f, partition.start)
            f.seek(partition.start)
            held, place = b"", partition.before
            begun, inside, depth, here = False, partition.inside, partition.depth, partition.start
            while raw := f.read(min(BLOCK, partition.end - here) if here < partition.end else BLOCK):
                commas, levels, change, after = structure(np.frombuffer(raw, np.uint8), escaped, inside)
                first = 0
                if not depth and not begun:  # before the array, or after it
                    first = raw.find(b"[") + 1
                    begun = first > 0
                closed = raw.rindex(b"]") if (begun or depth) and depth + change == 0 else len(raw)
                for c in commas[levels + depth == 1].tolist():
                    if begun:
                        yield place, (held + raw[first:c]).strip(_SPACE).decode()
                    place += 1  # what was open at the range's start is another's
                    if here + c >= partition.end:
                        return  # and so is what begins after it
                    held, first, begun = b"", c + 1, True
                if begun:
                    held += raw[first:closed]
                if closed < len(raw):
                    if begun and (held.strip(_SPACE) or place):
                        yield place, held.strip(_SPACE).decode()
                    return
                if not begun and here + len(raw) >= partition.end:
                    return
                escaped = _odd_tail(raw, escaped)
                inside, depth, here = after, depth + change, here + len(raw)


def _odd_tail(raw: bytes, escaped: bool) -> bool:
    run = len(raw) - len(raw.rstrip(b"\\"))
    return (run + (escaped and run == len(raw))) % 2 == 1


def elements(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """at and value (its text) of each element of the file's array, in as many partitions as there
    are ranges. An empty array gives none."""
    spark.dataSource.register(JsonArray)
    given = [[r.start, r.end, r.inside, r.depth, r.before] for r in ranges(spark, path, range_bytes)]
    return spark.read.format("json_array").option("path", path).option("ranges", json.dumps(given)).load()


# --- sink ----------------------------------------------------------------------------


@dataclass
class Part(WriterCommitMessage):
    number: int
    file: str
    rows: int


class _Writer(DataSourceWriter):
    """Rows of a column of JSON texts as one document: head, the texts with commas between them in
    the order of partitions, tail."""

    def __init__(self, path: str, column: int, head: str, tail: str):
        self.path, self.column, self.head, self.tail = path, column, head, tail
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, rows) -> Part:
        fs, parts = opened(self.parts)
        fs.create_dir(parts, recursive=True)
        number, n = TaskContext.get().partitionId(), 0
        file = f"{parts}/{number}-{uuid.uuid4().hex}"  # an attempt's own
        with fs.open_output_stream(file) as f:
            for r in rows:
                if r[self.column] is not None:
                    f.write((",\n" if n else "").encode() + r[self.column].encode())
                    n += 1
        return Part(number, file, n)

    def commit(self, messages) -> None:
        fs, path = opened(self.path)
        _, parts = opened(self.parts)
        done = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number)
        whole = f"{parts}/whole"
        fs.create_dir(parts, recursive=True)
        with fs.open_output_stream(whole) as f:
            f.write(self.head.encode())
            for i, m in enumerate(done):
                if i:
                    f.write(b",\n")
                with fs.open_input_stream(m.file) as part:
                    while raw := part.read(BLOCK):
                        f.write(raw)
            f.write(self.tail.encode())
        fs.move(whole, path)  # a reader sees the whole document or the one before
        fs.delete_dir(parts)

    def abort(self, messages) -> None:
        fs, parts = opened(self.parts)
        if fs.get_file_info(parts).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(parts)


def write_array(df: DataFrame, column: str, path: str, head: str = "[\n", tail: str = "\n]\n") -> None:
    """A column of JSON texts as one document at path, in the order of df's partitions; nulls are
    left out. A write that fails leaves what was at path before."""
    df.sparkSession.dataSource.register(JsonArray)
    df.select(F.col(column).alias("value")).write.format("json_array").option("path", path).option("column", "value").option("head", head).option("tail", tail).mode("append").save()

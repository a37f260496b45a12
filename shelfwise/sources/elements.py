"""Feeds and sitemaps as a Spark data source of XML elements, and a CSV sink that shows whole batches only.

``elements`` (batch and stream) gives the whole elements of one name, a row each: file, start (the byte that it begins at)
and element (its text). What is in them is then read by Spark's own functions (``feed_elements``, ``sitemap_elements``). A
file is cut into splits of bytes; the split that an element begins in reads it to its end, so a file of any size is read by
many tasks, and a task holds one window of bytes and the element it is at.

As a stream, the files of a folder are ordered by the time of their last change and then by name, and an offset names the
last one taken. A file counts once ``settle`` seconds old, so that one that appears with the same time is not passed by;
files are to be put there whole, by a rename, with a time of their own, and not to be changed or taken away before the
stream has passed them. Names that begin with a dot or underscore are left out.

``whole_csv`` (batch and stream) writes every field of strings in quotes. Tasks write below a hidden folder; the commit
makes it visible by one rename, an abort takes it away: a failed job leaves nothing, and a reader sees all rows of a job or
none. A batch of a stream is a folder named by its number; one that is there already is not written again.

Paths are opened with ``pyarrow.fs``; the sink needs a store that renames folders (a local one, HDFS).

Defined cases: text is UTF-8, other bytes are replaced; an element that is not closed is left out; ``<item/>`` is an element,
and so is one in a comment; elements within elements of the same name are not meant; empty files and folders give no rows;
null fields are written as nothing, without quotes, empty ones as two quotes.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv, fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

from shelfwise.sources.io import FEED_TAGS, feed_rows

WINDOW = 1 << 20
ROWS = 2_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, with or without scheme, and the path in it."""
    return fs.FileSystem.from_uri(path)


def files_below(path: str) -> list[tuple[int, str, int]]:
    """The files of a folder (or the file itself): time of change in nanoseconds, path in its file system, size."""
    system, where = opened(path)
    (info,) = system.get_file_info([where])
    found = system.get_file_info(fs.FileSelector(where, recursive=True)) if info.type == fs.FileType.Directory else [info]
    seen = lambda f: not any(p.startswith((".", "_")) for p in f.path[len(where) :].split("/"))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and seen(f))


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


def splits(files: list[tuple[int, str, int]], size: int) -> list[Split]:
    return [Split(path, at, min(at + size, length)) for _, path, length in files for at in range(0, length, size)]


def elements_of(handle: pa.NativeFile, name: str, start: int, end: int, window: int = WINDOW) -> Iterator[tuple[int, bytes]]:
    """The elements that begin at a byte from ``start`` on and before ``end``, each with its first byte."""
    opening = re.compile(rb"<(?:[\w.-]+:)?" + name.encode() + rb"(?=[\s/>])")
    closing = re.compile(rb"</(?:[\w.-]+:)?" + name.encode() + rb"\s*>")
    longest = len(name) + 256  # of an opening's name with prefix
    handle.seek(start)
    held, base, ended = b"", start, False

    def more() -> bool:
        nonlocal held, ended
        new = handle.read(window)
        held, ended = held + new, not new
        return not ended

    at = 0
    while True:
        found = opening.search(held, at)
        if not found:
            # A name that the window cuts is found with the next one
            keep = max(at, len(held) - longest)
            held, base, at = held[keep:], base + keep, 0
            if base >= end or not more():
                return
            continue
        if base + found.start() >= end:
            return
        held, base = held[found.start() :], base + found.start()
        tag = held.find(b">")
        while tag < 0:
            was = len(held)
            if not more():
                return
            tag = held.find(b">", was)
        if held[tag - 1 : tag] == b"/":
            yield base, held[: tag + 1]
            at = tag + 1
            continue
        look = tag
        while not (closed := closing.search(held, look)):
            look = max(tag, len(held) - longest)
            if not more():
                return
        yield base, held[: closed.end()]
        at = closed.end()


class _Reading:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict[str, str]):
        self.path, self.name = options["path"], options.get("rowTag", "item")
        self.size, self.settle = int(options.get("splitBytes", 64 << 20)), float(options.get("settle", 0))

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        rows: list[tuple[int, str]] = []
        with system.open_input_file(partition.path) as handle:
            for at, text in elements_of(handle, self.name, partition.start, partition.end):
                rows.append((at, text.decode("utf-8", "replace")))
                if len(rows) == ROWS:
                    yield self._batch(partition.path, rows)
                    rows = []
        if rows:
            yield self._batch(partition.path, rows)

    def _batch(self, path: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        starts, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(starts, pa.int64()), pa.array(texts, pa.string())], names=["file", "start", "element"])


class ElementReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Split]:
        return splits(files_below(self.path), self.size)


class ElementStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        settled = [f for f in files_below(self.path) if f[0] <= time.time_ns() - self.settle * 1e9]
        return {"time": settled[-1][0], "path": settled[-1][1]} if settled else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Split]:
        after, last = (start["time"], start["path"]), (end["time"], end["path"])
        return splits([f for f in files_below(self.path) if after < f[:2] <= last], self.size)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class ElementSource(DataSource):
    """Options: path, rowTag (item), splitBytes (64 MB), settle (0 seconds; streams)."""

    @classmethod
    def name(cls) -> str:
        return "elements"

    def schema(self) -> str:
        return "file string, start long, element string"

    def reader(self, schema: StructType) -> ElementReader:
        return ElementReader(self.options)

    def streamReader(self, schema: StructType) -> ElementStreamReader:
        return ElementStreamReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class _Writing:
    """Tasks write to a hidden folder; names are new, so a task that runs twice leaves a file that the commit does not name."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def fill(self, name: str, batches: Iterator[pa.RecordBatch]) -> Written:
        """A new file in the hidden folder for ``name``."""
        system, where = opened(self.path)
        file, rows = f"part-{uuid.uuid4().hex}.csv", 0
        schema = pa.schema([(c, pa.string()) for c in self.columns])
        how = csv.WriteOptions(include_header=True, quoting_style="all_valid")
        system.create_dir(f"{where}/.{name}", recursive=True)
        with system.open_output_stream(f"{where}/.{name}/{file}") as out, csv.CSVWriter(out, schema, write_options=how) as to:
            for batch in batches:
                to.write_batch(batch.cast(schema))
                rows += batch.num_rows
        return Written(file, rows)

    def show(self, name: str, messages: list[Written | None]) -> None:
        system, where = opened(self.path)
        hidden, target = f"{where}/.{name}", f"{where}/{name}"
        if system.get_file_info([target])[0].type != fs.FileType.NotFound:
            self.undo(name)
            return
        system.create_dir(hidden, recursive=True)
        named = {m.file for m in messages if m and m.rows}
        for file in system.get_file_info(fs.FileSelector(hidden)):
            if file.base_name not in named:
                system.delete_file(file.path)
        system.move(hidden, target)

    def undo(self, name: str) -> None:
        system, where = opened(self.path)
        if system.get_file_info([f"{where}/.{name}"])[0].type != fs.FileType.NotFound:
            system.delete_dir(f"{where}/.{name}")


class WholeCsvWriter(_Writing, DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str]):
        super().__init__(path, columns)
        self.job = f"job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.fill(self.job, iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.show(self.job, messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.undo(self.job)


class WholeCsvStreamWriter(_Writing, DataSourceStreamArrowWriter):
    """Tasks and commits have writers of their own: the number of the batch is what they share."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        number = TaskContext.get().getLocalProperty("streaming.sql.batchId")
        return self.fill(f"batch-{int(number):09d}", iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.show(f"batch-{batchId:09d}", messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.undo(f"batch-{batchId:09d}")


class WholeCsvSink(DataSource):
    """Option: path. Columns must be strings; mode append."""

    @classmethod
    def name(cls) -> str:
        return "whole_csv"

    def _columns(self, schema: StructType, overwrite: bool) -> list[str]:
        if overwrite:
            raise ValueError("whole_csv appends; it does not overwrite")
        if other := [f.name for f in schema if not isinstance(f.dataType, StringType)]:
            raise ValueError(f"whole_csv writes strings; cast {', '.join(other)}")
        return schema.names

    def writer(self, schema: StructType, overwrite: bool) -> WholeCsvWriter:
        return WholeCsvWriter(self.options["path"], self._columns(schema, overwrite))

    def streamWriter(self, schema: StructType, overwrite: bool) -> WholeCsvStreamWriter:
        return WholeCsvStreamWriter(self.options["path"], self._columns(schema, overwrite))


def registered(spark: SparkSession) -> SparkSession:
    """The session with ``elements`` and ``whole_csv``."""
    spark.dataSource.register(ElementSource)
    spark.dataSource.register(WholeCsvSink)
    return spark


def feed_elements(elements: DataFrame) -> DataFrame:
    """Items of the own feed, from a batch or a stream of elements, as SKU rows. Of an element that is not well formed nothing
    is known, and ``split_valid_feed`` sets it apart."""
    item = F.from_xml("element", ", ".join(f"`g:{t}` string" for t in FEED_TAGS))
    return feed_rows(elements.select(item.alias("i")).select("i.*"))


def sitemap_elements(elements: DataFrame, unescape: tuple[tuple[str, str], ...] = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))) -> DataFrame:
    """file, start and url of every ``url`` (or ``sitemap``) element with a location, in file order by (file, start)."""
    url: Column = F.regexp_extract("element", r"(?s)<(?:[\w.-]+:)?loc[^>]*>\s*(.*?)\s*</(?:[\w.-]+:)?loc>", 1)
    for name, sign in unescape:
        url = F.replace(url, F.lit(name), F.lit(sign))
    return elements.select("file", "start", url.alias("url")).where("url <> ''")

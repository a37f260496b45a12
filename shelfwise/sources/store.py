"""Keyed tables with versions: merges write what they touch, and one small file makes a new version visible.

A store is a folder of several tables. Rows of a table lie in buckets by a hash of their key; a version names the folder of
every bucket of every table. A change reads a version, writes new folders for the buckets that it touches (no file is ever
changed), and publishes the next version by creating its file, which succeeds for one writer alone. So

- a reader has all of a version or none of it, and an older version stays readable until ``tidy`` takes it away,
- a merge costs what the touched buckets hold, not what the table holds,
- a change to several tables is one version,
- of two writers the later one finds the number taken: if the versions in between touched none of its buckets, it goes on
  from them, else it is a ``Conflict``, and ``Store.merge`` works it out again on the new version,
- a writer that dies leaves folders that no version names.

The file of a version is created by a hard link on a local file system and by a rename elsewhere, which on HDFS fails if
the name is taken; a store without such an operation needs one writer at a time.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.sources.staging import drop_shuffles

#: Bytes of files that a merge works on at once.
TOGETHER = 256 << 20
Apply = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(Exception):
    """Another writer has changed what this one has read."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        drop_shuffles(spark)
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.fs.getUri().getScheme() == "file"

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _name(self, number: int) -> str:
        return f"{number:012d}.json"

    def publish(self, number: int, text: str) -> bool:
        """Creates the file of a version with all its text at once; False if it is there already."""
        draft, target = self._path("versions", f".draft-{uuid.uuid4().hex}"), self._path("versions", self._name(number))
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.local:
                os.link(urlparse(draft.toUri().getPath()).path, urlparse(target.toUri().getPath()).path)
            else:
                jvm = self.spark._jvm
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
                kinds = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(target), kinds)
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e) or self.fs.exists(target):
                return False
            raise
        finally:
            self.fs.delete(draft, False)
        return True

    def numbers(self) -> list[int]:
        where = self._path("versions")
        names = [f.getPath().getName() for f in self.fs.listStatus(where)] if self.fs.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> dict:
        """number, tables (keys, buckets, schema, state: folder by bucket), touched, marks."""
        if number is None:
            known = self.numbers()
            if not known:
                raise ValueError(f"{self.root} holds no version")
            number = known[-1]
        stream = self.fs.open(self._path("versions", self._name(number)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def folders(self, name: str) -> list[tuple[str, float]]:
        """The folders in a folder of the store, and when they were changed, in seconds."""
        where = self._path(name)
        found = self.fs.listStatus(where) if self.fs.exists(where) else []
        return [(f.getPath().getName(), f.getModificationTime() / 1000) for f in found]

    def remove(self, *parts: str) -> bool:
        return self.fs.delete(self._path(*parts), True)

    def drop(self, number: int) -> bool:
        """Takes a version away, not what it names."""
        return self.remove("versions", self._name(number))

    def create(self, marks: dict | None = None, **tables: tuple[DataFrame, list[str], int]) -> int:
        """The first version: each table as (rows, keys, number of buckets)."""
        if self.numbers():
            raise ValueError(f"{self.root} holds a store already")
        found = {name: {"keys": keys, "buckets": n, "schema": rows.schema.json(), "state": self._write(rows, keys, n)} for name, (rows, keys, n) in tables.items()}
        text = json.dumps({"number": 0, "tables": found, "touched": {name: list(t["state"]) for name, t in found.items()}, "marks": marks or {}})
        if not self.publish(0, text):
            raise Conflict(f"another writer has created {self.root}")
        return 0

    def _bucketed(self, rows: DataFrame, keys: list[str], n: int) -> DataFrame:
        return rows.withColumn("bucket_", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))

    def _write(self, rows: DataFrame, keys: list[str], n: int) -> dict[str, str]:
        """Writes rows to a new folder; the folder of each bucket that has any. A task writes its rows where they are, a file a
        bucket: they are not dealt out once more."""
        part = f"data/{uuid.uuid4().hex}"
        self._bucketed(rows, keys, n).write.option("compression", "zstd").partitionBy("bucket_").parquet(f"{self.root}/{part}")
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path(part))]
        return {b.split("=")[1]: f"{part}/{b}" for b in names if b.startswith("bucket_=")}

    def rows(self, version: dict, table: str, buckets: list[str] | None = None) -> DataFrame:
        t = version["tables"][table]
        schema = StructType.fromJson(json.loads(t["schema"]))
        paths = [f"{self.root}/{p}" for b, p in sorted(t["state"].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str, number: int | None = None) -> DataFrame:
        return self.rows(self.version(number), table)

    def begin(self) -> Change:
        return Change(self, self.version())

    def merge(self, table: str, changes: DataFrame, apply: Apply, marks: dict | None = None, attempts: int = 5) -> int:
        """Merges changes and publishes; worked out anew, up to ``attempts`` times, where another writer was first."""
        for left in reversed(range(attempts)):
            change = self.begin()
            change.merge(table, changes, apply)
            try:
                return change.commit(marks)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def tidy(self, keep: int = 3, seconds: float = 86_400) -> int:
        """Takes away versions before the last ``keep`` and the folders that only they name; folders younger than ``seconds``
        stay, as a writer may be about to name them. The number of folders taken away."""
        known = self.numbers()
        for n in known[:-keep]:
            self.fs.delete(self._path("versions", self._name(n)), False)
        named = {p for n in known[-keep:] for t in self.version(n)["tables"].values() for p in t["state"].values()}
        wholes, gone, now = {p.rpartition("/")[0] for p in named}, 0, time.time()
        if self.fs.exists(self._path("data")):
            for folder in self.fs.listStatus(self._path("data")):
                part = f"data/{folder.getPath().getName()}"
                if now - folder.getModificationTime() / 1000 < seconds:
                    continue
                if part not in wholes:
                    gone += self.fs.delete(folder.getPath(), True)
                    continue
                for bucket in self.fs.listStatus(folder.getPath()):
                    name = f"{part}/{bucket.getPath().getName()}"
                    if name not in named and "bucket_=" in name:
                        gone += self.fs.delete(bucket.getPath(), True)
        return gone


class Change:
    """A new version in the making, on top of the one that it began with."""

    def __init__(self, store: Store, base: dict):
        self.store, self.base = store, base
        self.seen: dict[str, set[str]] = {}
        self.made: dict[str, dict[str, str | None]] = {}

    @property
    def marks(self) -> dict:
        return self.base["marks"]

    def _state(self, table: str) -> dict:
        """The base with what this change has made of the table."""
        t = self.base["tables"][table]
        state = {b: p for b, p in (t["state"] | self.made.get(table, {})).items() if p}
        return {"tables": {table: t | {"state": state}}}

    def read(self, table: str) -> DataFrame:
        """The whole table: any other change to it is then a conflict."""
        self.seen.setdefault(table, set()).update(str(b) for b in range(self.base["tables"][table]["buckets"]))
        return self.store.rows(self._state(table), table)

    def touched(self, table: str, changes: DataFrame) -> tuple[list[str], DataFrame]:
        """The buckets that the keys of ``changes`` lie in, and their rows."""
        t = self.base["tables"][table]
        keys = self.store._bucketed(changes.select(*t["keys"]), t["keys"], t["buckets"])
        buckets = [str(r.bucket_) for r in keys.select("bucket_").distinct().collect()]  # as many as the table has, at most
        self.seen.setdefault(table, set()).update(buckets)
        return buckets, self.store.rows(self._state(table), table, buckets)

    def rows(self, table: str, buckets: list[str]) -> DataFrame:
        """Rows of buckets as this change has made them, so far."""
        return self.store.rows(self._state(table), table, buckets)

    def merge(self, table: str, changes: DataFrame, apply: Apply) -> list[str]:
        """``apply(rows, changes)`` gives the new rows of the touched buckets, whose names are returned; it may change, add and
        drop rows whose keys ``changes`` has, and passes the others on."""
        t = self.base["tables"][table]
        buckets, rows = self.touched(table, changes)
        groups = self._groups(table, buckets)
        if len(groups) == 1:
            self.put(table, buckets, apply(rows, changes))
        elif groups:
            # What a group of buckets moves is gone before the next begins, so disk holds one group at a time
            schema, dealt = changes.schema, self.store._write(changes, t["keys"], t["buckets"])
            for group in groups:
                own = [f"{self.store.root}/{dealt[b]}" for b in group]
                self.put(table, group, apply(self.rows(table, group), self.store.spark.read.schema(schema).parquet(*own)))
            self.store.remove(dealt[buckets[0]].rpartition("/")[0])
        return buckets

    def _groups(self, table: str, buckets: list[str]) -> list[list[str]]:
        """The buckets in groups whose files have up to ``TOGETHER`` bytes, or one bucket each."""
        state = self._state(table)["tables"][table]["state"]
        groups, held = [], 0
        for b in sorted(buckets):
            size = self.store.fs.getContentSummary(self.store._path(state[b])).getLength() if b in state else 0
            if not groups or held + size > TOGETHER:
                groups, held = [*groups, []], 0
            groups[-1].append(b)
            held += size
        return groups

    def put(self, table: str, buckets: list[str], rows: DataFrame) -> None:
        """``rows`` are all that the buckets hold from now on."""
        t = self.base["tables"][table]
        schema = StructType.fromJson(json.loads(t["schema"]))
        rows = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))
        written = self.store._write(rows, t["keys"], t["buckets"])
        if not written.keys() <= set(buckets):
            raise ValueError("rows have come up whose keys lie in other buckets than those of the changes")
        self.made.setdefault(table, {}).update({b: written.get(b) for b in buckets})

    def commit(self, marks: dict | None = None) -> int:
        """Publishes; the number of the new version. ``marks`` are kept with it, beside those of the versions before."""
        base = self.base
        while True:
            tables = {}
            for name, t in base["tables"].items():
                state = {b: p for b, p in (t["state"] | self.made.get(name, {})).items() if p}
                tables[name] = t | {"state": state}
            number = base["number"] + 1
            touched = {name: sorted(b) for name, b in self.made.items()}
            if self.store.publish(number, json.dumps({"number": number, "tables": tables, "touched": touched, "marks": base["marks"] | (marks or {})})):
                return number
            newest = self.store.version()
            for n in range(number, newest["number"] + 1):
                other = newest if n == newest["number"] else self.store.version(n)
                if clash := [t for t, b in other["touched"].items() if self.seen.get(t, set()) & set(b)]:
                    raise Conflict(f"version {n} has changed the same buckets of {', '.join(clash)}")
            base = newest

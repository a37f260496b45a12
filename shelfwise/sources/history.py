"""The price history in parts: an append writes its own rows, and compaction gathers small parts into clustered ones.

A history is a folder of parts and versions (of ``Store``: a version is one small file, visible at once or not at all). An
append adds a part of level 0. Where ``fan`` parts of a level have come together they become one part of the next, so a row
is rewritten once a level, that is a logarithm of the number of appends, and there are never more than ``fan`` parts of a
level for long. Rows of a compacted part lie along a Z-curve over SKU and shop: each is a place of 16 bits by its hash, and
the bits of both alternate. So the files of one SKU, of one shop, and of one pair are few each: of N files about the square
root of N, the square root, and one. Within a pair rows lie by time, so a pair of very many rows is cut, too.

Each part has statistics, a row a file: the ends of its stretch of the curve, which 64ths of both axes occur in it, the
first and last time, and the number of rows. ``of`` asks them which files a look-up needs and reads those alone.

Defined cases: rows with null keys are kept, and look-ups, which name keys, don't find them; rows without a time are kept and
not found by ``since``; equal rows stay as often as they came; an append of no rows changes nothing; columns must be those of
the first version, by any order. An append never conflicts. Of two compactions of the same parts the later is a ``Conflict``
and leaves a folder that ``tidy`` takes away.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.operators.snapshots import PAIR
from shelfwise.sources.store import Conflict, Store

SKU, SHOP = PAIR


def cell(key: Column) -> Column:
    """The place of a key on its axis, 0 to 65,535."""
    return F.shiftrightunsigned(F.xxhash64(key), 48)


def _spread(c: Column) -> Column:
    """The 16 bits of a place with a free bit after each."""
    for by, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, by)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def curve(sku: Column, shop: Column) -> Column:
    """The place of a pair on the Z-curve."""
    return _spread(cell(sku)).bitwiseOR(F.shiftleft(_spread(cell(shop)), 1))


def _bit(key: Column) -> Column:
    """A bit for the 64th of the axis that the key lies in."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(cell(key), 10).cast("int"))


class History:
    def __init__(self, spark: SparkSession, root: str, ts: str = "scraped_at", per_file: int = 2_000_000):
        self.spark, self.ts, self.per_file = spark, ts, per_file
        self.store = Store(spark, root)
        self.root = self.store.root

    def version(self, number: int | None = None) -> dict:
        """number, schema, batch, and parts (id, level, rows, files)."""
        return self.store.version(number)

    def create(self, schema: StructType) -> int:
        """An empty history of rows with sku_id, competitor_id, the time, and any other columns."""
        if missing := {SKU, SHOP, self.ts} - set(schema.names):
            raise ValueError(f"the history needs the columns {', '.join(sorted(missing))}")
        if not self.store.publish(0, json.dumps({"number": 0, "schema": schema.json(), "batch": None, "parts": []})):
            raise Conflict(f"{self.root} holds a history already")
        return 0

    def _schema(self, version: dict) -> StructType:
        return StructType.fromJson(json.loads(version["schema"]))

    def _rows(self, version: dict, paths: list[str]) -> DataFrame:
        schema = self._schema(version)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _part(self, version: dict, rows: DataFrame, level: int) -> dict | None:
        """Writes rows and their statistics to new folders; None if there are no rows."""
        id_ = uuid.uuid4().hex
        rows.write.option("maxRecordsPerFile", 2 * self.per_file).parquet(f"{self.root}/data/{id_}")
        z, at = curve(F.col(SKU), F.col(SHOP)), F.col(f"`{self.ts}`")
        stats = self._rows(version, [f"{self.root}/data/{id_}"]).groupBy(F.col("_metadata.file_name").alias("file"))
        stats.agg(
            F.min(z).alias("z_first"), F.max(z).alias("z_last"), F.bit_or(_bit(F.col(SKU))).alias("skus"), F.bit_or(_bit(F.col(SHOP))).alias("shops"),
            F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"),
        ).write.parquet(f"{self.root}/stats/{id_}")
        n, files = self.spark.read.parquet(f"{self.root}/stats/{id_}").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        return {"id": id_, "level": level, "rows": n, "files": files} if n else None

    def append(self, rows: DataFrame, batch: int | None = None) -> int:
        """Adds rows as a part; the number of the version that has them. A numbered batch of a stream that is there already is
        not added again."""
        version = self.version()
        schema = self._schema(version)
        if set(rows.columns) != set(schema.names) or len(rows.columns) != len(schema):
            raise ValueError(f"columns {rows.columns} are not those of the history, {schema.names}")
        typed = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))
        seen = lambda v: batch is not None and v["batch"] is not None and v["batch"] >= batch
        if seen(version):
            return version["number"]
        part = self._part(version, typed, 0)
        while not seen(version):
            number = version["number"] + 1
            new = version | {"number": number, "parts": version["parts"] + [part] * bool(part), "batch": version["batch"] if batch is None else batch}
            if not part and batch is None:
                break
            if self.store.publish(number, json.dumps(new)):
                return number
            version = self.version()
        return version["number"]

    def compact(self, fan: int = 8) -> int:
        """Gathers every level of at least ``fan`` parts into one part of the next, from the lowest up; the number of parts
        that went."""
        gone, level = 0, 0
        version = self.version()
        while level <= max((p["level"] for p in version["parts"]), default=-1):
            old = [p for p in version["parts"] if p["level"] == level]
            if len(old) >= max(fan, 2):
                self._replace(old, self._gathered(version, old, level + 1))
                gone += len(old)
                version = self.version()
            level += 1
        return gone

    def _gathered(self, version: dict, old: list[dict], level: int) -> dict:
        rows = self._rows(version, [f"{self.root}/data/{p['id']}" for p in old])
        order = [curve(F.col(SKU), F.col(SHOP)), F.col(SKU), F.col(SHOP), F.col(f"`{self.ts}`")]
        files = -(-sum(p["rows"] for p in old) // self.per_file)
        return self._part(version, rows.repartitionByRange(files, *order).sortWithinPartitions(*order), level)

    def _replace(self, old: list[dict], new: dict) -> int:
        ids = {p["id"] for p in old}
        while True:
            version = self.version()
            if not ids <= {p["id"] for p in version["parts"]}:
                raise Conflict("another compaction has taken the same parts")
            number = version["number"] + 1
            if self.store.publish(number, json.dumps(version | {"number": number, "parts": [p for p in version["parts"] if p["id"] not in ids] + [new]})):
                return number

    def read(self, number: int | None = None) -> DataFrame:
        version = self.version(number)
        return self._rows(version, [f"{self.root}/data/{p['id']}" for p in version["parts"]])

    def _asked(self, version: dict, sku_id: str | None, competitor_id: int | None) -> dict[str, Column]:
        """The keys of a look-up as the history has them: their type decides on their hash."""
        kinds = {f.name: f.dataType for f in self._schema(version)}
        return {k: F.lit(v).cast(kinds[k]) for k, v in ((SKU, sku_id), (SHOP, competitor_id)) if v is not None}

    def files_of(self, sku_id: str | None = None, competitor_id: int | None = None, since: datetime | str | None = None, number: int | None = None) -> list[str]:
        """The files that may have rows of a SKU, of a shop or of a pair, at or after a time."""
        version = self.version(number)
        if not version["parts"]:
            return []
        asked, may = self._asked(version, sku_id, competitor_id), F.lit(True)
        for key, bits in ((SKU, "skus"), (SHOP, "shops")):
            if key in asked:
                may &= F.col(bits).bitwiseAND(_bit(asked[key])) != 0
        if len(asked) == 2:
            may &= curve(asked[SKU], asked[SHOP]).between(F.col("z_first"), F.col("z_last"))
        if since is not None:
            may &= F.col("last") >= F.lit(since).cast(self._schema(version)[self.ts].dataType)
        stats = self.spark.read.parquet(*(f"{self.root}/stats/{p['id']}" for p in version["parts"]))
        part = F.element_at(F.split("_metadata.file_path", "/"), -2)
        # A name for each file that the look-up reads
        return sorted(f"{self.root}/data/{r.part}/{r.file}" for r in stats.where(may).select(part.alias("part"), "file").collect())

    def of(self, sku_id: str | None = None, competitor_id: int | None = None, since: datetime | str | None = None, number: int | None = None) -> DataFrame:
        """The rows of a SKU, of a shop or of a pair, at or after a time."""
        version = self.version(number)
        rows = self._rows(version, self.files_of(sku_id, competitor_id, since, version["number"]))
        for key, value in self._asked(version, sku_id, competitor_id).items():
            rows = rows.where(F.col(key) == value)
        return rows if since is None else rows.where(F.col(f"`{self.ts}`") >= F.lit(since).cast(self._schema(version)[self.ts].dataType))

    def tidy(self, keep: int = 3, seconds: float = 86_400) -> int:
        """Takes away versions before the last ``keep``, and parts that only they name; folders younger than ``seconds`` stay, as
        a writer may be about to name them. The number of parts taken away."""
        known = self.store.numbers()
        for n in known[:-keep]:
            self.store.drop(n)
        named = {p["id"] for n in known[-keep:] for p in self.version(n)["parts"]}
        gone = 0
        for part, changed in self.store.folders("data"):
            if part not in named and time.time() - changed >= seconds:
                gone += self.store.remove("data", part)
                self.store.remove("stats", part)
        return gone

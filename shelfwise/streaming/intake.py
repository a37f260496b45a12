"""Each observation is stored once, however late it is delivered again.

``dedupe_stream`` forgets what is older than its watermark. Here the whole stored history is asked, but rarely read: for each
day of the history there are Bloom filters, in ``PARTS`` parts by a hash of the key. A row that they do not know is new for
certain; the few that they seem to know are compared with the stored keys of their days. A batch writes a folder of its new
rows and a folder of filters over them; a batch that runs again replaces its own and asks only those before it. ``compact``
brings the filters of many batches together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.staging import staged

KEYS = ("sku_id", "competitor_id", "scraped_at")
#: Parts of a day's filter, bits of a part, and bits that a key sets: one key in a hundred seems known at 30,000 keys a part.
PARTS, BITS, PROBES = 16, 1 << 19, 5


def _places(keys: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The bits of each 64-bit hash, a row a key: a start and an odd step, both of the hash."""
    h = keys.to_numpy(zero_copy_only=False).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(BITS)).astype(np.int64)


def _bits(parts) -> np.ndarray:
    """Filters brought together."""
    out = np.zeros(BITS // 8, np.uint8)
    for p in parts:
        out |= np.frombuffer(p, np.uint8)
    return out


def _ask(rows: pa.Table, filters: pa.Table) -> pa.Table:
    known = np.unpackbits(_bits(filters.column("bits").to_pylist())).astype(bool)
    seems = known[_places(rows.column("key_").combine_chunks())].all(axis=1) if rows.num_rows else np.zeros(0, bool)
    return rows.append_column("seems_", pa.array(seems))


def _build(rows: pa.Table) -> pa.Table:
    marks = np.zeros(BITS, np.uint8)
    marks[_places(rows.column("key_").combine_chunks()).ravel()] = 1
    return pa.table({"day_": rows.column("day_").slice(0, 1), "part_": rows.column("part_").slice(0, 1), "bits": pa.array([np.packbits(marks).tobytes()], pa.binary())})


def _merge(filters: pa.Table) -> pa.Table:
    return pa.table({"day_": filters.column("day_").slice(0, 1), "part_": filters.column("part_").slice(0, 1), "bits": pa.array([_bits(filters.column("bits").to_pylist()).tobytes()], pa.binary())})


_FILTER = "day_ date, part_ int, bits binary"


def _whole(spark: SparkSession, folder: str) -> dict[int, str]:
    """Finished batches below a folder: number and path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    found = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("batch=")]
    return {int(p.getName()[6:]): p.toString() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


def _filters(spark: SparkSession, root: str, batch_id: int | None = None) -> list[str]:
    """Folders of filters that together know all batches (before ``batch_id``): the last compact one and what came after."""
    compact = {n: p for n, p in _whole(spark, f"{root}/compact").items() if batch_id is None or n < batch_id}
    base = max(compact, default=-1)
    after = [p for n, p in _whole(spark, f"{root}/filters").items() if n > base and (batch_id is None or n < batch_id)]
    return ([compact[base]] if compact else []) + after


def keyed(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    key = F.xxhash64(*keys)
    return df.withColumns({"key_": key, "day_": F.to_date("scraped_at"), "part_": F.pmod(F.shiftright(key, 48), F.lit(PARTS)).cast("int")})


def intake_batches(spark: SparkSession, root: str, keys: tuple[str, ...] = KEYS, told: list | None = None):
    """A foreachBatch function that stores below ``root`` what is not there yet. Of several rows of a key in a batch the first
    by run_id and seq stays. ``told`` gets a dict a batch: rows, seeming (as far as filters tell) and repeats."""

    def batch(df: DataFrame, batch_id: int) -> None:
        columns = df.columns
        one = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct("run_id", "seq")).alias("r")).select("r.*")
        rows = keyed(one, keys).where("day_ is not null")
        schema = f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, seems_ boolean"
        folders = _filters(spark, root, batch_id)
        filters = spark.read.schema(_FILTER).parquet(*folders) if folders else spark.createDataFrame([], _FILTER)
        # Filters of days that the batch has not are not moved
        wanted = filters.join(rows.select("day_", "part_").distinct(), ["day_", "part_"], "left_semi")
        asked = rows.groupBy("day_", "part_").cogroup(wanted.groupBy("day_", "part_")).applyInArrow(_ask, schema)
        asked = staged(asked, "intake-asked")
        seeming = asked.where("seems_")
        days = [r.day_ for r in seeming.select("day_").distinct().collect()]  # a value a day
        before = [p for n, p in _whole(spark, f"{root}/history").items() if n < batch_id]
        new = asked.where("not seems_")
        if days and before:
            stored = spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, day_ date").option("basePath", f"{root}/history").parquet(*before)
            held = stored.where(F.col("day_").isin(days)).select(*(F.col(k).alias(f"held_{k}") for k in keys))
            fresh = seeming.join(held, [seeming[k].eqNullSafe(held[f"held_{k}"]) for k in keys], "left_anti")
            new = new.unionByName(fresh)
        else:
            new = asked
        new = staged(new, "intake-new")
        built = new.select("day_", "part_", "key_").groupBy("day_", "part_").applyInArrow(_build, _FILTER)
        built.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/filters/batch={batch_id}")
        new.select(*columns, "day_").repartition("day_").write.mode("overwrite").partitionBy("day_").parquet(f"{root}/history/batch={batch_id}")
        if told is not None:
            n, seem, left = asked.count(), seeming.count(), new.count()
            told.append({"rows": n, "seeming": seem, "repeats": n - left})

    return batch


def compact(spark: SparkSession, root: str) -> None:
    """One filter a day and part for all batches so far."""
    known = _whole(spark, f"{root}/filters")
    if known:
        every = spark.read.schema(_FILTER).parquet(*_filters(spark, root))
        merged = every.groupBy("day_", "part_").applyInArrow(_merge, _FILTER)
        merged.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/compact/batch={max(known)}")


def read_history(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/history").parquet(*_whole(spark, f"{root}/history").values()).drop("batch", "day_")

"""Snapshots as they arrive: alerts, the latest of each pair, run statistics, repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.snapshots import PAIR, enrich_snapshots, latest_per_pair, price_alerts
from shelfwise.streaming.state import on_disk


def stream_alerts(stream: DataFrame, skus: DataFrame, competitors: DataFrame) -> DataFrame:
    """Alerts of arriving observations; skus and competitors are static."""
    return price_alerts(enrich_snapshots(stream, skus, competitors))


#: Parts of the table of latest rows; a batch rewrites those that it touches.
BUCKETS = 64


def _folder(spark, path: str):
    """Hadoop's file system for a path, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _pointers(spark, table_root: str) -> list[int]:
    """Batches whose pointer is whole, oldest first."""
    fs, where = _folder(spark, f"{table_root}/pointers")
    if not fs.exists(where):
        return []
    whole = [f.getPath() for f in fs.listStatus(where) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in whole)


def _state(spark, table_root: str, batch: int) -> dict[int, int]:
    """Version of each bucket after a batch: at most BUCKETS rows."""
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{table_root}/pointers/batch={batch}").collect()}


def maintain_latest(spark, table_root: str, buckets: int = BUCKETS, keep: int = 3):
    """A foreachBatch function that keeps the latest row of each pair below ``table_root``. Pairs are dealt to buckets by
    hash; a batch merges its rows with the buckets that they touch, writes those as a new version, and then a pointer that
    names the version of every bucket. Older rows never win, so order of arrival does not matter; a batch that runs again
    starts from the pointer before it and writes the same. Versions that none of the last ``keep`` pointers names go."""

    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*PAIR), F.lit(buckets)).cast("int"))

    def batch(df: DataFrame, batch_id: int) -> None:
        columns = df.columns
        newest = bucketed(latest_per_pair(df)).persist()
        try:
            touched = [r.bucket for r in newest.select("bucket").distinct().collect()]
            if not touched:
                return
            before = [b for b in _pointers(spark, table_root) if b < batch_id]
            state = _state(spark, table_root, before[-1]) if before else {}
            old = [f"{table_root}/version={state[b]}/bucket={b}" for b in touched if b in state]
            rows = newest
            if old:
                rows = bucketed(latest_per_pair(spark.read.schema(df.schema).parquet(*old).unionByName(newest.select(*columns))))
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table_root}/version={batch_id}")
        finally:
            newest.unpersist()
        state |= {b: batch_id for b in touched}
        pointer = spark.createDataFrame(sorted(state.items()), "bucket int, version long").coalesce(1)
        pointer.write.mode("overwrite").parquet(f"{table_root}/pointers/batch={batch_id}")
        tidy(batch_id)

    def tidy(batch_id: int) -> None:
        known = [b for b in _pointers(spark, table_root) if b <= batch_id]
        named = {f"version={v}/bucket={b}" for p in known[-keep:] for b, v in _state(spark, table_root, p).items()}
        fs, root = _folder(spark, table_root)
        for p in known[:-keep]:
            fs.delete(_folder(spark, f"{table_root}/pointers/batch={p}")[1], True)
        for version in fs.listStatus(root):
            name = version.getPath().getName()
            if name.startswith("version=") and int(name.split("=")[1]) <= batch_id:
                parts = [f.getPath() for f in fs.listStatus(version.getPath()) if f.getPath().getName().startswith("bucket=")]
                gone = [p for p in parts if f"{name}/{p.getName()}" not in named]
                for p in gone:
                    fs.delete(p, True)
                if len(gone) == len(parts):
                    fs.delete(version.getPath(), True)

    return batch


def read_latest(spark, table_root: str) -> DataFrame:
    state = _state(spark, table_root, _pointers(spark, table_root)[-1])
    return spark.read.parquet(*(f"{table_root}/version={v}/bucket={b}" for b, v in sorted(state.items())))


def _timed(stream: DataFrame) -> DataFrame:
    """Watermarks need a time with a zone."""
    return stream.withColumn("scraped_at", F.col("scraped_at").cast("timestamp"))


def stream_run_stats(stream: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counters of each run in tumbling windows; late rows within ``delay`` still count."""
    a = F.col("availability")
    return (
        on_disk(_timed(stream)).withWatermark("scraped_at", delay)
        .groupBy(F.window("scraped_at", width), "run_id")
        .agg(F.count(F.lit(1)).alias("attempted"), F.count_if(a != "error").alias("succeeded"), F.count("raw_price").alias("prices_found"))
        .select(F.col("window.start").alias("window_start"), "run_id", "attempted", "succeeded", "prices_found")
    )


def dedupe_stream(stream: DataFrame, delay: str = "10 minutes", keys: tuple[str, ...] = ("sku_id", "competitor_id", "scraped_at")) -> DataFrame:
    """Each observation once, however often it is delivered within ``delay``."""
    return on_disk(_timed(stream)).withWatermark("scraped_at", delay).dropDuplicatesWithinWatermark(list(keys))

"""Where streams keep their state.

Spark's default keeps all of it, and the version before, in the executors' heap, so it has to fit there. With RocksDB it lies on
the executors' disks behind a cache of ``CACHE_MB``, and the checkpoint gets what a batch has changed. Its values are the
session's and hold for queries that start from then on; a checkpoint goes on with the store that it was begun with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Memory of an executor for the caches and write buffers of all its stores.
CACHE_MB = 300
_STORE = "spark.sql.streaming.stateStore"


def on_disk(stream: DataFrame) -> DataFrame:
    """The same stream; its session keeps state in RocksDB, unless it names a store of its own."""
    conf = stream.sparkSession.conf
    if conf.get(f"{_STORE}.providerClass", None) is None:
        conf.set(f"{_STORE}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        for name, value in (("changelogCheckpointing.enabled", "true"), ("boundedMemoryUsage", "true"), ("maxMemoryUsageMB", str(CACHE_MB))):
            conf.set(f"{_STORE}.rocksdb.{name}", value)
    return stream

"""Tables written on the way: what a job needs more than once is computed once, and a lost executor costs no recomputation.

They lie in the folder that driver and executors share, spark.checkpoint.dir, and stay there until it is cleared.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; on a cluster only one machine would
    see that, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _fallback.get("dir")
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _fallback["dir"] = tempfile.mkdtemp(prefix="spark-")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when their job has ended, not when the driver happens to collect its garbage, unless the session says
    otherwise."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, "true")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a new path and read again."""
    path = new_path(df.sparkSession, name)
    drop_shuffles(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

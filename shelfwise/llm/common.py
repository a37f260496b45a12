"""What the operators of this folder share: reading, staging, words, hashes.

Words are runs of bytes other than space and 0x09-0x0D; lower case touches A-Z alone. ``bytes.split`` cuts at
exactly those bytes, and since they are ASCII it never cuts inside a UTF-8 character.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same words in a form that Spark's and DuckDB's regular expressions share.
WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_fallback: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder
    of its own; on a cluster that folder would be seen by one machine alone, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _fallback.get("dir")
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _fallback["dir"] = tempfile.mkdtemp(prefix="spark-")
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Small Arrow batches, so that a worker's memory follows bytes rather than rows, and shuffle files that go as soon as the
#: query that wrote them has ended.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def settle(spark: SparkSession) -> None:
    """Gives the session the SETTINGS that it has no value of its own for; what a caller has set stays. They are not taken
    back, since the DataFrame that an operator returns runs later."""
    own = spark.conf.getAll
    for key, value in SETTINGS.items():
        if key not in own:
            spark.conf.set(key, value)


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows written to the shared folder and read again: cuts lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    gc.collect()
    return spark.read.schema(df.schema).parquet(path)


def spare_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def lower_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def hashes(tokens: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings."""
    one = xxhash.xxh3_64_intdigest
    return np.fromiter((one(t) for t in tokens), dtype=np.uint64, count=len(tokens))


def stir(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each window of n consecutive word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = stir(out + np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return out


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; with fewer words the whole sequence is the one shingle."""
    h = hashes(lower_words(text))
    return np.unique(windows(h, min(n, len(h)))) if len(h) else np.empty(0, np.uint64)


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def label_rows(labels: DataFrame, column: str) -> DataFrame:
    """One row a document: (label_id, label); repeated labels count as 1 if any says so, null labels are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.max(F.col(column).cast("int")).alias("label"))
    )

"""Tables that are written in buckets by pair, so that jobs by pair shuffle nothing.

The newest row of each pair, and the join of matches with it, need the rows of a pair together. Where history and matches lie
in as many buckets by the same key, each task reads its buckets of both: the plan has no exchange. A table is known to the
session by its name; ``known`` names one that an earlier session has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.operators.snapshots import PAIR


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, keys: list[str] = PAIR, mode: str = "errorifexists") -> DataFrame:
    """Writes (or with mode ``append`` adds) df to table ``name`` below ``path``. Rows are dealt out to their buckets first, so
    a write makes one file a bucket, sorted by key. Appends leave a file more in each bucket: choose ``buckets`` so that one
    holds some hundred MB, and write the table anew now and then."""
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def known(spark: SparkSession, name: str, path: str, schema: str, buckets: int, keys: list[str] = PAIR) -> DataFrame:
    """The table of an earlier session, by its folder."""
    by = ", ".join(keys)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
